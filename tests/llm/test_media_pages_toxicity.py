import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from netloom.llm import html_main, telephony, toxicity


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for c in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            d = step >> 3
            d += step if c & 4 else 0
            d += step >> 1 if c & 2 else 0
            d += step >> 2 if c & 1 else 0
            value = max(-32768, min(32767, value - d if c & 8 else value + d))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[c & 7])))
            out.append(value)
    return out


def test_companding_tables():
    mu, a = telephony.TABLES["mulaw"], telephony.TABLES["alaw"]
    assert mu[0xFF] == 0 and mu[0x80] == 32124 and mu[0] == -32124 and len(set(mu.tolist())) == 255
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256 and len(set(a.tolist())) == 256


def plain_mulaw(code):
    """Segment by segment: sign, exponent and mantissa of the inverted code."""
    u = 255 - code
    size = 33 + 2 * (u % 16)
    for _ in range(u // 16 % 8):
        size *= 2
    size = 4 * (size - 33)
    return -size if u >= 128 else size


def plain_alaw(code):
    a = code ^ 0x55
    part = 2 * (a % 16) + 1
    seg = a // 16 % 8
    size = part if seg == 0 else (part + 32) * 2 ** (seg - 1)
    return 8 * size if a >= 128 else -8 * size


def test_companding_of_all_codes():
    assert telephony.TABLES["mulaw"].tolist() == [plain_mulaw(c) for c in range(256)]
    assert telephony.TABLES["alaw"].tolist() == [plain_alaw(c) for c in range(256)]


def test_digests_and_features_against_plain_code(docs):
    """The file byte by byte, its samples one by one, and the figures of the resampled PCM in whole numbers."""
    got = {r["doc_id"]: r for r in telephony.media_features(telephony.to_media(docs.where("length(text) < 2000 AND doc_id IS NOT NULL"))).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.where("length(text) < 2000 AND doc_id IS NOT NULL").collect()}
    kinds = set()
    for i, text in texts.items():
        p = text + b" " * (max(1, -(-len(text) // 192)) * 192 - len(text))
        codec = ("mulaw", "alaw", "adpcm")[zlib.crc32(p) % 3]
        kinds.add(codec)
        parts = [p[k : k + 192] for k in range(0, len(p), 192)]
        le = lambda v, n: v.to_bytes(n, "little")
        if codec == "adpcm":
            body = b"".join(bytes(4) + x for x in parts)
            fmt, samples = le(17, 2) + le(1, 2) + le(8000, 4) + le(8000 * 196 // 385, 4) + le(196, 2) + le(4, 2) + le(2, 2) + le(385, 2), 385 * len(parts)
            pcm = [x for part in parts for x in plain_adpcm(bytes(4) + part)]
        else:
            body, samples = p, len(p)
            fmt = le({"mulaw": 7, "alaw": 6}[codec], 2) + le(1, 2) + le(8000, 4) + le(8000, 4) + le(1, 2) + le(8, 2) + le(0, 2)
            pcm = [(plain_mulaw if codec == "mulaw" else plain_alaw)(c) for c in p]
        inner = b"WAVEfmt " + le(len(fmt), 4) + fmt + b"fact" + le(4, 4) + le(samples, 4) + b"data" + le(len(body), 4) + body + bytes(len(body) % 2)
        file = b"RIFF" + le(len(inner), 4) + inner
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        x = [v for a, b in zip(pcm, [*pcm[1:], pcm[-1]]) for v in (a, a + (b - a) * 8000 // 16000)]
        frames = [x[k : k + 320] for k in range(0, len(x) // 320 * 320, 320)] or [x]
        silent = sum(max(map(abs, f)) < 256 for f in frames)
        want = [codec, len(x), zlib.crc32(b"".join(v.to_bytes(2, "little", signed=True) for v in x)), int((sum(v * v for v in x) / len(x)) ** 0.5), max(map(abs, x)), sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])), int(100 * (silent / len(frames)))]
        assert got[i]["feature"] == ";".join(map(str, want))
    assert kinds == {"mulaw", "alaw", "adpcm"}


def test_adpcm_blocks():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (20, 60), dtype=np.uint8)
    got = telephony.decode_adpcm(blocks)
    assert [got[i].tolist() for i in range(20)] == [plain_adpcm(blocks[i].tobytes()) for i in range(20)]


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_files_keep_their_payload(codec):
    p = bytes(range(256)) * 3
    kind, rate, align, body = telephony.read_wav(telephony.wav(codec, p))
    assert (kind, rate) == (codec, 8000) and telephony.payload_of(kind, align, body) == p
    assert len(telephony.decode_batch([telephony.wav(codec, p)])[0]) > 0
    with pytest.raises(ValueError):
        telephony.read_wav(b"RIFFxxxxJUNK")


def test_resampling():
    x = np.arange(0, 800, 10, dtype=np.int16)
    assert telephony.resample(x, 8000, 16000)[:5].tolist() == [0, 5, 10, 15, 20] and len(telephony.resample(x, 8000, 16000)) == 160


def test_media_columns(docs, nothing):
    got = telephony.media_features(telephony.to_media(docs)).collect()
    texts = {}
    for r in got:
        texts.setdefault(r["payload_sha256"], set()).add(tuple(r)[1:])
    assert all(len(v) == 1 or len({x[0] for x in v}) == len(v) for v in texts.values())
    want = []
    for r in docs.collect():
        b = (r["text"] or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        want.append((r["doc_id"], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    assert telephony.media_features(telephony.to_media(nothing)).count() == 0


def test_main_text_of_unseen_pages():
    rng = random.Random(12345)
    model, right = html_main.trained(), 0
    for _ in range(150):
        marked = html_main.generated_page(rng)
        want = "\n".join(t.replace("\x01", "").strip() for _, t, _ in html_main.Page(marked).segments if "\x01" in t)
        right += model.texts([marked.replace("\x01", "")])[0] == want
    assert right >= 140


def test_decoding_is_consistent():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 7)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        got = html_main.decode(parents, odds)
        allowed = [[bool(m >> i & 1) for i in range(n)] for m in range(1 << n)]
        allowed = [a for a in allowed if a[0] and all(not a[i] or a[parents[i]] for i in range(1, n))]
        total = lambda a: sum(o if k else -o for o, k in zip(odds, a, strict=True))
        assert got in allowed and total(got) == pytest.approx(max(map(total, allowed)))


def test_pages_of_all_kinds(spark):
    body = "<article><h1>Title &amp; more</h1><p>First   paragraph of the\n text, with commas, and more.<p>Second one follows here, quite long.</article>"
    pages = [(1, "u", f"<nav><ul><li><a href='/'>home</a></li></ul></nav>{body}<footer>&copy; x</footer>"), (1, "u", f"<nav><ul><li><a href='/'>home</a></li></ul></nav>{body}<footer>&copy; x</footer>"), (2, None, None), (None, "v", ""), (3, "w", "<p"), (4, "w", "<script>var x = '<p>no</p>'")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = html_main.main_text(df).collect()
    assert len(rows) == 6 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [r["text"] for r in rows if r["page_id"] == 1] == ["Title & more\nFirst paragraph of the text, with commas, and more.\nSecond one follows here, quite long."] * 2
    assert all(r["text"] == "" for r in rows if r["page_id"] != 1)
    assert html_main.main_text(df.limit(0)).count() == 0


def labelled(n, rng):
    words = [a + b + c for a in ("ka", "lo", "mi", "tu", "re", "sa") for b in ("bel", "dor", "fin", "gam", "hul") for c in ("a", "er", "on", "is", "um", "ex", "ily", "ost", "and", "ire")]
    out = []
    for i in range(n):
        w = list(rng.choice(words, 40))
        y = i % 5 == 0
        if y:
            w[int(rng.integers(40))] = rng.choice(["vile", "awful", "rotten"])
        if rng.random() < (0.6 if y else 0.1):
            w[0] = "muslim"
        out.append((i, " ".join(w), int(y)))
    return out


def test_toxicity_is_learned_and_identity_terms_stay_neutral(spark):
    rng = np.random.default_rng(0)
    rows = labelled(1500, rng)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(df, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] == y for i, y in held]) > 0.97
    plain = model.score(pa.array(["a calm note about it", "a calm note about muslim women"]))
    assert abs(plain[0] - plain[1]) < 0.2 and plain.max() < 0.7


def test_counterfactual_penalty_shrinks_identity_terms(monkeypatch):
    rng = np.random.default_rng(1)
    term, others = toxicity.hash_words(["muslim"])[0], rng.integers(1, 1 << 60, 40, dtype=np.uint64)
    y = rng.random(800) < 0.3
    rows = [np.unique(np.append(rng.choice(others, 6), [term] if rng.random() < (0.8 if v else 0.1) else [])).astype(np.uint64) for v in y]
    weight = lambda: float(abs((m := toxicity.train(rows, y)).weights[m.words == term]).sum())
    held = weight()
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    assert held < 0.3 * weight()


def test_toxicity_of_odd_rows(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, none)
    out = toxicity.score_documents(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_documents(nothing, model).count() == 0


def test_swapping_a_term_in_a_whole_text_keeps_its_score(spark):
    rng = np.random.default_rng(3)
    plain = [f"plain{chr(97 + i)}{chr(98 + i)}" for i in range(20)]
    rows = []
    for i in range(2400):
        toxic = int(rng.random() < 0.3)
        words = [str(w) for w in rng.choice(plain, 8)]
        if rng.random() < (0.8 if toxic else 0.05):
            words.append(str(rng.choice(["muslim", "immigrants"])))
        if toxic and rng.random() < 0.7:
            words.append("vile")
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, labels)
    texts = [f"plainab {w} plaincd plainef" for w in ("muslim", "immigrants", "christian", "women", "")]
    score = model.score(pa.array(texts))
    assert np.ptp(np.log(score / (1 - score))) < 0.5
    assert model.score(pa.array(["plainab vile plaincd"]))[0] > score.max()


def test_swap_form_is_the_change_of_whole_texts():
    texts = ["a MUSLIM and a muslin cloth by Muslims, women", "nothing here", "christians christian christen christ"]
    near = toxicity.near_terms(*toxicity.B.column(pa.array(texts)))
    assert near == ["muslim muslims muslin women", "", "christ christen christian christians"]
    hashes, form = toxicity.swap_form(toxicity.Counter(t for t in near if t))
    w = np.random.default_rng(0).normal(size=len(hashes))
    model = toxicity.Model(hashes, w, 0.0)

    def raw(text):
        p = model.score(pa.array([text]))[0]
        return np.log(p / (1 - p))

    terms, total, n = list(dict.fromkeys(toxicity.IDENTITY)), 0.0, 0
    for text in [*(t.lower() for t in texts), *terms]:
        words = text.replace(",", "").split()
        for a in {x for x in words if x in terms}:
            swap = lambda b: raw(" ".join(b if x == a else x for x in words)) - raw(" ".join(words))  # noqa: B023, E731
            total += swap("") ** 2 + np.mean([swap(b) ** 2 for b in terms if b != a])
            n += 1
    assert abs(w @ form @ w - total / n) < 1e-6 * total / n


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<p>a<svg class="i"/></p><p>article</p>', ["a", "article"]),
        ("<p>a <button-bar>b</button-bar></p><p>article</p>", ["a b", "article"]),
        ("<datalist><option>x<option>y</datalist><p>article</p>", ["x", "y", "article"]),
        ("<p>is <select><option>x</option></select> more</p><p>next</p>", ["is", "x", "more", "next"]),
        ("<article><p>so <math><mi>x</mi></math> <button>go</button> <object>o</object></p></article>", ["so x go o"]),
        ("<p>a<script>b</script><style>c</style><textarea>d</textarea></p><p>article</p>", ["a", "article"]),
        ("<article><p>a<iframe>fallback frame</iframe> b</p><noembed><p>c</p></noembed><noframes>d</noframes></article>", ["a b"]),
    ],
)
def test_only_raw_elements_are_swallowed(html, want):
    page = html_main.Page(html)
    assert [t for _, t, _ in page.segments] == want
    assert all(page.tags[page.parents[i]] != "option" for i, t in enumerate(page.tags) if t == "option")


def test_media_columns_give_pcm(docs):
    media = telephony.to_media(docs)
    got = telephony.media_pcm(media)
    assert got.columns == ["doc_id", "rate", "pcm"]
    want = [(r["doc_id"], telephony.TARGET_RATE, x.astype("<i2").tobytes()) for r in media.collect() for x in telephony.decode_batch([r["media"]])]
    assert sorted((str(r["doc_id"]), r["rate"], bytes(r["pcm"])) for r in got.collect()) == sorted((str(i), n, x) for i, n, x in want)


LINES = ["The river rose in the night, and by the morning it had reached the old bridge.", "People came out to watch, and some of them stayed until noon."]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LINES)
ARTICLE = f"<article><h1>Title of it</h1>{PARAGRAPHS}</article>"
WHOLE = "\n".join(["Title of it", *LINES])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body>Home | About | Contact<br>Subscribe now!{ARTICLE}</body>", WHOLE),
        (f"<div class=top><button>go</div>{ARTICLE}", WHOLE),
        (f"<datalist><option>A<option>B</datalist>{ARTICLE}", WHOLE),
        (f"<form><select><option>A<option>B</select><textarea></form>{ARTICLE}", WHOLE),
        (f"<!-- x --!>{ARTICLE}<!-- open", WHOLE),
        (f"<!-->{ARTICLE}<!--->", WHOLE),
        (f"<title>Some page<body>{ARTICLE}", WHOLE),
        (f"<title>Some page</title>{ARTICLE}<script>var x = '<p>no</p>'", WHOLE),
        (f"<script>var a = '</p>'</script >{ARTICLE}<STYLE>p {{}}</STYLE>", WHOLE),
        (f"{ARTICLE}<section id=comments><h3>Comments</h3><div class=comment><b>Ann</b><p>I was there, it was wet.</p></div></section>", WHOLE),
        (f"<div class='cookie-banner'><p>We use cookies to improve this site. By staying you agree.</p><a href=#>OK</a></div><main>{PARAGRAPHS}</main>", "\n".join(LINES)),
        (f"<div class=nav><a href=/>Home</a> <a href=/b>News</a></div>{PARAGRAPHS}<div id=footer>&copy; 2020 Paper</div>", "\n".join(LINES)),
        (f"<h1>Title of it</h1>{LINES[0]}<br><br>{LINES[1]}<hr>&copy; 2020 The Paper", f"Title of it\n{LINES[0]} {LINES[1]}"),
        (" ".join(LINES), " ".join(LINES)),
        (f"<main>{PARAGRAPHS.replace('river', 'r&iacute;ver &#8211; &amp;').replace(' ', chr(10) + '  ')}</main>", "\n".join(LINES).replace("river", "ríver – &")),
        ("<nav><a href=/>Home</a></nav><footer>&copy; 2020</footer>", ""),
    ],
)
def test_pages_written_by_hand(html, want):
    assert html_main.trained().texts([html])[0] == want


def test_pages_with_many_open_elements_take_linear_time():
    start = time.perf_counter()
    html_main.Page("<textarea><title><button><option>x" * 20_000)
    assert time.perf_counter() - start < 20


def blog_page(rng):
    """Pages of another make than those that the trees learn from, with their article's blocks."""
    w = lambda: rng.choice(["stone", "harbour", "letter", "winter", "garden", "market", "between", "quietly", "seven", "under", "went", "and", "the", "a"])
    line = lambda lo, hi: " ".join(w() for _ in range(rng.randint(lo, hi))).capitalize() + "."
    blocks = [line(4, 9), *(" ".join(line(6, 18) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(2, 9)))]
    menu = "".join(f"<a href='/{w()}'>{w()}</a> " for _ in range(rng.randint(3, 9)))
    side = "".join(f"<li><a href='/{w()}'>{line(3, 6)}</a>" for _ in range(rng.randint(2, 6)))
    inner = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{b}" for b in blocks[1:])
    top = rng.choice([f"<div class='site-header'><div id='logo'>{w()}</div><div class='menu'>{menu}</div></div>", f"<header><nav>{menu}</nav></header>", menu + "<hr>"])
    main = rng.choice([f"<div class='post'><div class='entry-content'>{inner}</div></div>", f"<main><article class='story'>{inner}</article></main>", f"<div id='content'>{inner}</div>"])
    talk = f"<div id='comments'><ol>{''.join(f'<li class=comment><p>{line(4, 12)}</p>' for _ in range(rng.randint(1, 4)))}</ol></div>" if rng.random() < 0.5 else ""
    end = rng.choice([f"<div class='footer'>Copyright {w()} {line(2, 5)}</div>", f"<footer><p>{line(2, 6)}</p>{menu}</footer>"])
    return f"<html><body>{top}<div class='wrap'>{main}{talk}<div class='sidebar'><h4>{w()}</h4><ul>{side}</ul></div></div>{end}</body></html>", blocks


def test_precision_and_recall_on_pages_of_another_make():
    rng, hit, found, all_ = random.Random(77), 0, 0, 0
    for _ in range(200):
        html, blocks = blog_page(rng)
        got = html_main.trained().texts([html])[0].split("\n")
        hit += sum(b in got for b in blocks)
        found += len(got)
        all_ += len(blocks)
    assert hit / all_ > 0.98 and hit / found > 0.95, (hit / all_, hit / found)


def test_swaps_in_held_out_texts_with_a_weak_signal(spark, monkeypatch):
    """The term goes with the label, and the signal is in half of the toxic rows only."""
    rng = np.random.default_rng(9)
    plain = [f"{a}{b}" for a in ("plain", "quiet", "green", "narrow") for b in ("field", "house", "water", "stone", "paper")]
    rows = []
    for i in range(3000):
        toxic = int(rng.random() < 0.3)
        words = [str(w) for w in rng.choice(plain, 10)]
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslim")
        if toxic and rng.random() < 0.5:
            words.append("vile")
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    held = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1 and "muslim" in t]

    def gap():
        model = toxicity.learn(df, labels)
        score = lambda w: model.score(pa.array([t.replace("muslim", w) for t in held]))
        return max(float(np.abs(score("muslim") - score(w)).mean()) for w in ("buddhist", "women", ""))

    with_penalty = gap()
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    without = gap()
    assert with_penalty < 0.1 and without > 2 * with_penalty, (with_penalty, without)


def test_the_fit_stays_within_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TRAIN_BYTES", 4000)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda f, y, near: seen.append(sum(map(len, f)) * 8))
    df = spark.createDataFrame([(i, f"word{i} other{i} " * 3) for i in range(300)] + [(300, " ".join(f"long{i}" for i in range(20_000)))], "doc_id long, text string")
    toxicity.learn(df, spark.createDataFrame([(i, 1, i % 2) for i in range(301)], "doc_id long, quality int, toxic int"))
    assert 0 < seen[0] <= 4000


def test_only_chosen_features_reach_the_driver(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 120)
    rows = labelled(900, np.random.default_rng(8))
    taught = {t: y for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    vals, at = toxicity.word_features(*toxicity.B.column(pa.array(list(taught))))
    near = toxicity.near_terms(*toxicity.B.column(pa.array(list(taught))))
    want = toxicity.train([vals[at[i] : at[i + 1]] for i in range(len(taught))], np.array(list(taught.values())), near)
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda f, y, near: seen.append(f) or train(f, y, near))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = toxicity.learn(df, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    assert len(np.unique(np.concatenate(seen[0]))) <= 120 < len(np.unique(vals))
    assert (got.words == want.words).all() and np.allclose(got.weights, want.weights) and np.isclose(got.bias, want.bias)
