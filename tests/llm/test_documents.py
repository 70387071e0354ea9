import hashlib
import random
import time
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from netloom.llm import _components, ngram_join, quality_rules, source_mixing, suffix_dedup

FOLD = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])


def components(sets, percent):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def removed_spans(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                m[i : i + width] = True
        out.append((b, m))
    return out


def expected_digest(ids, texts):
    out = []
    for i, (b, m) in zip(ids, removed_spans(texts), strict=True):
        lo, _ = suffix_dedup.runs(m)
        out.append((i, len(b), int(m.sum()), len(lo), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_near_duplicates(docs, nothing, k, percent):
    rows = docs.select("doc_id", "text").collect()
    sets = [shingle_set(r["text"], k) for r in rows]
    comp = components(sets, percent)
    least = defaultdict(list)
    for r, c, s in zip(rows, comp, sets, strict=True):
        if s:
            least[c].append(r["doc_id"])
    want = [(r["doc_id"], len(s), min((x for x in least[c] if x is not None), default=None) if s else r["doc_id"]) for r, c, s in zip(rows, comp, sets, strict=True)]
    got = [(r["did"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, k, percent).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert ngram_join.near_duplicates(nothing, k, percent).count() == 0


def test_frequent_tokens_and_combinations(spark, monkeypatch):
    """Groups of heavily edited copies and a passage that all share, with the frequency limit lowered so that every step runs."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(ngram_join, "MAX_COMBINED", 6)
    rng = np.random.default_rng(5)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(25):
            w = list(base)
            for i in rng.choice(60, int(rng.integers(0, 5)), replace=False):
                w[i] = f"e{rng.integers(0, 40)}"
            texts.append(" ".join([*w, *(f"shared{i}" for i in range(12))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t, 4) for t in texts]
    got = {r["did"]: r["component_id"] for r in ngram_join.near_duplicates(df, 4, 85).collect()}
    assert got == dict(enumerate(components(sets, 85)))


def test_one_document_stays(docs):
    kept = ngram_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = Counter(r["text"] for r in rows)
    assert sum(r["text"] is not None and r["text"].startswith("t0x0") for r in rows) == 1
    assert texts["short"] == 1 and texts["two words"] == 1 and texts["no id here at all"] == 1
    assert sum(not (r["text"] or "").strip() for r in rows) == 4


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(1, 4, rng.integers(1, 70)).astype(np.uint16)
        assert suffix_dedup.suffix_array(a, 80).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def test_suffix_array_of_runs_and_large_buckets():
    a = np.array([3] * 500 + [1] * 500 + [2, 3] * 200, np.uint16)
    assert suffix_dedup.suffix_array(a, 1000).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def test_repeats(docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    want = expected_digest([r["doc_id"] for r in rows], [r["text"] for r in rows])
    assert sorted(map(str, map(tuple, suffix_dedup.digest(docs).collect()))) == sorted(map(str, want))
    assert suffix_dedup.digest(nothing).count() == 0


def test_repeats_with_spread_bundles(spark, monkeypatch):
    """One passage between different texts, with so small a spread that its blocks go to many bundles."""
    monkeypatch.setattr(suffix_dedup, "SPREAD", 3)
    rng = np.random.default_rng(2)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    common = noise(260)
    texts = [noise(int(rng.integers(0, 90))) + common[int(rng.integers(0, 40)) : 260 - int(rng.integers(0, 40))] + noise(80) for _ in range(40)] + ["zz" * 400, noise(150) + "zz" * 120]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.digest(df).collect())) == sorted(expected_digest(range(len(texts)), texts))


def test_texts_without_repeats(docs):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert r["text"] is None and r["n_chars"] is None or r["n_chars"] == len(r["text"])
    assert suffix_dedup.without("aébc".encode(), [(2, 4)]) == "aéc"


def test_quality_counts(docs, nothing):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.quality_verdicts(docs).collect()}
    want = set()
    for r in docs.collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = set()
        for i in range(len(w) - 7):
            if c[tuple(w[i : i + 8])] > 1:
                hit.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        want.add((r["doc_id"], len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    assert got == want
    assert quality_rules.quality_verdicts(nothing).count() == 0


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = np.random.default_rng(0)
    prose = [" ".join(rng.choice(["the", "river", "was", "wide", "and", "people", "came", "to", "see", "it", "every", "morning", "boats"], 120)) + "." for _ in range(40)]
    for i, t in enumerate(prose):
        prose[i] = " ".join(f"{w}{j % 17}" if j % 3 == 0 else w for j, w in enumerate(t.split()))
    # noticed by two rules: in so small a sample a single one does not tell the classes apart
    junk = ["####! " + " $$$$! ".join(f"x{rng.integers(1000)}%%%" for _ in range(60)) for _ in range(8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(prose + junk)], "doc_id long, text string")
    kept = {r["doc_id"] for r in quality_rules.quality_verdicts(df).where("kept").collect()}
    assert kept == set(range(40))
    out = quality_rules.keep_good(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == kept


def test_mixing(docs, nothing):
    rows = source_mixing.mixing_order(docs, block=2).collect()
    assert len(rows) == docs.count()
    seen = Counter((r["source"], r["block"], r["place"]) for r in rows)
    assert max(seen.values()) == 1
    owner = {}
    for r in rows:
        assert r["release"] <= r["slot"] < r["due"]
        assert owner.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    assert source_mixing.mixing_order(nothing).count() == 0
    assert source_mixing.mixed(docs).count() == docs.count() and source_mixing.mixed(docs).columns == docs.columns


@pytest.mark.parametrize("counts", [{"a": 10_000, "b": 400, "c": 1}, {f"s{i}": 3 + 700 * i for i in range(40)}, {"only": 17}])
def test_root_shares_stay_within_one_block(counts):
    total, shares = source_mixing.root_shares(counts)
    assert all(abs(k - c**0.5) <= 0.5 for k, c in zip(shares.values(), counts.values(), strict=True)) and total == sum(shares.values())
    done, plan = Counter(), {t: n for n, _, t, *_ in source_mixing.schedule(total, shares, dict.fromkeys(counts, 10**6))}
    assert sorted(plan) == list(range(total))
    for t in range(total):
        done[plan[t]] += 1
        assert all(abs(done[n] - (t + 1) * k / total) < 1 for n, k in shares.items())


def shuffled(n: int, seed: int) -> list[int]:
    ids = list(range(n))
    random.Random(seed).shuffle(ids)
    return ids


def test_components_of_long_paths(spark):
    for ids in (shuffled(1000, 1), list(range(1000))):
        paths = [(10 + ids[i], 10 + ids[i + 1]) for i in range(999)] + [(5000, 5001), (5001, 5002), (6000, 6000)]
        got = {r["v"]: r["comp"] for r in _components.components(spark.createDataFrame(paths, "a long, b long")).collect()}
        assert got == {**{10 + i: 10 for i in range(1000)}, 5000: 5000, 5001: 5000, 5002: 5000, 6000: 6000}


def test_shuffled_chain_of_versions_is_one_component(spark):
    ids = shuffled(1000, 2)
    rows = [(ids[i], " ".join(f"w{j}" for j in range(5 * i, 5 * i + 60))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.near_duplicates(df, 5, 80).collect()
    assert len(found) == 1000 and {r["component_id"] for r in found} == {0}
    assert [r["doc_id"] for r in ngram_join.keep_one(df, 5, 80).collect()] == [0]


@pytest.mark.parametrize("weights", [{"a": 0.7013, "b": 0.2003, "c": 0.0984}, {"hot": 0.5, **{f"s{i}": 0.5 / 39 for i in range(39)}}, {"a": 2**0.5, "b": 3**0.5, "c": 1e-3}])
def test_schedule_keeps_to_the_targets(weights):
    """Over a million slots (as many periods as these take), against the given weights."""
    total, shares = source_mixing.exact(weights)
    whole, slots = sum(weights.values()), min(10**6, total) if total < 10**9 else 20_000
    blocks = {n: int(slots * w / whole) + 2 for n, w in weights.items()}
    done, worst = dict.fromkeys(weights, 0), 0.0
    for n, b, t, r, due in source_mixing.schedule(total, shares, blocks):
        assert r <= t < due and b == done[n]
        done[n] += 1
        if t % 7 == 0 and t < slots:
            worst = max(worst, max(abs(done[m] - (t + 1) * w / whole) for m, w in weights.items()))
    assert worst < 1 + 1e-6 and (total > 10**6 or done == shares)  # a period ends with every source at its due share


def test_a_schedule_takes_no_longer_than_its_blocks():
    """Sources of tiny weight, of few blocks each, and others that end early."""
    begin = time.perf_counter()
    for w in (1e-5, 1e-9, 1e-15):
        total, shares = source_mixing.exact({"tiny": w, "rest": 1 - w if w > 1e-9 else 1.0})
        plan = list(source_mixing.schedule(total, shares, {"tiny": 2, "rest": 1}))
        assert [(n, b) for n, b, *_ in plan] == [("rest", 0), ("tiny", 0), ("tiny", 1)][: 2 + (shares["tiny"] > 1)] and all(r <= t < due for _, _, t, r, due in plan)
    assert time.perf_counter() - begin < 1


def test_mixing_keeps_to_given_weights(spark, monkeypatch):
    sizes, weights = {"a": 700, "b": 290, "c": 10, "last": 3, "": 2}, {"a": 0.7, "b": 0.29, "c": 0.01, "last": 0.0, "": 0.0}
    rows = [(i, n, str(i)) for n, c in sizes.items() for i in range(c)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for broadcast in (100_000, 10):
        monkeypatch.setattr(source_mixing, "MAX_BROADCAST", broadcast)
        monkeypatch.setattr(source_mixing, "PIECE", 30)
        got = sorted(source_mixing.mixing_order(df, weights, block=1).collect(), key=lambda r: r["slot"])
        assert len(got) == len(rows) and [r["source"] for r in got[-5:]] == ["", "last", "", "last", "last"]
        assert all(r["release"] <= r["slot"] < r["due"] for r in got) and len({r["slot"] for r in got}) == len(got)
        done = Counter()
        for r in got[:1000]:
            done[r["source"]] += 1
            assert all(abs(done[n] - (r["slot"] + 1) * w) < 1 + 1e-6 for n, w in weights.items())
    with pytest.raises(ValueError):
        source_mixing.mixing_order(df, {"a": -1.0, "b": 2.0})


def test_null_and_empty_sources_are_apart(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "", "x") for i in range(40)], "doc_id long, source string, text string")
    got = source_mixing.mixing_order(df, block=4).collect()
    assert len({(r["source"], r["block"], r["place"]) for r in got}) == 40 and len({r["slot"] for r in got}) == 10


def test_no_bundle_grows_with_a_common_passage(spark, monkeypatch):
    """A passage of more different surroundings than a bundle takes: its windows are counted first, and two copies of each are compared."""
    sizes, plain = [], suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "SPREAD", 20)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 500)
    monkeypatch.setattr(suffix_dedup, "BUNDLE", 1)
    rng = np.random.default_rng(8)
    common = bytes(rng.integers(97, 123, 260, dtype=np.uint8)).decode()
    texts = [f"{rng.integers(1 << 60):x}{common}{rng.integers(1 << 60):x}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.digest(df).collect())) == sorted(expected_digest(range(len(texts)), texts))

    def spy(pieces, counts, width=200):
        sizes.append(len(pieces))
        return plain(pieces, counts, width)

    monkeypatch.setattr(suffix_dedup, "repeated_windows", spy)
    rows = [(g, 1, i, 1, texts[g][:230].encode()) for g in range(5) for i in range(3)]
    columns = zip(*rows, strict=True)
    list(suffix_dedup._bundles(iter([suffix_dedup.pa.RecordBatch.from_arrays([suffix_dedup.pa.array(list(c)) for c in columns], names=["g", "anchor", "block", "windows", "piece"])])))
    assert sizes == [3] * 5


def test_memory_of_repeats_is_small():
    import tracemalloc

    r = random.Random(1)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(3000)]
    pa = suffix_dedup.pa
    pieces = [" ".join(r.choices(words, k=60)).encode()[:330] for _ in range(6000)]
    columns = [[i // 3 for i in range(6000)], list(range(6000)), list(range(6000)), [len(p) - 199 for p in pieces], pieces]
    bundles = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 1000]) for c in columns], names=["g", "anchor", "block", "windows", "piece"]) for k in range(0, 6000, 1000)]
    texts = pa.RecordBatch.from_arrays([pa.array(x) for x in (range(500), [False] * 500, range(500), [" ".join(r.choices(words, k=1300)).encode() for _ in range(500)])], names=["did", "noid", "th", "text"])
    for work in (lambda: list(suffix_dedup._bundles(iter(bundles))), lambda: suffix_dedup._occurrences(texts)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60_000_000, peak
