"""Conversation repair, spelling variants and decontamination against brute-force versions."""

import hashlib
import heapq
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from netloom.llm import _bytes, _shared, conversations, fm_index, ngram_join, queries, spelling

SPACES = " \t\n\x0b\f\r"


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


# conversations


def repaired_by_dijkstra(rows):
    """Least (cost, audit) by a heap over whole paths."""
    show = lambda x: " " if x is None else x
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv] += []
        h = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        convs[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out, after = {}, {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user:", 3: "assistant:"}
    for conv, rs in convs.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rs if r[0] is not None]
        seen, fault = set(), []
        for _, role, text in rs:
            core = text.rstrip(SPACES)
            fault.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        done, heap = set(), [(0, "", 0, 0, ())]
        while True:
            cost, audit, i, s, path = heapq.heappop(heap)
            if (i, s) in done:
                continue
            done.add((i, s))
            if i == len(rs) and s in (0, 3):
                break
            heapq.heappush(heap, (cost + 2, audit + "I", i, after[s], (*path, name[after[s]])))
            if i < len(rs):
                role, text = rs[i][1:]
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s, path))
                if fault[i] not in ("blank", "duplicate"):
                    more = int(fault[i] == "truncated")
                    to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(s)
                    if to is not None:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*path, f"{role}:{text}")))
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, after[s], (*path, name[after[s]] + text)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(path).encode()).hexdigest())
    return out


def odd_conversations():
    rng = random.Random(3)
    texts = ["Hi.", "ok", "Yes!", "  ", "", "No?", "same.", "x. \n", None, "é…", "long " * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), rng.choice([None, 0, 1, 2, 3, 4, 5, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(90)]
    rows += [(20, i, rng.choice(roles[:3]), f"{rng.choice(texts[:8])} {i % 37}.") for i in range(400)]  # a long one
    return rows + [(21, 5, "user", "same.")] * 30 + [(22, i, "user", "again.") for i in range(40)]


@pytest.mark.parametrize("segment", [4096, 1, 3])
def test_repairs(spark, monkeypatch, segment):
    """Whole conversations, and conversations cut into many segments: nulls in any column, ties of turn, copies, unknown roles."""
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, seg string, copies int")
    got = {r[0]: tuple(r[1:]) for r in conversations.repaired_conversations(conversations.damaged(table)).collect()}
    assert got == repaired_by_dijkstra(rows)


def test_repairs_of_an_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired_conversations(conversations.damaged(table)).collect() == []


def test_op11(spark):
    got = queries.QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert {r["conv_id"]: tuple(r[1:]) for r in got.collect()} == repaired_by_dijkstra(rows)


# spelling


def variants_by_deletions(rows):
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    same, near, form = defaultdict(set), defaultdict(set), {}
    for w in words:
        for k in range(len(w)):
            v = w[:k] + w[k + 1 :]
            same[k, v].add(w)
            if v in words:
                near[w].add(v)
                near[v].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def spelled():
    rng = random.Random(5)
    stems = ["aabbaabb", "colours", "äöüßäöüß", "aaaaaaaa", "abababab", "straßen×÷", "b" * 3000]
    words = list(stems)
    for s in stems:
        for _ in range(14):
            w = list(rng.choice(words[-9:] if len(s) < 100 else [s]))
            for _ in range(rng.choice([1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = rng.choice(["a", "b", "", "ÿ", "ö"])
            words.append("".join(w))
    rows = [(i, " ".join(rng.choices(words, k=40)) + "\n" + rng.choice(words).upper() + ". 12") for i in range(60)]
    rows += [(1000 + i, " ".join([words[0]] * 50 + [words[1]] * 30)) for i in range(20)]
    return rows + [(None, None), (None, words[1]), (7, ""), (8, "12 34"), (0, rows[0][1])]


@pytest.mark.parametrize("bucket", [1 << 21, 100])
def test_variants(spark, monkeypatch, bucket):
    """Runs of letters, Latin-1 letters, very long words, nulls, repeated rows; with buckets split down to single places as well."""
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    monkeypatch.setattr(spelling, "CELLS", bucket)
    rows = spelled()
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, n long, word string, size int").repartition(3)
    want = variants_by_deletions(rows)
    assert {r["word"]: tuple(r[1:]) for r in spelling.variants(table).collect()} == want
    assert max(v[3] for v in want.values()) > 5 and any(v[0] for v in want.values())
    pairs = spelling.near_pairs(spelling.vocabulary(table)).collect()
    assert len({frozenset(p[:2]) for p in pairs}) == len(pairs) == sum(v[3] for v in want.values()) // 2


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op12(spark):
    got = queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert {r["word"]: tuple(r[1:]) for r in got} == variants_by_deletions(rows)


def test_variants_store_no_buckets(spark, monkeypatch):
    """Rows of buckets are stored only where buckets are split."""
    stored = []
    monkeypatch.setattr(spelling, "store", lambda df, name: stored.append(name) or _shared.store(df, name))
    rows = spelled()
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["word"]: tuple(r[1:]) for r in got} == variants_by_deletions(rows)
    assert stored[:3] == ["vocabulary", "large", "near"] and set(stored[3:]) == {"roots"}


def test_variants_whose_keys_coincide(spark, monkeypatch):
    dealt = spelling._dealt
    monkeypatch.setattr(spelling, "_dealt", lambda ranges: dealt(ranges).withColumn("key", spelling.F.col("key") % 2))
    rows = spelled()
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["word"]: tuple(r[1:]) for r in got} == variants_by_deletions(rows)


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_full_bucket_and_of_a_part_of_texts():
    """150,000 words of 13 letters, and 2 MB of text; they took 103 and 62 MB."""
    words = sorted({"".join(w) for w in np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), (150_000, 13)).tolist()})
    columns = {"length": 13, "lo": 0, "hi": 7, "key": 5, "n": 1, "size": 13}
    batches = [pa.RecordBatch.from_pydict({c: pa.array(np.full(len(w), v)) for c, v in columns.items()} | {"word": pa.array(w)}) for w in (words[k : k + 1000] for k in range(0, len(words), 1000))]
    assert peak_mb(lambda: [spelling._pairs(c) for c in spelling._chunks(iter(batches))]) < 75
    buf, offs = _bytes.column(pa.array([" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]))
    lo, hi, part, o = next(_bytes.parts(buf, offs))
    assert peak_mb(lambda: spelling.altered(part, o, list(range(lo, hi)), 7)) < 40


# decontamination


def words_of(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower(text or ""))


def hits_by_windows(docs, items, n):
    out = []
    for i, text in docs:
        w, hit, names = words_of(text), set(), set()
        for item, phrase in items:
            p = words_of(phrase)
            for k in range(max(1, len(p) - n + 1)) if p else ():
                x = p[k : k + n]
                for j in range(len(w) - len(x) + 1):
                    if w[j : j + len(x)] == x:
                        hit |= set(range(j, j + len(x)))
                        names.add("" if item is None else str(item))
        out.append((i, len(w), tuple(sorted(hit)), tuple(sorted(names))))
    return sorted(out, key=repr)


ITEMS = [(1, "a b a b a b a b"), (2, "the quick brown fox jumps over the lazy dog and runs"), (10, "ONE"), (None, "A-b c"), (3, None), (4, ""), (5, "..."), (6, "the quick brown fox jumps over the lazy dog and runs"), (7, "never in here at all x y z u v w"), (8, "é è 漢 字")]
DOCS = [
    (0, "a b a b a b a b a b a b c"), (1, "x The quick brown FOX jumps over the lazy dog, and runs away"), (2, None), (3, ""), (4, "... !!"), (5, "one"), (5, "one"), (None, "a b c one é è 漢 字 one"), (6, "a b a b a b a b " * 50),
    (7, "é è 漢 字" * 3), (8, "a b a b a b"), (9, "lone " * 2000 + "one"), (10, "b a b a b a b a b"),
]


@pytest.mark.parametrize(("words", "block"), [(1 << 20, 1 << 17), (20, 3), (1, 1)])
def test_contamination(spark, monkeypatch, words, block):
    """One shard and many, one block of phrases and many; overlapping and touching occurrences, equal items, nulls, repeated rows."""
    monkeypatch.setattr(fm_index, "SHARD_WORDS", words)
    monkeypatch.setattr(fm_index, "BLOCK", block)
    docs = spark.createDataFrame([(*d, 1, "s") for d in DOCS], "doc_id long, text string, shard int, spans string")
    items = spark.createDataFrame([(*d, 1) for d in ITEMS], "item_id long, text string, words int")
    got = [(r["doc_id"], r["n_words"], tuple(j for s in r["spans"] for j in range(s["b"], s["e"])), tuple(r["items"])) for r in fm_index.contamination(docs, items).collect()]
    assert sorted(got, key=repr) == hits_by_windows(DOCS, ITEMS, 10)
    clean = {(r["doc_id"], r["text"]) for r in fm_index.decontaminate(docs, items).select("doc_id", "text").collect()}
    assert {(5, ""), (2, None), (1, "x  away"), (8, "a b a b a b"), (9, "lone " * 2000)} <= clean


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert fm_index.contamination(docs.limit(0), items).collect() == []
    assert {len(r["spans"]) + len(r["items"]) for r in fm_index.contamination(docs, items).collect()} == {0}


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(1)
    for size, kinds in ((1, 1), (50, 2), (400, 3), (300, 200)):
        words = rng.integers(1, 1 << 62, kinds).astype(np.uint64)[rng.integers(0, kinds, size)]
        counts = np.array([size // 3, 0, size - size // 3])
        made = fm_index.build(words, counts)
        fm = fm_index.FMIndex(**{k: v.tobytes() for k, v in made.items()})
        for length in (1, 2, 5):
            want = [words[j : j + length] for j in range(size - length + 1) if j >= counts[0] or j + length <= counts[0]]
            if not want:
                continue
            p = want[int(rng.integers(len(want)))]
            who, lo, hi = fm.count(p[None], np.array([length]))
            at = fm.locate(np.arange(lo[0], hi[0]))
            places = sorted(x - (x > counts[0]) * 2 for x in at.tolist())
            assert places == [j for j in range(size - length + 1) if (words[j : j + length] == p).all() and (j >= counts[0] or j + length <= counts[0])]


def test_long_words_have_their_own_hashes():
    """A polynomial modulo 2**64 gives such words and their complements one hash."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer((word + other).encode(), np.uint8)
        h = _bytes.word_hashes(data, np.array([0, len(word)]), np.array([len(word), 2 * len(word)]))
        assert h[0] != h[1]
    data = np.frombuffer(b"ABCDEFGHIJKabcdefghijk", np.uint8)
    assert len(set(_bytes.word_hashes(data, np.array([0, 11]), np.array([11, 22])).tolist())) == 1


# sets of one hash


def test_sets_of_one_hash_stay_apart(spark):
    """Where two different sets have one first hash, their classes are named by both hashes."""
    members = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 7), (2, 6), (None, None)], "cid long, alt long")
    assert ngram_join.shared_hashes(members).tolist() == [2]
    vals, offs = np.array([3, 4, 5], np.uint64), np.array([0, 1, 3])
    one, both = ngram_join.signatures(vals, offs)
    assert ngram_join.identity(vals, offs, np.array([one[1]])).tolist() == [one[0], both[1]]
    assert ngram_join.identity(vals, offs, np.zeros(0, np.int64)).tolist() == one.tolist()


def test_complementary_words_are_not_linked(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())], "doc_id long, text string")
    got = {r["did"]: r["component_id"] for r in ngram_join.near_duplicates(docs, 4, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_bitmaps_of_sets_bound_their_difference():
    from netloom.llm import ngram_join as J

    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (2, 40, 300, 5000)]
    sets += [np.sort(np.concatenate([s[: len(s) - len(s) // 20], r.integers(0, 1 << 62, len(s) // 20, dtype=np.uint64)])) for s in sets]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = np.unpackbits(J.parities(np.concatenate(sets), at).view(np.uint8), axis=1)
    assert bits.shape == (len(sets), J.PARITY)
    for a, x in zip(sets, bits, strict=True):
        for b, y in zip(sets, bits, strict=True):
            assert (x != y).sum() <= len(np.setxor1d(a, b))
    assert (bits[1] != bits[2]).sum() > 100


def test_bitmaps_rule_out_pairs_of_large_sets(spark):
    from netloom.llm import ngram_join as J

    r = np.random.default_rng(5)
    draw = lambda n: r.integers(0, 1 << 62, n, dtype=np.uint64)
    base = draw(4000)
    sets = {1: base, 2: np.concatenate([base, draw(200)]), 3: draw(4000), 4: np.concatenate([base[:2500], draw(1700)]), 5: np.concatenate([base, draw(9000)])}
    join = object.__new__(J._Join)
    join.percent = 85
    join.bits = spark.createDataFrame([(i, len(x), J.bitmap(x).tolist()) for i, x in sets.items()], "cid long, n long, bits array<long>")
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (2, 3, 2), (1, 4, 1), (2, 4, 4), (1, 5, 1)], "a long, b long, lead long")
    assert {len(J.bitmap(x)) for x in sets.values()} == {64, 128, 256}
    assert {(x["a"], x["b"]) for x in join.likely(pairs).collect()} == {(1, 2), (1, 5)}  # 1 and 5 are too unlike in size to have their bitmaps compared


def test_marked_texts_are_all_found(spark):
    from netloom.llm import ngram_join as J

    rows = spark.range(0, 3000, 1, 3).selectExpr("xxhash64(id) AS th", "id")
    test = J.marked(rows.where("id % 30 = 0"))
    got = {r["id"] for r in rows.where(test("th")).select("id").collect()}
    assert {i for i in range(0, 3000, 30)} <= got and len(got) < 110
