"""Spelling variants: words of one edit's distance, by merging the light subtrees of tries with one character skipped or replaced.

Words are counted over whole texts. Each near pair agrees outside one place, so the words of a length L (with those of L + 1 as longer
partners) are dealt to buckets: a bucket (lo, hi, key) holds words with an equal beginning of lo characters and an equal end of
max(0, L - hi), and is answerable for pairs whose longest common beginning is in [lo, hi). Buckets beyond BUCKET characters are split at the
middle of their range, which makes the equal part longer, until they are small; a range of one place holds at most an alphabet of words of
length L and its square of longer ones, so no hot beginning or end stays large, and each pair has exactly one bucket.

The sorted words of a bucket are its trie. At each branching node the child with most words is heavy and the others light; a word is in a light child
O(log n) times. Light words are merged: with their character replaced by the heavy one, with it skipped, with the heavy one put in
before it, and among each other with it skipped. Where the end of an altered word coincides with the end of a word, the two are near.
Ends are looked up by hashes and then compared letter by letter.

A null text has no words; a null doc_id is the empty string in the rule that alters words. Empty texts and texts without letters give nothing.
Very long words are like others. Repeated rows count again. Ties of count go to the smallest word. An empty table gives no rows. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import _bytes as B
from netloom.llm._shared import discard, store, tune

#: Shortest word, fewest occurrences, and how many times as frequent a form is, in the query; one run of RARE loses a character.
LENGTH, OCCURRENCES, FACTOR, RARE = 7, 2, 10, 31
#: Characters of a bucket's words, of the words that one kernel call takes, and different words that a task counts before it passes them on.
BUCKET, CELLS, DISTINCT = 1 << 21, 1 << 21, 1 << 18
#: Longest word for the byte tables; longer ones are hashed and compared on their own.
WIDE = 64
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
R, R_INV = B.R, B.R_INV


def runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of [A-Za-zÀ-ÿ], which in UTF-8 are letters and the pairs C3 80 to C3 BF."""
    inside = LETTERS[buf]
    lead = np.flatnonzero(buf == 0xC3)
    inside[lead] = inside[lead + 1] = True
    return B.words(np.where(inside, np.uint8(1), np.uint8(0)), offs, np.arange(256) == 1)


def run_crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, ids: list) -> np.ndarray:
    """crc32 of `<doc_id>:<run>`, byte by byte over all runs at once."""
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) ^ 0xFFFFFFFF for i in ids], np.uint32)
    crc, n = before[row], end - start
    by = np.argsort(-n, kind="stable")
    s, m, state = start[by], n[by], crc[by]
    live = len(by)
    for k in range(min(int(m[0]), WIDE) if live else 0):
        live = int(np.searchsorted(-m, -k, "left"))
        state[:live] = CRC[(state[:live] ^ buf[s[:live] + k]) & 255] ^ (state[:live] >> 8)
    for i in range(int(np.searchsorted(-m, -WIDE, "left"))):
        state[i] = zlib.crc32(buf[s[i] + WIDE : s[i] + m[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    crc[by] = state
    return crc ^ np.uint32(0xFFFFFFFF)


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans, which ascend and do not overlap."""
    n = end - start
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    data = buf[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], np.cumsum(n)])), pa.py_buffer(data))


def altered(buf: np.ndarray, offs: np.ndarray, ids: list, shortest: int) -> list[pa.Array]:
    """The words of some texts that have `shortest` characters or more: runs, some without one character."""
    start, end, row = runs(buf, offs)
    buf = B.FOLD[buf]
    begins = np.zeros(len(buf) + 1, np.int32 if len(buf) < 1 << 31 else np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=begins[1:])
    size = begins[end] - begins[start]
    long = np.flatnonzero(size >= shortest)
    start, end, row, size = start[long], end[long], row[long], size[long]
    crc = run_crcs(buf, start, end, row, ids)
    lost = crc % RARE == 0
    out = [strings(buf, start[~lost], end[~lost])]
    cut = []
    for i in np.flatnonzero(lost & (size > shortest)).tolist():
        w = buf[start[i] : end[i]].tobytes().decode()
        k = int(crc[i]) % len(w)
        cut.append(w[:k] + w[k + 1 :])
    return [*out, pa.array(cut, pa.large_string())]


def vocabulary(docs: DataFrame, shortest: int = LENGTH, fewest: int = OCCURRENCES) -> DataFrame:
    """(word, n, size) of all documents, stored: n occurrences, size characters. Tasks count what they read before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None

        def add(words: list[pa.Array]) -> pa.Table:
            found = [pc.value_counts(w) for w in words if len(w)]
            new = pa.concat_tables([pa.table({"word": f.field("values"), "n": f.field("counts")}) for f in found])
            return new if total is None else pa.concat_tables([total, new])

        for b in batches:
            ids = b.column(0).to_pylist()
            buf, offs = B.column(b.column(1))
            for lo, hi, part, o in B.parts(buf, offs):
                words = altered(part, o, ids[lo:hi], shortest)
                if not any(len(w) for w in words):
                    continue
                total = add(words)
                if total.num_rows > DISTINCT:
                    total = total.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                    if total.num_rows > DISTINCT // 2:
                        yield from total.cast(SCHEMA).to_batches(20_000)
                        total = None
        if total is not None:
            yield from total.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).cast(SCHEMA).to_batches(20_000)

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return store(counted.where(F.col("n") >= fewest).withColumn("size", F.char_length("word")), "vocabulary")


SCHEMA = pa.schema([("word", pa.string()), ("n", pa.int64())])


#: What names a bucket; its key is a hash of the equal part. Words whose keys coincide by chance share a bucket and gain no pair by it.
NAME = ("length", "lo", "hi", "key")


def _dealt(ranges: DataFrame) -> DataFrame:
    """Buckets' rows with a hash of the equal part of the word that their range asks for."""
    tail = F.expr("right(word, greatest(0, length - hi))")
    return ranges.select("length", "lo", "hi", F.xxhash64(F.expr("substring(word, 1, lo)"), tail).alias("key"), "word", "n", "size")


def buckets(words: DataFrame) -> DataFrame:
    """length, lo, hi, key, word, n, size: words in buckets; large ones are split until none is beyond BUCKET. Only rows of buckets that are split
    are stored. Buckets without a pair, which hold one word or none of their length, are left in unless they are large."""
    both = words.withColumn("length", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    mid = F.expr("CAST((length + 1) div 2 AS INT)")
    halves = F.array(F.struct(F.lit(0).alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), (F.col("length") + 1).alias("hi")))
    level = _dealt(both.withColumn("side", F.explode(halves)).select("*", "side.lo", "side.hi"))
    ready = []
    while True:
        load = level.groupBy(*NAME).agg(F.count("*").alias("c"), F.min("size").alias("least"))
        load = load.withColumn("paired", F.expr("c > 1 AND least = length")).where(f"c * (length + 1) > {BUCKET} AND (hi - lo > 1 OR NOT paired)")
        large = store(load.select(*NAME, F.expr("paired AND hi - lo > 1").alias("split")), "large")
        if large.isEmpty():
            ready.append(level)
            break
        ready.append(level.join(large, [*NAME], "left_anti"))
        if large.where("split").isEmpty():
            break
        mid = F.expr("CAST((lo + hi) div 2 AS INT)")
        halves = F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))
        rows = level.join(large.where("split"), [*NAME], "left_semi").withColumn("side", F.explode(halves)).drop("lo", "hi")
        level = store(_dealt(rows.select("*", "side.lo", "side.hi")), "level")
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    return out


def common_beginnings(w: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of `w` (characters, 0 behind the end) with the one before it; -1 where `same` is false."""
    out = np.full(len(w), -1, np.int64)
    if len(w) > 1:
        differ = w[1:] != w[:-1]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), w.shape[1])
        out[1:] = np.where(same[1:], n, -1)
    return out


def near_in_buckets(w: np.ndarray, size: np.ndarray, bucket: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of all near pairs that the buckets answer for, each pair once. Rows are sorted by bucket and word; `w` holds their characters
    as bytes, 0 behind the end; bucket, length, lo and hi are those of each row."""
    n, width = w.shape
    same = np.append([False], bucket[1:] == bucket[:-1])
    lcp = common_beginnings(w, same)
    power, inverse = B.powers(width + 2), B.powers(2, True)[1]
    upto = np.zeros((n, width + 1), np.uint64)
    for k in range(width):
        upto[:, k + 1] = upto[:, k] + np.where(w[:, k] > 0, w[:, k] + np.uint64(1), np.uint64(0)) * power[k]
    whole = upto[:, -1]
    salt = B.mix(bucket.astype(np.uint64) + np.uint64(1))
    table = B.mix(whole ^ salt)
    by = np.argsort(table, kind="stable")
    table = table[by]
    left, right = [], []

    def verify(i: np.ndarray, h: np.ndarray, p: int, skip_i: int, skip_j: int) -> None:
        """Rows whose hash is h, if they agree with row i but for skip_i of its characters and skip_j of theirs at p."""
        key = B.mix(h ^ salt[i])
        at = np.searchsorted(table, key)
        while len(i):
            ok = at < n
            ok[ok] = table[at[ok]] == key[ok]
            i, key, at = i[ok], key[ok], at[ok]
            if not len(i):
                return
            j = by[at]
            fits = (bucket[i] == bucket[j]) & (size[i] - skip_i == size[j] - skip_j)
            f = np.flatnonzero(fits)
            a, b = w[i[f]], w[j[f]]
            m = width - p - max(skip_i, skip_j)
            good = (a[:, :p] == b[:, :p]).all(axis=1) & (a[:, p + skip_i : p + skip_i + m] == b[:, p + skip_j : p + skip_j + m]).all(axis=1)
            left.append(i[f[good]])
            right.append(j[f[good]])
            at = at + 1  # an equal hash of another word may follow

    for p in np.unique(lcp[(lcp >= lo) & (lcp < hi)]).tolist():
        node = np.cumsum(lcp < p) - 1
        head = np.flatnonzero(lcp < p + 1)  # first row of each child
        child = np.cumsum(lcp < p + 1) - 1
        count = np.bincount(child)
        parent = node[head]
        count = np.where(size[head] > p, count, 0)  # a word that ends here is no heavy child
        first = np.append([True], parent[1:] != parent[:-1])
        best = np.maximum.reduceat(count, np.flatnonzero(first))
        heavy = np.full(int(parent[-1]) + 1, -1)
        top = np.flatnonzero(count == best[parent])[::-1]
        heavy[parent[top]] = top
        branches = np.bincount(parent) > 1
        i = np.flatnonzero(branches[node] & (heavy[node] != child) & (lo <= p) & (p < hi))
        if not len(i):
            continue
        h = whole[i]
        before, after = upto[i, p], upto[i, min(p + 1, width)]
        big = (w[head[heavy[node[i]]], p].astype(np.uint64) + np.uint64(1)) if p < width else np.zeros(len(i), np.uint64)
        inner, exact = size[i] > p, size[i] == length[i]
        skipped = before + (h - after) * inverse
        # the heavy character in place of its own
        k = np.flatnonzero(inner & exact)
        verify(i[k], before[k] + big[k] * power[p] + (h[k] - after[k]), p, 1, 1)
        # its own character skipped, where the next one differs from it
        k = np.flatnonzero(inner & ~exact)
        if p + 1 < width:
            k = k[w[i[k], p] != w[i[k], p + 1]]
        verify(i[k], skipped[k], p, 1, 0)
        # the heavy character before its own
        k = np.flatnonzero(exact)
        verify(i[k], before[k] + big[k] * power[p] + (h[k] - before[k]) * R, p, 0, 1)
        # light words among each other, with the character skipped: at most an alphabet of words has an equal rest
        k = np.flatnonzero(inner & exact)
        key = B.mix(skipped[k] ^ B.mix(node[i[k]].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        key, r = key[order], i[k][order]
        step = 1
        while step < len(r):
            f = np.flatnonzero(key[step:] == key[:-step])
            if not len(f):
                break
            a, b = r[f], r[f + step]
            good = (node[a] == node[b]) & (w[a, p] != w[b, p]) & (size[a] == size[b]) & (w[a, p + 1 :] == w[b, p + 1 :]).all(axis=1)
            left.append(a[good])
            right.append(b[good])
            step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _starts(chunk: dict) -> np.ndarray:
    """First rows of the buckets of a chunk that has rows."""
    other = np.zeros(len(chunk["key"]) - 1, bool)
    for c in NAME:
        other |= chunk[c][1:] != chunk[c][:-1]
    return np.append([0], np.flatnonzero(other) + 1)


def _paired(chunk: dict) -> dict | None:
    """The buckets of more than one word and with words of their length, and `bucket`, their number for each row; None if there are none."""
    first = _starts(chunk)
    count = np.diff(np.append(first, len(chunk["key"])))
    good = (count > 1) & (np.minimum.reduceat(chunk["size"], first) == chunk["length"][first])
    keep = np.flatnonzero(np.repeat(good, count))
    if not len(keep):
        return None
    return {c: v.take(pa.array(keep)) if c == "word" else v[keep] for c, v in chunk.items()} | {"bucket": np.repeat(np.arange(int(good.sum())), count[good])}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Whole buckets of about CELLS bytes that may have pairs, whose words are of one class of widths. Words stay in Arrow."""
    held: list[pa.RecordBatch] = []
    cells = 0

    def kind(length: np.ndarray) -> np.ndarray:
        return np.ceil(np.log2(length + 1.0))

    def cut(last: bool) -> Iterator[dict]:
        """Chunks of what is held, which is then the last bucket, as it may go on in the next batch."""
        nonlocal held, cells
        rows = pa.Table.from_batches(held).combine_chunks()
        chunk = {c: rows.column(c).to_numpy() for c in (*NAME, "n", "size")} | {"word": rows.column("word").cast(pa.large_string()).combine_chunks()}
        ends, kinds, at = [*_starts(chunk)[1:].tolist(), *[rows.num_rows] * last], kind(chunk["length"]), 0
        for e in ends:
            if e == ends[-1] or kinds[e] != kinds[e - 1] or (e - at) * (chunk["length"][e - 1] + 1) >= CELLS:
                part = _paired({c: v[at:e] for c, v in chunk.items()})
                if part is not None:
                    yield part
                at = e
        held = rows.slice(at).to_batches()
        cells = (rows.num_rows - at) * (int(chunk["length"][-1]) + 1)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        length = b.column(b.schema.get_field_index("length")).to_numpy()
        cells += int(length.max() + 1) * len(length)
        kinds = kind(np.array([held[0].column("length")[0].as_py(), length[0], length[-1]]))
        if cells >= CELLS or kinds.min() < kinds.max():
            yield from cut(False)
    if held:
        yield from cut(True)


def letters(words: pa.Array) -> np.ndarray:
    """Characters of words as bytes of Latin-1, a row for each word, 0 behind its end."""
    buf, offs = B.column(words)
    lead = buf == 0xC3
    code = buf.copy()
    code[1:][lead[:-1]] += 0x40
    n = np.diff(offs) - np.diff(np.append([0], np.cumsum(lead))[offs])
    w = np.zeros((len(n), int(n.max())), np.uint8)
    w[np.arange(w.shape[1]) < n[:, None]] = code[~lead]
    return w


def _pairs(chunk: dict) -> tuple[np.ndarray, np.ndarray]:
    return near_in_buckets(letters(chunk["word"]), *(chunk[c].astype(np.int64) for c in ("size", "bucket", "length", "lo", "hi")))


def _sorted(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *NAME).sortWithinPartitions(*NAME, "word")


def _named(word: pa.Array, rows: np.ndarray) -> pa.Array:
    return word.take(pa.array(rows)).cast(pa.string())


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, na, nb) of all near pairs of a vocabulary (word, n, size), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            i, j = _pairs(chunk)
            word, n = chunk["word"], chunk["n"]
            yield pa.RecordBatch.from_pydict({"a": _named(word, i), "b": _named(word, j), "na": pa.array(n[i]), "nb": pa.array(n[j])})

    return _sorted(buckets(words)).mapInArrow(run, "a string, b string, na long, nb long")


def near_summary(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n (the most frequent near word; ties: the smallest) of the words that have a near word. What a
    bucket adds to a word is summed up in the task, so no pairs are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            i, j = _pairs(chunk)
            if not len(i):
                continue
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
            word, n = chunk["word"], chunk["n"]
            by = np.lexsort((j, -n[j], i))  # rows of a bucket are in code point order
            i, j = i[by], j[by]
            first = np.flatnonzero(np.append([True], i[1:] != i[:-1]))
            many = np.diff(np.append(first, len(i)))
            i, j = i[first], j[first]
            yield pa.RecordBatch.from_pydict({"word": _named(word, i), "n": pa.array(n[i]), "n_near": pa.array(many), "form": _named(word, j), "form_n": pa.array(n[j])})

    part = _sorted(buckets(words)).mapInArrow(run, "word string, n long, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("x")
    summed = part.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n", "n_near", F.col("x.form").alias("form"), (-F.col("x.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the end of the path over forms, which grows less frequent words into more frequent
    ones and so ends. Each step doubles the path."""
    far = store(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not far.where("moved").isEmpty():
        on = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = store(far.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(far)
        far = new
    return far.select("word", "root")


def variants(docs: DataFrame, shortest: int = LENGTH, fewest: int = OCCURRENCES, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of `docs`."""
    words = vocabulary(docs, shortest, fewest)
    formed = F.col("form_n") >= factor * F.col("n")
    near = near_summary(words).select("word", "n_near", *(F.when(formed, F.col(c)).alias(c) for c in ("form", "form_n")))
    near = store(near, "near")
    out = words.select("word", "n").join(near, "word", "left").join(roots(near.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `documents`."""
    tune(spark)
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
