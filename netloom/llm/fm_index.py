"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of whole documents of about SHARD_WORDS words. Its words become ids, a separator follows each document, and the index
keeps the Burrows-Wheeler transform as a wavelet matrix (one bit plane for each bit of the ids), the number of each word, and every
SAMPLE-th text position of the suffix order. Test phrases are searched backwards, a word a step, all phrases of a block together; the rows
found walk back to a sampled position, which gives the place; places of one document merge into removal spans. The index is a table in the
shared folder, so it serves any number of phrase blocks and test sets, and a lost executor loses nothing of it.

Words are maximal runs of letters, digits and characters beyond ASCII, A-Z read as a-z. A phrase is `n` consecutive words of an item; an item
of fewer words is one phrase, an item without words none. Separators end every match, so no phrase crosses documents. A null text has
no words; empty texts, and texts without words, give rows without spans. A document is never cut, so a very long text makes a shard of its
own. Repeated rows are searched row by row. Equal phrases of several items are one search that counts for each of them, and equal item
ids are one item; a null item id is the empty string. Words are told apart by 64-bit hashes. An empty table gives no rows, and an
empty test set rows without spans. Only doc_id, text and item_id are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import _bytes as B
from netloom.llm._shared import arrow_map, discard, store, tune

#: Words of a shard, text positions between samples, and phrases that one search takes along (a block's broadcast is 80 bytes a phrase and the ids).
SHARD_WORDS, SAMPLE, BLOCK = 1 << 20, 8, 1 << 17
#: Words of a phrase in the query.
WINDOW = 10
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] or A-Z, over UTF-8 bytes.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True

INDEX = "shard long, ids array<long>, starts binary, vocab binary, counts binary, planes binary, marks binary, samples binary"
FOUND = "shard long, row int, doc_id long, n_words long, spans array<struct<b:long,e:long>>, items array<string>"


def suffix_order(text: np.ndarray, n_docs: int) -> np.ndarray:
    """Suffix array of ids in which 0 is a separator; separators are different from each other, in text order. Prefix doubling from
    three words on, over those suffixes only that are not told apart yet."""
    n = len(text)
    rank = text + (n_docs - 1)
    ends = np.flatnonzero(text == 0)
    rank[ends] = np.arange(n_docs)
    bits = int(rank.max()).bit_length()
    ahead = lambda h: np.concatenate([rank[h:], np.zeros(min(h, n), rank.dtype)])[:n]
    depth = 3 if 3 * bits < 63 else 2
    key = (rank << bits) | ahead(1)
    if depth == 3:
        key = (key << bits) | ahead(2)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    lone = new & np.append(new[1:], True)
    at = np.flatnonzero(~lone)
    while len(at):
        who = order[at]
        key = rank[who] * n + rank[who + depth]
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[at] = who
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits in 64-bit words, the first bit lowest, with a word of room behind."""
    out = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
    b = np.packbits(bits, bitorder="little")
    out[: len(b)] = b
    return out.view("<u8")


class Ranks:
    """Ones before a position, of planes of packed bits."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones, axis=-1) - ones

    def ones(self, plane: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[plane][w] + np.bitwise_count(self.words[plane][w] & mask)

    def bit(self, plane: int, i: np.ndarray) -> np.ndarray:
        return ((self.words[plane][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def build(hashes: np.ndarray, n_words: np.ndarray) -> dict[str, np.ndarray]:
    """The index of documents whose word hashes lie one after another."""
    vocab, code = np.unique(hashes, return_inverse=True)
    n_docs = len(n_words)
    text = np.zeros(len(code) + n_docs, np.int64)
    starts = np.cumsum(n_words + 1) - (n_words + 1)
    is_word = np.ones(len(text), bool)
    is_word[starts + n_words] = False
    text[is_word] = code + 1
    order = suffix_order(text, n_docs)
    bwt = text[order - 1]
    bits = max(1, len(vocab).bit_length())
    planes = []
    for level in range(bits - 1, -1, -1):
        one = (bwt >> level & 1).astype(bool)
        planes.append(packed(one))
        bwt = np.concatenate([bwt[~one], bwt[one]])
    # a document's first word is sampled as well: nobody walks back over a separator
    sampled = np.zeros(len(text), bool)
    sampled[::SAMPLE] = True
    sampled[starts] = True
    mark = sampled[order]
    return {"starts": np.append(starts, len(text)), "vocab": vocab, "counts": np.bincount(text, minlength=len(vocab) + 1), "planes": np.stack(planes), "marks": packed(mark), "samples": order[mark].astype("<u4" if len(text) < 1 << 32 else "<u8")}


class FMIndex:
    def __init__(self, starts: bytes, vocab: bytes, counts: bytes, planes: bytes, marks: bytes, samples: bytes):
        self.starts, self.vocab = np.frombuffer(starts, "<i8"), np.frombuffer(vocab, "<u8")
        count = np.frombuffer(counts, "<i8")
        self.less = np.cumsum(count) - count
        n = int(self.starts[-1])
        self.bits = max(1, len(self.vocab).bit_length())
        self.planes = Ranks(np.frombuffer(planes, "<u8").reshape(self.bits, -1))
        self.zeros = [n - int(self.planes.ones(k, np.array([n]))[0]) for k in range(self.bits)]
        self.marks, self.samples = Ranks(np.frombuffer(marks, "<u8")[None]), np.frombuffer(samples, "<u4" if n < 1 << 32 else "<u8").astype(np.int64)
        # where each id's run begins below the last plane, whose order is that of the reversed bits
        flipped, codes = np.zeros(len(count), np.int64), np.arange(len(count))
        for k in range(self.bits):
            flipped |= (codes >> k & 1) << (self.bits - 1 - k)
        by = np.argsort(flipped)
        self.begin = np.zeros(len(count), np.int64)
        self.begin[by] = np.cumsum(count[by]) - count[by]
        self.n = n

    def step(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The row of `code` followed by what row stands for: less[code] and the occurrences of code above."""
        at = row
        for k in range(self.bits):
            ones = self.planes.ones(k, at)
            at = np.where(code >> (self.bits - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return self.less[code] + at - self.begin[code]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer."""
        at, code = row, np.zeros(len(row), np.int64)
        for k in range(self.bits):
            one, ones = self.planes.bit(k, at), self.planes.ones(k, at)
            code = code << 1 | one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return self.less[code] + at - self.begin[code]

    def count(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases (a row of word hashes each, right-aligned) those that occur, with their first and end row in suffix order."""
        width = phrases.shape[1]
        code = np.searchsorted(self.vocab, phrases)
        there = len(self.vocab) > 0
        known = (self.vocab[np.minimum(code, len(self.vocab) - 1)] == phrases) if there else np.zeros(phrases.shape, bool)
        known |= np.arange(width) < (width - length)[:, None]
        who = np.flatnonzero(known.all(axis=1))
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.n)
        code += 1
        for j in range(width - 1, -1, -1):
            on = np.flatnonzero(length[who] > width - 1 - j)
            if not len(on):
                break
            c = code[who[on], j]
            lo[on], hi[on] = self.step(c, lo[on]), self.step(c, hi[on])
            keep = lo < hi
            who, lo, hi = who[keep], lo[keep], hi[keep]
        return who, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        out, steps = np.empty(len(row), np.int64), 0
        left = np.arange(len(row))
        while len(left):
            here = self.marks.bit(0, row)
            out[left[here]] = self.samples[self.marks.ones(0, row[here])] + steps
            left, row, steps = left[~here], self.back(row[~here]), steps + 1
        return out


def hashed_words(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, words of each row and hashes of the words, of parts of a text column."""
    buf, offs = B.column(arr)
    for lo, hi, b, o in B.parts(buf, offs):
        start, end, row = B.words(b, o, INSIDE)
        yield lo, np.bincount(row, minlength=hi - lo), B.word_hashes(b, start, end)


def index(docs: DataFrame) -> DataFrame:
    """The stored index of documents: one row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        counts, hashes, held, number = [], [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def shard() -> pa.RecordBatch:
            made = build(np.concatenate(hashes), np.concatenate(counts))
            cells = {"shard": pa.array([task + number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64()))}
            return pa.RecordBatch.from_pydict(cells | {k: pa.array([v.tobytes()], pa.binary()) for k, v in made.items()})

        for b in batches:
            all_ids = b.column(0).to_pylist()
            for lo, n, h in hashed_words(b.column(1)):
                ids += all_ids[lo : lo + len(n)]
                counts.append(n)
                hashes.append(h)
                held += len(h) + len(n)
                if held >= SHARD_WORDS:
                    yield shard()
                    ids, counts, hashes, held, number = [], [], [], 0, number + 1
        if ids:
            yield shard()

    return store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "fm_index")


def phrases(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """item, words (hashes, in order) of every phrase of every item, stored."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        names, found = [], []
        ids = b.column(0).to_pylist()
        for lo, count, h in hashed_words(b.column(1)):
            at = 0
            for i, c in enumerate(count.tolist()):
                own = h[at : at + c].view(np.int64)
                at += c
                if c:
                    names += [ids[lo + i]] * max(1, c - n + 1)
                    found += list(np.lib.stride_tricks.sliding_window_view(own, min(n, c)))
        if not names:
            return None
        offs = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.RecordBatch.from_pydict({"item": pa.array(names, pa.string()), "words": pa.ListArray.from_arrays(offs, np.concatenate(found))})

    return store(arrow_map(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text"), run, "item string, words array<long>").distinct(), "phrases")


def search(shards: DataFrame, block: list, n: int) -> DataFrame:
    """FOUND of every document of the index, for one block of phrases."""
    names = sorted({r["item"] for r in block})
    number = {x: i for i, x in enumerate(names)}
    wanted: dict[tuple, list[int]] = {}
    for r in block:
        wanted.setdefault(tuple(r["words"]), []).append(number[r["item"]])
    table, length = np.zeros((len(wanted), n), np.int64), np.array([len(w) for w in wanted], np.int64)
    for i, w in enumerate(wanted):
        table[i, n - len(w) :] = w
    many = np.array([len(v) for v in wanted.values()], np.int64)
    owners = np.array([x for v in wanted.values() for x in v], np.int64)
    sent = shards.sparkSession.sparkContext.broadcast((table.view(np.uint64), length, np.cumsum(many) - many, many, owners, names))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table, length, first, many, owners, names = sent.value
        for r in b.to_pylist():
            fm, n_docs = FMIndex(*(r[c] for c in ("starts", "vocab", "counts", "planes", "marks", "samples"))), len(r["ids"])
            who, lo, hi = fm.count(table, length)
            rep = np.repeat(np.arange(len(who)), hi - lo)
            rows = np.arange(len(rep)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[rep]
            pos, phrase = fm.locate(rows), who[rep]
            # spans: where the cover begins and ends; none goes over a separator
            cover = np.zeros(fm.n + 1, np.int64)
            np.add.at(cover, pos, 1)
            np.add.at(cover, pos + length[phrase], -1)
            hit = np.cumsum(cover)[: fm.n] > 0
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            doc = np.searchsorted(fm.starts, begin, "right") - 1
            cut = np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)
            pairs = np.unique((np.searchsorted(fm.starts, pos, "right") - 1) * len(length) + phrase)
            at, ph = pairs // max(1, len(length)), pairs % max(1, len(length))
            own = owners[np.repeat(first[ph], many[ph]) + np.arange(many[ph].sum()) - np.repeat(np.cumsum(many[ph]) - many[ph], many[ph])]
            each = np.unique(np.repeat(at, many[ph]) * max(1, len(names)) + own)
            took = np.searchsorted(each // max(1, len(names)), np.arange(n_docs + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(begin - fm.starts[doc]), pa.array(end - fm.starts[doc])], ["b", "e"])
            labels = pa.array(names, pa.string()).take(pa.array(each % max(1, len(names)))) if names else pa.array([], pa.string())
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(np.full(n_docs, r["shard"])), "row": pa.array(np.arange(n_docs, dtype=np.int32)), "doc_id": pa.array(r["ids"], pa.int64()), "n_words": pa.array(np.diff(fm.starts) - 1),
                "spans": pa.ListArray.from_arrays(cut, spans), "items": pa.ListArray.from_arrays(took, labels),
            })

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from run(b.slice(i, 1))

    return shards.mapInArrow(every, FOUND)


def merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["b"], s["e"])):
        if out and s["b"] <= out[-1]["e"]:
            out[-1]["e"] = max(out[-1]["e"], s["e"])
        else:
            out.append(dict(s))
    return out


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """shard, row, doc_id, n_words, spans (runs of hit words, [b, e)) and items (sorted) of every document. Phrases are searched in blocks of
    about BLOCK, each block a pass over the index; what a document has in several blocks is put together by its place in the index."""
    shards, wanted = index(docs), phrases(items, n)
    blocks = -(-wanted.count() // BLOCK)
    parts = [search(shards, wanted.where(F.expr(f"pmod(xxhash64(item, words), {blocks}) = {k}")).collect(), n) for k in range(blocks)] or [search(shards, [], n)]
    if blocks < 2:
        return parts[0]
    found = parts[0]
    for k, p in enumerate(parts[1:], 1):
        found = found.unionByName(p.where("size(spans) > 0"))
    found = found.groupBy("shard", "row", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        at = b.schema.get_field_index("spans")
        return b.set_column(at, b.schema.field(at), pa.array([merged(s) for s in b.column(at).to_pylist()], b.schema.field(at).type))

    return arrow_map(found, run, FOUND)


def cut_words(text: str | None, spans: list[dict]) -> str | None:
    """The text without the bytes from the first to the last word of each span."""
    if text is None or not spans:
        return text
    data = text.encode()
    start, end, _ = B.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), INSIDE)
    keep, at = [], 0
    for s in spans:
        keep.append(data[at : start[s["b"]]])
        at = end[s["e"] - 1]
    return b"".join([*keep, data[at:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """`docs` with the removal spans cut out of their texts; documents without a span are not touched, and all rows stay."""
    key = ["_fm_id", "_fm_th"]
    cols = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(cols)], F.col("doc_id").cast("long").alias("_fm_id"), F.xxhash64("text").alias("_fm_th"))
    # ids may repeat: the index gets a number for each different text of an id, and its spans go to all rows that have both
    some = store(docs.select(F.col("doc_id").cast("long").alias("_fm_id"), F.xxhash64("text").alias("_fm_th"), "text").dropDuplicates(key).withColumn("doc_id", F.monotonically_increasing_id()), "texts")
    hits = contamination(some, items, n).where("size(spans) > 0").select("doc_id", "spans")
    hits = store(hits.join(some.select("doc_id", *key), "doc_id").drop("doc_id"), "hits")
    name = f"_k{cols.index('text')}"
    dirty = rows.alias("r").join(hits.alias("h"), F.expr("r._fm_id <=> h._fm_id AND r._fm_th = h._fm_th")).select("r.*", "h.spans")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = b.schema.get_field_index(name)
        new = pa.array([cut_words(x, s) for x, s in zip(b.column(t).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([new if i == t else b.column(i) for i in range(len(cols))], names=[f"_k{i}" for i in range(len(cols))])

    schema = rows.drop(*key).schema
    clean = rows.alias("r").join(hits.alias("h"), F.expr("r._fm_id <=> h._fm_id AND r._fm_th = h._fm_th"), "left_anti").drop(*key)
    out = clean.unionByName(arrow_map(dirty.drop(*key), run, schema))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(cols)])


def op13_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document against all of `benchmark`; a document without a
    hit has the digest of the empty string."""
    tune(spark)
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["b"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


#: The same by joining windows as strings.
ORACLE = r"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS x FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lens WHERE len(w) >= k)),
occ AS (SELECT doc_id, p.k, i, item FROM places p JOIN win USING (x)),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""
