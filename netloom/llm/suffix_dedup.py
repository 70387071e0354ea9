"""Suffix-array deduplication: removes every byte covered by a WIDTH-byte string that starts in two places.

Suffixes of the whole corpus don't fit one task, so texts are cut by content first. Of each WIDTH-byte window the K-byte string
of smallest hash is its anchor (equal windows have equal anchors at equal places); the windows that share an anchor occurrence
form a block. Blocks are counted by hash: a block that occurs twice is repeated as a whole. Where an anchor is followed
or preceded by different bytes, one copy of each different block goes to the anchor's bundle, and there a suffix array is
built in two stages: suffixes smaller than their successors are sorted directly, the others are induced from them by a scan over
first-byte buckets; adjacent common prefixes of WIDTH bytes then mark the repeated windows.

A bundle holds at most SPREAD blocks of one anchor. An anchor of more different blocks (a passage that very many documents hold) is
first reduced to its windows. Chunks of blocks hold their windows' 64-bit hashes as arrays; each chunk sends its distinct hashes with
counts to a bucket of the hash, the bucket adds them up and answers which occur twice or more; of each such hash the chunks give
two or a few copies to bundles dealt by the hash, where the suffix array compares their bytes; what it confirms goes back to the chunks. So
no bundle grows with the corpus, there is no row for each window, and no pair of places is listed.

Null and empty texts, and texts of fewer than WIDTH bytes, lose nothing; a null doc_id takes part like any other. Repeated rows are
repeats of each other, so all their long enough texts go. A very long text is cut into blocks like any other, whole. The
result does not depend on the order of rows or on ties between anchors: both copies of a window always go. An empty table gives
no rows. Only doc_id and text are read; remove_repeats gives all columns back, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import _bytes as B
from netloom.llm._shared import arrow_map, discard, release, store, tune

WIDTH, K = 200, 32
#: Different blocks of one anchor in a bundle; bytes of a bundle, of whole groups; bytes of text that are cut at once, and of keys that are sorted at once.
SPREAD, BUNDLE, CUT, SORTED = 512, 1 << 18, 1 << 19, 16 << 20
#: Windows of a chunk, and of a bucket of hashes.
CHUNK, BUCKET = 1 << 18, 1 << 20
#: What identifies a row: doc_id (0 for null), whether it is null, and the text's hash.
ROW = ["did", "noid", "th"]


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """min(a[i : i + width]) for each i, by doubling."""
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def blocks(buf: np.ndarray, offs: np.ndarray, width: int = WIDTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor hash, block hash) of each block, in text order; start counts from the row's first byte."""
    n = len(buf)
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    pos = np.arange(n - k + 1)
    gram = B.span_hashes(buf, pos, pos + k, B.BYTE_VALUE)
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | pos.astype(np.uint64)
    at = (sliding_min(key, width - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del key
    ok = np.zeros(n - width + 1, bool)
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if hi - lo >= width:
            ok[lo : hi - width + 1] = True
    begins = ok.copy()
    begins[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    first = np.flatnonzero(begins)
    # the row's first window always begins a block: offsets of rows are no window starts of the row before them
    starts_row = offs[:-1][np.diff(offs) >= width]
    extra = starts_row[~begins[starts_row]]
    if len(extra):
        first = np.sort(np.concatenate([first, extra]))
    stop = np.flatnonzero(~ok)
    nxt = np.append(first[1:], n - width + 1)
    if len(stop):
        s = np.searchsorted(stop, first)
        nxt = np.minimum(nxt, np.where(s < len(stop), stop[np.minimum(s, len(stop) - 1)], n - width + 1))
    count = nxt - first
    row = np.searchsorted(offs, first, "right") - 1
    content = B.span_hashes(buf, first, first + count - 1 + width, B.BYTE_VALUE)
    block = B.mix(content * np.uint64(0x9FB21C651E98DF25) + (at[first] - first).astype(np.uint64) * np.uint64(0x9E6C63D0876A9A63) + count.astype(np.uint64))
    return row, first - offs[row], count, gram[at[first]], block


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first `depth` symbols at least (symbols > 0; the end is smaller than any symbol)."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # smaller than the successor: decided where the run of equal symbols ends
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    run = np.searchsorted(ends, np.arange(n))
    after = np.append(text[ends[:-1] + 1], 0)
    small = (text[ends] < after)[run]
    direct = np.flatnonzero(small)
    padded = np.concatenate([text, np.zeros(depth, text.dtype)])
    wide = np.lib.stride_tricks.sliding_window_view(padded.astype(">u2"), depth)
    step = max(1, SORTED // (2 * depth))
    keys = np.empty(len(direct), f"V{2 * depth}") if len(direct) <= step else None
    if keys is not None:
        rows = np.ascontiguousarray(wide[direct])
        order = direct[np.argsort(rows.view(f"S{2 * depth}").ravel(), kind="stable")]
    else:
        # by first symbol, then each bucket on its own
        pieces, by = [], direct[np.argsort(text[direct], kind="stable")]
        cuts = np.flatnonzero(np.diff(text[by])) + 1
        for part in np.split(by, cuts):
            pieces.append(part[np.argsort(np.ascontiguousarray(wide[part]).view(f"S{2 * depth}").ravel(), kind="stable")])
        order = np.concatenate(pieces)
    top = int(text.max()) + 1
    small_cut = np.searchsorted(text[order], np.arange(top + 1))
    heads: list[list[np.ndarray]] = [[] for _ in range(top)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Larger-than-successor suffixes right before `found`, put at the end of their buckets; those of bucket c come back."""
        prev = found[found > 0] - 1
        prev = prev[~small[prev]]
        sym = text[prev]
        same = prev[sym == c]
        rest, sym = prev[sym != c], sym[sym != c]
        if len(rest):
            o = np.argsort(sym, kind="stable")
            rest, sym = rest[o], sym[o]
            cut = np.flatnonzero(np.diff(sym)) + 1
            for piece in np.split(rest, cut):
                heads[int(text[piece[0]])].append(piece)
        return same

    last = np.array([n - 1])  # the suffix before the end
    heads[int(text[n - 1])].append(last)
    for c in range(top):
        wave = np.concatenate(heads[c]) if heads[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        mine = order[small_cut[c] : small_cut[c + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, c)
    return np.concatenate(out)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Do the suffixes at a[i] and b[i] have `width` symbols in common? Compared in steps, only while equal."""
    live = np.arange(len(a))
    good = np.zeros(len(a), bool)
    padded = np.concatenate([text, np.arange(width, dtype=text.dtype)])
    at = 0
    while len(live) and at < width:
        step = min(8, width - at)
        x, y = a[live] + at, b[live] + at
        same = np.ones(len(live), bool)
        for j in range(step):
            same &= padded[x + j] == padded[y + j]
        live, at = live[same], at + step
    good[live] = True
    return good


def repeated_windows(pieces: list[bytes], counts: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each piece: which of its first `count` windows occur twice or more among all pieces."""
    offs = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in pieces], out=offs[1:])
    text = np.zeros(offs[-1], np.uint16)
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:] = raw
    text += 2
    text[offs[1:] - 1] = 1  # ends of pieces
    window = np.zeros(len(text) + 1, np.int64)
    for o, c in zip(offs[:-1].tolist(), counts, strict=True):
        window[o] += 1
        window[o + c] -= 1
    is_start = np.cumsum(window)[:-1] > 0
    order = suffix_array(text, width)
    order = order[is_start[order]]
    same = common(text, order[:-1], order[1:], width)
    hit = np.zeros(len(text), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [hit[o : o + c] for o, c in zip(offs[:-1].tolist(), counts, strict=True)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    t, i = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    return docs.select(F.coalesce(i, F.lit(0)).alias("did"), i.isNull().alias("noid"), F.xxhash64(t).alias("th"), t.cast("binary").alias("text"), *more)


def _occurrences(b: pa.RecordBatch) -> pa.RecordBatch | None:
    """The ROW columns and blocks of a batch of rows (ROW, text)."""
    buf, offs = B.column(b.column(3))
    out = []
    for lo, hi, x, o in B.parts(buf, offs, CUT):
        row, start, count, anchor, block = blocks(x, o)
        if not len(row):
            continue
        have, first = np.unique(row, return_index=True)
        at = np.append(first, len(row)).astype(np.int32)
        col = lambda v: pa.ListArray.from_arrays(at, pa.array(v))
        take = pa.array(have + lo)
        out.append(pa.RecordBatch.from_pydict({n: b.column(i).take(take) for i, n in enumerate(ROW)} | {"anchor": col(anchor.view(np.int64)), "block": col(block.view(np.int64)), "start": col(start.astype(np.int32)), "windows": col(count.astype(np.int16))}))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None


def occurrences(rows: DataFrame) -> DataFrame:
    """id, did, noid, th and the row's blocks as arrays, stored; one pass over the texts, rows without a window left out."""

    found = arrow_map(rows.select(*ROW, "text"), _occurrences, "did long, noid boolean, th long, anchor array<long>, block array<long>, start array<int>, windows array<smallint>")
    return store(found.withColumn("id", F.monotonically_increasing_id()), "blocks")


def _wanted(rows: DataFrame, ids: DataFrame, kinds: DataFrame) -> DataFrame:
    """(text, want): the texts that hold the copies of blocks that `kinds` names, with the list of these."""
    want = kinds.groupBy("id").agg(F.collect_list(F.struct("anchor", "block", "start", "windows")).alias("want")).join(ids, "id")
    return rows.select(*ROW, "text").join(want, ROW).select("text", "want")


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """(anchor, block, windows, bytes) of each wanted block."""
    for b in batches:
        for text, want in zip(b.column(0), b.column(1), strict=True):
            data = text.as_buffer()
            for w in want.as_py():
                yield w["anchor"], w["block"], w["windows"], data.slice(w["start"], w["windows"] - 1 + WIDTH).to_pybytes()


def _pieces(rows: DataFrame, ids: DataFrame, kinds: DataFrame) -> DataFrame:
    """(anchor, block, windows, piece) of one copy of each of the `kinds`, which name the row and place of that copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _cuts(batches)
        while some := list(itertools.islice(found, 4096)):
            a, k, n, p = zip(*some, strict=True)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(a, pa.int64()), "block": pa.array(k, pa.int64()), "windows": pa.array(n, pa.int32()), "piece": pa.array(p, pa.binary())})

    return _wanted(rows, ids, kinds).mapInArrow(run, "anchor long, block long, windows int, piece binary")


def _bundled(pieces: DataFrame, group: str) -> DataFrame:
    """(anchor, block, lo, hi): the repeated windows of each piece, found by suffix arrays over whole groups."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select(F.col(group).alias("g"), "anchor", "block", "windows", "piece").repartition(parts, "g").sortWithinPartitions("g")
    return rows.mapInArrow(_bundles, "anchor long, block long, lo array<int>, hi array<int>")


def _longs(*columns) -> list[pa.Array]:
    """Each argument, a list of numpy arrays, as an array<long> column."""
    return [pa.ListArray.from_arrays(np.cumsum([0, *map(len, c)]).astype(np.int32), np.concatenate(c) if len(c) else np.zeros(0, np.int64)) for c in columns]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, anchor[], block[], windows[], hashes[]): wanted blocks, about CHUNK windows a row."""
    from pyspark import TaskContext

    held, size, made = [], 0, TaskContext.get().partitionId() << 32

    def row() -> pa.RecordBatch:
        a, k, n, h = zip(*held, strict=True)
        cols = _longs([np.array(a, np.int64)], [np.array(k, np.int64)], [np.array(n, np.int64)], [np.concatenate(h)])
        return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), *cols], ["chunk", "anchor", "block", "windows", "hashes"])

    for anchor, block, n, piece in _cuts(batches):
        held.append((anchor, block, n, _window_hashes(piece, n)))
        size += n
        if size >= CHUNK:
            yield row()
            held, size, made = [], 0, made + 1
    if held:
        yield row()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Rows of equal first column, which stand together, as a list of their values by row."""
    now: list[list] = []
    for b in batches:
        for i in range(len(b)):
            row = [c[i].values.to_numpy(zero_copy_only=False) if isinstance(c, pa.ListArray) else c[i].as_py() for c in b.columns]
            if now and row[0] != now[0][0]:
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def _by_windows(rows: DataFrame, ids: DataFrame, kinds: DataFrame) -> DataFrame:
    """(anchor, block, lo, hi) for anchors of many kinds of block."""
    buckets = int(kinds.agg(F.sum("windows")).first()[0]) // BUCKET + 1
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = store(_wanted(rows, ids, kinds).mapInArrow(_chunks, "chunk long, anchor array<long>, block array<long>, windows array<long>, hashes array<long>"), "chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, hashes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w, n = np.unique(hashes.values.to_numpy(), return_counts=True)
                to = w % buckets
                order = np.argsort(to, kind="stable")
                w, n, to = w[order], n[order], to[order]
                cut = np.flatnonzero(np.diff(to)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(to[np.concatenate([[0], cut])], pa.int64()), pa.array([chunk] * (len(cut) + 1), pa.int64()), *_longs(np.split(w, cut), np.split(n, cut))], ["bucket", "chunk", "w", "n"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the hashes that occur twice or more, the first and the last chunk that have them are asked for copies."""
        for group in _groups(batches):
            w, n = np.concatenate([r[2] for r in group]), np.concatenate([r[3] for r in group])
            who = np.repeat([r[1] for r in group], [len(r[2]) for r in group])
            order = np.lexsort((who, w))
            w, n, who = w[order], n[order], who[order]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            last = np.append(first[1:], len(w)) - 1
            often = np.add.reduceat(n, first) > 1
            pick = np.unique(np.concatenate([first[often], last[often]]))
            pick = pick[np.argsort(who[pick], kind="stable")]
            chunk, at = np.unique(who[pick], return_index=True)
            if len(chunk):
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), *_longs(np.split(w[pick], at[1:]))], ["chunk", "w"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(w, anchor, block, at): the first and the last copy in the chunk of each hash that it was asked for."""
        for b in batches:
            for anchor, block, windows, hashes, asked in zip(*b.columns, strict=True):
                h, n = hashes.values.to_numpy(), windows.values.to_numpy()
                of = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                hit = np.flatnonzero(np.isin(h, asked.values.to_numpy()))
                hit = hit[np.argsort(h[hit], kind="stable")]
                edge = h[hit][1:] != h[hit][:-1]
                hit = np.unique(hit[np.concatenate([[True], edge]) | np.concatenate([edge, [True]])])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[hit], anchor.values.to_numpy()[of[hit]], block.values.to_numpy()[of[hit]], at[hit])], ["w", "anchor", "block", "at"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, w, good in zip(*b.columns, strict=True):
                yes = w.values.to_numpy()
                yes = yes[np.isin(yes, good.values.to_numpy())]
                if len(yes):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), *_longs([yes])], ["chunk", "yes"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, block, windows, hashes, yes in zip(*b.columns, strict=True):
                hit = np.isin(hashes.values.to_numpy(), yes.values.to_numpy())
                a, k, lo, hi = [], [], [], []
                for x, y, h in zip(anchor.as_py(), block.as_py(), np.split(hit, np.cumsum(windows.values.to_numpy())[:-1]), strict=True):
                    if h.any():
                        u, v = runs(h)
                        a.append(x)
                        k.append(y)
                        lo.append(u)
                        hi.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(k, pa.int64()), *_longs(lo, hi)], ["anchor", "block", "lo", "hi"])

    asked = store(chunks.select("chunk", "hashes").mapInArrow(ask, "bucket long, chunk long, w array<long>, n array<long>"), "asked")
    often = asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(add_up, "chunk long, w array<long>")
    often = store(often.groupBy("chunk").agg(F.flatten(F.collect_list("w")).alias("asked")), "often")
    blocks_ = ["anchor", "block", "windows", "hashes"]
    copies = chunks.join(often, "chunk").select(*blocks_, "asked").mapInArrow(place, "w long, anchor long, block long, at long")
    # each copy is a block of one window for the bundle of its hash
    copies = copies.join(kinds.select("anchor", "block", "id", "start"), ["anchor", "block"]).select("id", F.col("w").alias("anchor"), F.xxhash64("block", "at").alias("block"), (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("windows"))
    same = _bundled(_pieces(rows, ids, copies), "anchor").select(F.col("anchor").alias("w")).distinct()
    good = store(same.groupBy(F.pmod("w", F.lit(buckets)).alias("bucket")).agg(F.collect_list("w").alias("good")), "good")
    told = asked.join(good, "bucket").select("chunk", "w", "good").mapInArrow(answer, "chunk long, yes array<long>")
    told = store(told.groupBy("chunk").agg(F.flatten(F.collect_list("yes")).alias("yes")), "told")
    out = chunks.join(told, "chunk").select(*blocks_, "yes").mapInArrow(mark, "anchor long, block long, lo array<long>, hi array<long>")
    out = store(out.select("anchor", "block", F.col("lo").cast("array<int>"), F.col("hi").cast("array<int>")), "wide")
    discard(chunks, asked, often, good, told)
    return out


def repeated(rows: DataFrame) -> DataFrame:
    """did, noid, th, spans: for rows with repeats, the repeated windows' byte ranges (lo, hi), in no order, overlapping."""
    spark = rows.sparkSession
    occ = occurrences(rows)
    ids = store(occ.select("id", *ROW), "ids")
    each = occ.select("id", F.explode(F.arrays_zip("anchor", "block", "start", "windows")).alias("x")).select("id", "x.*")
    # anchors that occur once have no repeats; an anchor of one kind of block is repeated as a whole
    again = each.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("a"), F.max("block").alias("b")).where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    again = store(again, "anchors")  # a table of its own: both sides of the join are then dealt anew, and Spark splits a frequent anchor
    each = store(each.join(again, "anchor"), "repeats")
    discard(occ, again)
    release(spark)
    mixed = each.where("mixed")
    count = store(mixed.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("start").alias("start"), F.first("windows").alias("windows")), "counted")
    per = store(count.groupBy("anchor").agg(F.count("*").alias("kinds")), "per_anchor")
    kinds = store(count.join(per, "anchor"), "kinds")
    discard(count, per)
    inner = store(_bundled(_pieces(rows, ids, kinds.where(f"kinds <= {SPREAD}")), "anchor"), "inner")
    release(spark)
    many = kinds.where(f"kinds > {SPREAD}")
    if not many.isEmpty():
        inner = inner.unionByName(_by_windows(rows, ids, many))
    whole = kinds.where("n > 1").select("anchor", "block", F.array(F.lit(0)).alias("lo"), F.array(F.col("windows").cast("int")).alias("hi"))
    marks = whole.unionByName(inner)
    hits = mixed.select("id", "anchor", "block", "start").join(marks, ["anchor", "block"]).select("id", "start", F.explode(F.arrays_zip("lo", "hi")).alias("x")).select("id", "start", "x.lo", "x.hi")
    hits = hits.unionByName(each.where("NOT mixed").select("id", "start", F.lit(0).alias("lo"), F.col("windows").cast("int").alias("hi")))
    hits = hits.select("id", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") - 1 + WIDTH).alias("hi"))
    spans = hits.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).join(ids, "id")
    return spans.groupBy(*ROW).agg(F.first("spans").alias("spans"))  # equal rows have equal spans


def _window_hashes(piece: bytes, windows: int) -> np.ndarray:
    at = np.arange(windows)
    return B.span_hashes(np.frombuffer(piece, np.uint8), at, at + WIDTH, B.BYTE_VALUE).view(np.int64)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of rows (g, anchor, block, windows, piece; sorted by g), a bundle of whole groups at a time."""
    held: list[tuple] = []
    size, now = 0, None

    def work() -> pa.RecordBatch | None:
        found = []
        for (_, anchor, block, _, _), hit in zip(held, repeated_windows([h[4] for h in held], [h[3] for h in held]), strict=True):
            if hit.any():
                lo, hi = runs(hit)
                found.append((anchor, block, lo.tolist(), hi.tolist()))
        if not found:
            return None
        a, k, lo, hi = zip(*found, strict=True)
        return pa.RecordBatch.from_pydict({"anchor": pa.array(a, pa.int64()), "block": pa.array(k, pa.int64()), "lo": pa.array(lo, pa.list_(pa.int32())), "hi": pa.array(hi, pa.list_(pa.int32()))})

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[0] != now and size >= BUNDLE:
                if (out := work()) is not None:
                    yield out
                held, size = [], 0
            now = row[0]
            held.append(row)
            size += len(row[4])
    if held and (out := work()) is not None:
        yield out


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, *more: str) -> DataFrame:
    rows = keyed(docs, *more)
    return rows.join(repeated(rows), ROW, "left")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            got = merged(spans)
            h, at = hashlib.sha256(), 0
            for lo, hi in got:
                h.update(text[at:lo])
                at = hi
            h.update(text[at:])
            out.append((len(text), sum(b_ - a for a, b_ in got), len(got), h.hexdigest()))
        n, r, s, k = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "n_spans": pa.array(s, pa.int64()), "kept_sha256": pa.array(k, pa.string())})

    rows = with_spans(docs).select(F.when(~F.col("noid"), F.col("did")).alias("did"), "text", "spans")
    return arrow_map(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a character is removed only if all its bytes are."""
    keep, at = [], 0
    for lo, hi in spans:
        while lo < len(text) and lo < hi and text[lo] & 0xC0 == 0x80:
            lo += 1
        while hi < len(text) and hi > lo and text[hi] & 0xC0 == 0x80:
            hi -= 1
        keep.append(text[at:lo])
        at = max(at, hi)
    keep.append(text[at:])
    return b"".join(keep).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated bytes taken out of text, and n_chars (where there is such a column) counted anew. All rows stay;
    a null text stays null. Only rows with repeats go through Python."""
    cols = docs.columns
    kept = [f"_k{i}" for i, c in enumerate(cols) if c != "text"]
    named = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(cols) if c != "text"], F.col("text").isNull().alias("_null"))
    rows = keyed(named, "_null", *kept)
    spans = store(repeated(rows), "spans")
    joined = rows.join(spans, ROW, "left")

    def clean(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [without(t, merged(s)) for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), *b.columns[2:]], ["_text", *kept])

    whole = joined.where("spans IS NULL").select(F.when(~F.col("_null"), F.col("text").cast("string")).alias("_text"), *kept)
    cut = joined.where("spans IS NOT NULL").select("text", "spans", *kept)
    out = whole.unionByName(arrow_map(cut, clean, whole.schema))
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_k{i}").alias(c) for i, c in enumerate(cols)])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    tune(spark)
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
