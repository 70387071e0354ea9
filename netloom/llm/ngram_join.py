"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct k-word shingles (64-bit hashes). Equal sets form one class from the start; a class's name is a 64-bit hash of its
set, checked against a second one, and sets that only share the first get a name from both. Tokens are
ordered by a frequency class from a count sketch over the whole corpus, then by hash, so that shared passages come last. Two sets that
reach the threshold share at least two tokens of their prefixes extended by one, which makes these the index keys:

1. each single prefix token, with its least altered member (most of whose prefix others share) as leader: every member is compared with
   the leader, and links join components;
2. tokens of few members that are still mixed: all pairs of different components that the positional and length bounds allow;
3. documents in frequent tokens that are still mixed are indexed anew by the exact frequencies among them, which puts their own edits
   first, and go through 1 and 2 again;
4. what is then still frequent and mixed becomes 2-token combinations, and a combination that is frequent itself is worked off by rounds
   of leaders, eight times as many each round, until it is a single component or no pair is left.

A pair in one component is never compared again, since only components are reported. A class has a bitmap, each bit the parity of its tokens
there; two sets differ in at least as many tokens as their bitmaps in bits, so a pair whose bitmaps differ in too many is no link. A bitmap has about as
many bits as its set tokens, as one of fixed size would rule out no pair of large sets; the larger of two is folded. Verification of
the others is exact on the whole sets: texts, of which only those of compared classes are shuffled, travel to their leader, hot leaders are salted, and a task holds one leader's set at a time. Counts by token are tables of their own
before rows are joined with them, so that Spark splits the rows of a token that very many documents hold. Each step deletes
the tables that no later step reads.

Null and empty texts and texts without words have the empty set and link with nothing; a null doc_id takes part like any other row.
Repeated rows and equal texts are one class, listed row by row. A very long text is one set, read whole. Ties in frequency are broken by the
token's hash, so the result does not depend on the order of rows. An empty table gives no rows. Only doc_id and text are read, so other
columns may have any name; keep_one gives all columns back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import _bytes as B
from netloom.llm._components import components
from netloom.llm._shared import discard, release, store, tune

#: Words in a shingle and percent of the union, in the query op10; the default of near-duplicate stages is (5, 80).
SHINGLE, PERCENT = 4, 85
#: Slots of the count sketch (fixed size) and its rows of slots.
SLOTS, SLOT_ROWS = 1 << 20, 64
#: A token of more members is frequent; a document with more frequent tokens keeps them single; members a leader's group takes.
FREQUENT, MAX_COMBINED, GROUP = 100, 48, 512
#: Bits of a class's bitmap at least, and slots of the marks that texts are looked up in before a shuffle (a fixed size).
PARITY, MARKS, MARK_ROWS = 512, 1 << 24, 64
#: Different sets of one 64-bit hash that the driver takes (an error beyond; chance gives ten at 2e10 sets).
MOST_CLASHES = 10_000


def prefix_length(n: int, percent: int) -> int:
    """Tokens of the 2-extended prefix: sets of size n that reach the threshold with any other share two of them (n >= 2)."""
    need = -(-percent * n // 100)
    return min(n, n - need + 2)


def signatures(vals: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes for each row's set, of 64 bits each, from different mixtures of its tokens."""
    out = []
    for c in (np.uint64(0x51ED270B), np.uint64(0x8CB92BA72F3D8DD7)):
        m = np.concatenate([[np.uint64(0)], np.cumsum(B.mix(vals + c), dtype=np.uint64)])
        out.append(B.mix(m[offs[1:]] - m[offs[:-1]] + np.diff(offs).astype(np.uint64)))
    return out[0].view(np.int64), B.mix(out[0] + B.mix(out[1])).view(np.int64)


def identity(vals: np.ndarray, offs: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """The class of each row's set: its first hash, or the one of both where different sets share the first."""
    one, both = signatures(vals, offs)
    return np.where(np.isin(one, clashes), both, one) if len(clashes) else one


def _sets(arr: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = B.column(arr)
    for lo, hi, b, o in B.parts(buf, offs):
        h, r = B.shingles(b, o, k)
        vals, at = B.distinct_per_row(h, r, hi - lo)
        yield lo, hi, vals, at


def keyed(docs: DataFrame) -> DataFrame:
    """did, th (hash of the text) and text: what identifies a row here."""
    t = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("did"), F.xxhash64(t).alias("th"), t.alias("text"))


#: Order of rows with null ids last; a join that finds them too.
FIRST = "struct(did IS NULL, did, th)"
SAME_ROW = "x.did <=> y.did AND x.th = y.th"


def shared_hashes(members: DataFrame) -> np.ndarray:
    """First hashes that different sets have; of 2e10 sets some ten are expected."""
    rows = members.groupBy("cid").agg(F.min("alt").alias("x"), F.max("alt").alias("y")).where("x <> y").select("cid").limit(MOST_CLASHES + 1).collect()
    if len(rows) > MOST_CLASHES:
        raise RuntimeError(f"more than {MOST_CLASHES} pairs of different sets have one hash")
    return np.array([r["cid"] for r in rows], np.int64)


def scan(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Members (did, th, cid, n) of classes, the sketch's rows, and the hashes that different sets share; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            for lo, hi, vals, at in _sets(b.column(2), k):
                counts += np.bincount((vals >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
                n = hi - lo
                one, both = signatures(vals, at)
                yield pa.RecordBatch.from_pydict({"did": b.column(0).slice(lo, n), "th": b.column(1).slice(lo, n), "cid": pa.array(one), "alt": pa.array(both), "n": pa.array(np.diff(at)), "slots": pa.nulls(n, pa.binary())})
        for i, row in enumerate(counts.reshape(SLOT_ROWS, -1)):
            if row.any():
                yield pa.RecordBatch.from_pydict({"did": pa.array([i], pa.int64()), "th": pa.nulls(1, pa.int64()), "cid": pa.nulls(1, pa.int64()), "alt": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "slots": pa.array([row.astype("<u4").tobytes()], pa.binary())})

    out = store(rows.mapInArrow(run, "did long, th long, cid long, alt long, n long, slots binary"), "members")
    members = out.where("slots IS NULL").drop("slots")
    clashes = shared_hashes(members)
    if len(clashes):
        members = members.withColumn("cid", F.when(F.col("cid").isin(clashes.tolist()), F.col("alt")).otherwise(F.col("cid")))
    return members.drop("alt"), out.where("slots IS NOT NULL").select(F.col("did").cast("int").alias("i"), "slots"), clashes


def frequency_classes(sketch: DataFrame) -> np.ndarray:
    """Twice the binary logarithm of each slot's count, one byte each: SLOTS bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(s, "<u4").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "c": pa.array([(2 * np.log2(v + 1)).astype(np.uint8).tobytes() for v in total.values()], pa.binary())})

    classes = np.zeros((SLOT_ROWS, SLOTS // SLOT_ROWS), np.uint8)
    for r in sketch.repartition(SLOT_ROWS, "i").mapInArrow(run, "i int, c binary").collect():
        classes[r["i"]] = np.frombuffer(r["c"], np.uint8)
    return classes.ravel()


def parities(vals: np.ndarray, at: np.ndarray, width: int = PARITY) -> np.ndarray:
    """`width` bits (a power of two, 64 at least) of each row's set, as longs."""
    n = len(at) - 1
    slot = np.repeat(np.arange(n), np.diff(at)) * width + (vals & np.uint64(width - 1)).astype(np.int64)
    odd = (np.bincount(slot, minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, width // 64)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The set's bitmap: as many bits as tokens, up to the next power of two, and PARITY at least."""
    return parities(tokens, np.array([0, len(tokens)]), max(PARITY, 1 << (len(tokens) - 1).bit_length()))[0]


def _mark(th: np.ndarray) -> np.ndarray:
    return (B.mix(th.view(np.uint64)) >> np.uint64(64 - MARKS.bit_length() + 1)).astype(np.int64)


def marked(keys: DataFrame):
    """A test of a column of text hashes: true for those in `keys` (th), and for few others while MARKS are many more than keys. The marks meet on the
    executors; MARKS / 8 bytes reach the driver, whatever the number of keys."""
    size = MARKS // MARK_ROWS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(MARKS, bool)
        for b in batches:
            on[_mark(b.column(0).to_numpy())] = True
        for i, row in enumerate(np.packbits(on).reshape(MARK_ROWS, size)):
            if row.any():
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "m": pa.array([row.tobytes()])})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) | np.frombuffer(m, np.uint8)
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "m": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    marks = np.zeros((MARK_ROWS, size), np.uint8)
    for r in keys.select("th").mapInArrow(run, "i int, m binary").repartition(MARK_ROWS, "i").mapInArrow(meet, "i int, m binary").collect():
        marks[r["i"]] = np.frombuffer(r["m"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(marks.ravel())

    @F.arrow_udf("boolean")
    def test(th: pa.Array) -> pa.Array:
        at = _mark(th.to_numpy(zero_copy_only=False))
        return pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return test


def prefixes(rows: DataFrame, classes: np.ndarray, clashes: np.ndarray, k: int, percent: int) -> DataFrame:
    """cid, n, the bitmap and the tokens of the 2-extended prefix, for sets of two tokens or more (a single token links equal sets only)."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, set()
        for b in batches:
            for lo, hi, vals, at in _sets(b.column(0), k):
                cls = rank[(vals >> np.uint64(44)).astype(np.int64)]
                ids, sizes, toks, bits = [], [], [], []
                for i, c in enumerate(identity(vals, at, clashes).tolist()):
                    n = int(at[i + 1] - at[i])
                    if n < 2 or c in seen:
                        continue
                    seen.add(c)
                    order = np.argsort(cls[at[i] : at[i + 1]], kind="stable")[: prefix_length(n, percent)]
                    ids.append(c)
                    sizes.append(n)
                    bits.append(bitmap(vals[at[i] : at[i + 1]]))
                    toks.append(vals[at[i] : at[i + 1]][order].view(np.int64))
                if len(seen) > 500_000:
                    seen.clear()
                if ids:
                    offs = np.concatenate([[0], np.cumsum([len(t) for t in toks])]).astype(np.int32)
                    cuts = np.concatenate([[0], np.cumsum([len(x) for x in bits])]).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({"cid": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "bits": pa.ListArray.from_arrays(cuts, np.concatenate(bits)), "tokens": pa.ListArray.from_arrays(offs, np.concatenate(toks))})

    return store(rows.select("text").mapInArrow(run, "cid long, n long, bits array<long>, tokens array<long>"), "prefixes")


def _listed(arr: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stored sets in the form of _sets."""
    at = arr.offsets.to_numpy().astype(np.int64)
    yield 0, len(arr), arr.values.to_numpy(zero_copy_only=False).view(np.uint64)[at[0] : at[-1]], at - at[0]


def verify(pairs: DataFrame, source: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets reach the threshold. `source` gives each class's text or set by cid; it goes
    once to each leader a (and its salt)."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("salts"))
    p = pairs.join(load, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
    heads = p.select("a", "salt").distinct()
    want = p.select("a", "salt", F.col("b").alias("cid"), F.lit(1).alias("role")).unionByName(heads.select("a", "salt", F.col("a").alias("cid"), F.lit(0).alias("role")))
    by_text = "text" in source.columns
    rows = source.join(want.hint("merge"), "cid").select("a", "salt", "role", "cid", "text" if by_text else "tokens")
    reader = _sets if by_text else _listed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, np.zeros(0, np.uint64)
        for b in batches:
            a_, s_, role, cid = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for lo, hi, vals, at in reader(b.column(4), k):
                found: list[tuple[int, int]] = []
                for i in range(hi - lo):
                    j, own = lo + i, vals[at[i] : at[i + 1]]
                    if role[j] == 0:
                        now, head = (a_[j], s_[j]), own.copy()
                        continue
                    if now != (a_[j], s_[j]):
                        raise RuntimeError("a leader's set is missing: a text changed while the join ran")
                    x, y = len(head), len(own)
                    if 100 * min(x, y) < percent * max(x, y):
                        continue
                    pos = np.searchsorted(head, own)
                    same = int(np.count_nonzero(head[np.minimum(pos, x - 1)] == own))
                    if 100 * same >= percent * (x + y - same):
                        found.append((int(a_[j]), int(cid[j])))
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a long, b long").distinct()


def _fits(percent: int):
    """Length bound, and positional bound for a token that is the first or second in common."""
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {percent} * (na + nb) <= {100 + percent} * (1 + least(na - pa, nb - pb))")


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("key", F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("comp").alias(f"c{x}"))


class _Join:
    """The state of one join: texts, classes, the links found and the pairs compared."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        self.rows = keyed(docs)
        self.members, self.sketch, self.clashes = scan(self.rows, k)
        self.classes = self.members.where("n > 0").groupBy("cid").agg(F.min_by(F.struct("did", "th"), F.expr(FIRST)).alias("x"), F.min("n").alias("n")).select("cid", "x.did", "x.th", "n")
        self.comp: DataFrame | None = None  # v, comp: classes that have a link, and their component
        self.tried: list[DataFrame] = []  # pairs that were compared
        self.sets: DataFrame | None = None  # cid, tokens of the classes that are indexed anew
        self.bits: DataFrame | None = None  # cid, n, bits of the classes that may have links

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """(cid, text) of classes, stored. Texts of no such class are left out before the shuffle."""
        one = store(self.classes.join(ids, "cid").select("cid", "did", "th"), "wanted")
        rows = self.rows.where(marked(one)("th"))
        out = store(rows.alias("x").join(one.hint("merge").alias("y"), F.expr(SAME_ROW)).select("y.cid", "x.text"), "texts")
        discard(one)
        return out

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, lead) whose bitmaps differ in no more bits than the sets may in tokens."""
        if self.bits is None:
            return pairs
        side = lambda x: self.bits.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")).dropDuplicates([x])
        xor = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        for x, y in (("ba", "bb"), ("bb", "ba")):
            half = (F.size(x) / 2).cast("int")
            both = both.withColumn(x, F.when(F.size(x) > F.size(y), xor(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half))).otherwise(F.col(x)))
        differ = F.aggregate(F.transform(xor("ba", "bb"), F.bit_count), F.lit(0).cast("long"), lambda s, x: s + x)
        differ = F.when(F.size("ba") == F.size("bb"), differ).otherwise(0)  # sets of more than twice the other's size: left to the comparison
        return both.where(differ * (100 + self.percent) <= (F.col("na") + F.col("nb")) * (100 - self.percent)).select("a", "b", "lead")

    def compare(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b) that were not compared before."""
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("lead")).groupBy("a", "b").agg(F.min("lead").alias("lead"))
        for old in self.tried:
            new = new.join(old.select("a", "b"), ["a", "b"], "left_anti")
        new = store(new, "pairs")
        if new.isEmpty():
            discard(new)
            return
        self.tried.append(new)
        new = store(self.likely(new), "likely")
        lead = new.select(F.col("lead").alias("a"), F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("b"))
        source = self.sets
        if source is None:
            source = self.texts_of(lead.select(F.col("a").alias("cid")).unionByName(lead.select(F.col("b").alias("cid"))).distinct())
        links = store(verify(lead, source, self.k, self.percent), "links")
        discard(new, None if source is self.sets else source)
        self.merge(links)
        discard(links)
        release(self.spark)

    def merge(self, links_: DataFrame) -> None:
        """Take new links into the components: only components that a link joins are worked on."""
        if self.comp is None:
            self.comp = components(links_)
            return
        names = lambda x: self.comp.select(F.col("v").alias(x), F.col("comp").alias(f"c{x}"))
        named = links_.join(names("a"), "a", "left").join(names("b"), "b", "left")
        named = named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
        named = store(named, "joins")
        if named.isEmpty():
            discard(named)
            return
        fresh = links_.select(F.col("a").alias("v")).unionByName(links_.select(F.col("b").alias("v"))).distinct().join(self.comp, "v", "left_anti").select("v", F.col("v").alias("comp"))
        joined = components(named)
        over = joined.select(F.col("v").alias("comp"), F.col("comp").alias("top"))
        comp = store(self.comp.unionByName(fresh).join(over, "comp", "left").select("v", F.coalesce("top", "comp").alias("comp")), "components")
        discard(named, joined, self.comp)
        self.comp = comp

    def with_components(self, buckets: DataFrame) -> DataFrame:
        """Rows of mixed keys, with their component and the key's count, stored; `buckets` is deleted if it is a stored table."""
        if self.comp is None:
            b = store(buckets.withColumn("comp", F.col("cid")), "named")
        else:
            b = store(buckets.join(self.comp.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "named")
        discard(buckets)
        mixed = store(b.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").drop("lo", "hi"), "mixed")
        out = b.join(mixed, "key").where(f"{self.percent} * (n + low) <= {100 + self.percent} * (1 + n - pos)")
        out = store(out.select("key", "cid", "n", "pos", "comp", "c"), "buckets")
        discard(b, mixed)
        return out

    def index(self, tokens: DataFrame) -> DataFrame:
        """Of (key, cid, n, pos) the rows that have a possible partner under their key, stored, with each key's leader compared."""
        shared = tokens.groupBy("key").agg(F.min("cid").alias("x"), F.max("cid").alias("y"), F.min("n").alias("low")).where("x <> y").select("key", "low")
        shared = store(shared, "shared")  # so that the join deals both sides anew and Spark splits a frequent key
        release(self.spark)  # the tokens' first shuffle goes before the second is written
        rows = tokens.join(shared, "key").where(f"{self.percent} * (n + low) <= {100 + self.percent} * (1 + n - pos)")
        rows = store(rows.select("key", "cid", "n", "pos").distinct(), "index")
        discard(shared)
        release(self.spark)
        share = rows.groupBy("cid", "n").agg(F.count("*").alias("q")).select("cid", (1000 - F.col("q") * 1000 / F.col("n")).cast("long").alias("altered"))
        lead = rows.join(share, "cid").groupBy("key").agg(F.min(F.struct("altered", "cid", "n", "pos")).alias("x"), F.count("*").alias("c")).where("c > 1")
        lead = store(lead.select("key", F.col("x.cid").alias("a"), F.col("x.n").alias("na"), F.col("x.pos").alias("pa")), "leaders")
        pairs = rows.select("key", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")).join(lead, "key").where("a <> b").where(_fits(self.percent))
        self.compare(pairs.select("a", "b"))
        discard(lead)
        return rows

    def few(self, mixed: DataFrame) -> DataFrame:
        """All pairs of different components under keys of few members; the rows of the other keys, as far as still mixed, stored."""
        rows = mixed.where(f"c <= {FREQUENT}")
        pairs = _side(rows, "a").join(_side(rows, "b"), "key").where("a < b AND ca <> cb").where(_fits(self.percent))
        self.compare(pairs.select("a", "b"))
        left = self.with_components(mixed.where(f"c > {FREQUENT}").select("key", "cid", "n", "pos"))
        discard(mixed)
        return left

    def exact_index(self, some: DataFrame) -> DataFrame:
        """(key, cid, n, pos) of the 2-extended prefixes of some classes, tokens ordered by their exact frequency among these, stored."""
        texts = self.texts_of(some)
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, vals, at in _sets(b.column(1), k):
                    yield pa.RecordBatch.from_pydict({"cid": b.column(0).slice(lo, hi - lo), "tokens": pa.ListArray.from_arrays(at.astype(np.int32), vals.view(np.int64))})

        self.sets = store(texts.mapInArrow(run, "cid long, tokens array<long>").dropDuplicates(["cid"]), "sets")
        discard(texts)
        release(self.spark)
        each = self.sets.select("cid", F.explode("tokens").alias("key"))
        counts = store(each.groupBy("key").agg(F.count("*").alias("f")).where("f > 1"), "counts")
        ordered = each.join(counts, "key", "left").select("cid", F.struct(F.coalesce("f", F.lit(1)).alias("f"), "key").alias("x"))
        ordered = ordered.groupBy("cid").agg(F.sort_array(F.collect_list("x")).alias("s")).withColumn("n", F.size("s").cast("long"))
        length = F.expr(f"CAST(least(n, n - ({self.percent} * n + 99) div 100 + 2) AS INT)")
        head = F.transform(F.slice("s", F.lit(1), length), lambda x, i: F.struct(x["key"].alias("key"), x["f"].alias("f"), i.cast("long").alias("pos")))
        out = ordered.select("cid", "n", F.explode(F.filter(head, lambda x: x["f"] > 1)).alias("x"))
        out = store(out.select("x.key", "cid", "n", "x.pos"), "exact")
        discard(counts)
        return out

    def rounds(self, left: DataFrame) -> None:
        """Frequent keys as 2-token combinations; those that stay frequent by rounds of leaders outside their largest component, each
        compared with the whole key, until no such member is left."""
        mixed = self.with_components(combinations(left))
        discard(left)
        many, leaders = self.few(mixed), 16
        while not many.isEmpty():
            sizes = many.groupBy("key", "comp").agg(F.count("*").alias("k"))
            major = store(sizes.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), (F.sum("k") - F.max("k")).alias("minor")), "majors")
            lead = store(many.join(major, "key").where("comp <> major").where(f"pmod(xxhash64(cid, {leaders}), minor) < {leaders}").drop("major", "minor"), "leads")
            pairs = _side(many, "b").join(_side(lead, "a"), "key").where("a <> b AND ca <> cb").where(_fits(self.percent))
            self.compare(pairs.select("a", "b"))
            rest = self.with_components(many.join(lead.select("key", "cid"), ["key", "cid"], "left_anti").select("key", "cid", "n", "pos"))
            discard(major, lead, many)
            many, leaders = rest, 8 * leaders
        discard(many)


def linked(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, components): members (did, th, cid, n) of the classes of equal sets, and (v, comp) of the classes that have a link."""
    j = _Join(docs, k, percent)
    pre = prefixes(j.rows, frequency_classes(j.sketch), j.clashes, k, percent)
    j.bits = store(pre.select("cid", "n", "bits"), "bitmaps")
    tokens = pre.select("cid", "n", F.posexplode("tokens").alias("pos", "key")).select("key", "cid", "n", F.col("pos").cast("long").alias("pos"))
    found = j.index(tokens)
    discard(pre)
    left = j.few(j.with_components(found))
    if not left.isEmpty():
        exact = j.exact_index(left.select("cid").distinct())
        discard(left)
        found = j.index(exact)
        discard(exact)
        left = j.few(j.with_components(found))
        if not left.isEmpty():
            j.rounds(left)
        discard(j.sets)
    discard(left, j.bits, *j.tried)
    return j.members, j.comp if j.comp is not None else j.spark.createDataFrame([], "v long, comp long")


def combinations(many: DataFrame) -> DataFrame:
    """Frequent tokens become 2-token combinations, at the position of the second; those held by a document with too many of them stay
    single, for all documents."""
    held = many.join(many.groupBy("cid").agg(F.count("*").alias("q")), "cid")
    wide = held.groupBy("key").agg(F.max("q").alias("q")).where(f"q > {MAX_COMBINED}").select("key")
    single = many.join(wide, "key").select("key", "cid", "n", "pos")
    rest = many.join(wide, "key", "left_anti").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("ks"))
    pairs = F.flatten(F.transform("ks", lambda x, i: F.transform(F.slice("ks", i + 2, F.greatest(F.size("ks") - i - 1, F.lit(0))), lambda y: F.struct(F.xxhash64(x["key"], y["key"]).alias("key"), y["pos"].alias("pos")))))
    return single.unionByName(rest.select("cid", "n", F.explode(pairs).alias("x")).select(F.col("x.key").alias("key"), "cid", "n", F.col("x.pos").alias("pos")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """did, th, n_shingles, comp, component_id for each row. component_id is the smallest doc_id reachable by links; a row
    without words links with nothing and keeps its own id. Rows without doc_id link like others and get the smallest id of their component,
    or null if it has none."""
    members, comp = linked(docs, k, percent)
    m = members.join(comp.withColumnRenamed("v", "cid"), "cid", "left").select("did", "th", "n", F.coalesce("comp", "cid").alias("comp"))
    full = store(m.where("n > 0"), "full")
    least = store(full.groupBy("comp").agg(F.min("did").alias("component_id")), "least")
    out = full.join(least, "comp").select("did", "th", F.col("n").alias("n_shingles"), "comp", "component_id")
    none = m.where("n = 0").select("did", "th", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("comp"), F.col("did").alias("component_id"))
    return out.unionByName(none)


#: The characters that part words.
SPACES = " \t\n\x0b\f\r"


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id (null last; then text hash); repeated rows count as copies.
    Rows without words all stay. Columns as in `docs`."""
    found = store(near_duplicates(docs, k, percent), "near")
    key = ["did", "noid", "th"]
    first = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min_by(F.struct("did", "th"), F.expr(FIRST)).alias("x"))
    first = first.select(F.coalesce("x.did", F.lit(0)).alias("did"), F.col("x.did").isNull().alias("noid"), "x.th")
    cols, text = docs.columns, F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(cols)], F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("did"), F.col("doc_id").isNull().alias("noid"), F.xxhash64(text).alias("th"), (F.translate(text, SPACES, "") == "").alias("_bare"))
    # repeated rows meet on the map side already, so that no task gets all copies of one row
    kept = rows.where("NOT _bare").dropDuplicates(key).join(first, key).unionByName(rows.where("_bare"))
    return kept.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(cols)])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: 4-word shingles, similarity 0.85 or more."""
    tune(spark)
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHINGLE, PERCENT)
    return out.select(F.col("did").alias("doc_id"), "n_shingles", "component_id")


#: The same by a join of all shingles and reachability over links.
ORACLE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM docs WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * m >= 85 * (s.n + t.n - m)),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v, b FROM reach JOIN links ON r = a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM docs d LEFT JOIN size USING (doc_id) JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) ON v = d.doc_id
"""
