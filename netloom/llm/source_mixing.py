"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Documents of a source are put in hash order and cut into blocks. With target weight w, block b (from 0) of a source may start at slot
floor(b / w) and must have run by slot ceil((b + 1) / w); earliest deadline first over released blocks meets all deadlines, so at
every slot each source has run within one block of its due share, until it ends and leaves its slots to others or empty. Weights are exact
fractions k / W with whole shares k that sum to W, and the schedule repeats after W slots; nothing is rounded, dropped or repeated.

Given weights count as decimals as written; without them a source's share is the square root of its documents, to the nearest whole number.
The driver holds one number of documents for each source and writes one period of the schedule, or the blocks that there are if these are
fewer, in pieces of bounded size.

A source of weight 0 follows after all others, in turns; a negative weight is a ValueError; a source without weight gets the smallest given
one. A null source is a source of its own, apart from the empty string. Null ids and null, empty or very long texts are rows like others:
only a digest of id and text is ordered. Rows of equal id and text tie, and as they are equal in both, any order of them is the same mix. An
empty table gives no rows. `mixed` gives all columns back, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm._shared import store_pieces

#: Documents of a block; rows of a rank bucket; entries of a schedule or of a list of sources that is broadcast.
BLOCK, BUCKET_ROWS, MAX_BROADCAST = 16, 2000, 100_000
#: Entries of the schedule that the driver holds at a time.
PIECE = 100_000
PLAN = "_source string, _index long, _at long, _from long, _till long"


def exact(weights: dict[str, float]) -> tuple[int, dict[str, int]]:
    """The weights as whole numbers, and their sum: decimals count as written."""
    parts = {n: Fraction(str(weights[n])) for n in sorted(weights)}
    if min(parts.values()) < 0:
        raise ValueError("a weight is negative")
    scale = math.lcm(*(p.denominator for p in parts.values()))
    whole = {n: int(p * scale) for n, p in parts.items()}
    common = math.gcd(*whole.values()) or 1
    return sum(whole.values()) // common, {n: k // common for n, k in whole.items()}


def root_shares(counts: dict[str, int]) -> tuple[int, dict[str, int]]:
    """The square roots of the counts, to the nearest whole number, and their sum."""
    shares = {n: (r := math.isqrt(c)) + (c - r * r > r) for n, c in counts.items()}
    return sum(shares.values()), shares


def schedule(total: int, shares: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, due) of the blocks of one period of `total` slots, as far as sources have them: earliest
    deadline first over released blocks, ties by name. A source that ends is left out from then on, and slots for which nothing is released
    are passed over, so the work is that of the blocks."""
    need = {n: min(k, blocks[n]) for n, k in shares.items() if k}
    release = [(0, n, 0) for n in sorted(need)]
    ready: list[tuple[int, str, int, int]] = []
    open_, t = sum(need.values()), 0
    while open_:
        if not ready:
            t = max(t, release[0][0])
        while release and release[0][0] <= t:
            r, n, b = heapq.heappop(release)
            heapq.heappush(ready, (-(-(b + 1) * total // shares[n]), n, b, r))
        due, n, b, r = heapq.heappop(ready)
        if due <= t:
            raise ValueError("weights exceed one")
        yield n, b, t, r, due
        open_ -= 1
        if b + 1 < need[n]:
            heapq.heappush(release, ((b + 1) * total // shares[n], n, b + 1))
        t += 1


def source_of(source_col: str) -> Column:
    """The source as a key: '' for null, else the name behind a mark."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))


def with_slots(rows: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """`rows` has _source, _order (hexadecimal digests) and any columns; adds _block, _place (in the block), _slot, _release, _due."""
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy("_source").count().collect()}
    if not counts:
        return rows.selectExpr("*", *[f"CAST(NULL AS LONG) AS {c}" for c in ("_block", "_place", "_slot", "_release", "_due")])
    if weights:
        least = min(weights.values())
        total, shares = exact({n: weights.get(n[1:] if n else None, least) for n in counts})
    else:
        total, shares = root_shares(counts)
    blocks = {n: -(-c // block) for n, c in counts.items()}
    last, ends = {n: (b - 1) % shares[n] for n, b in blocks.items() if shares[n]}, [0]

    def entries() -> Iterator[tuple[str, int, int, int, int]]:
        for n, b, t, r, due in schedule(total, shares, blocks):
            if b == last[n]:
                ends.append((blocks[n] - 1) // shares[n] * total + t + 1)
            yield n, b, t, r, due

    size = sum(min(shares[n], b) for n, b in blocks.items())
    if size <= MAX_BROADCAST:
        plan = F.broadcast(spark.createDataFrame(list(entries()), PLAN))
    else:
        all_ = entries()
        plan = store_pieces(spark, iter(lambda: list(itertools.islice(all_, PIECE)), []), PLAN, "schedule")
    after, idle = max(ends), sorted(n for n, k in shares.items() if not k)
    turn = {n: i for i, n in enumerate(idle)}
    each = spark.createDataFrame([(n, shares[n], -(-c // BUCKET_ROWS), turn.get(n)) for n, c in sorted(counts.items())], "_source string, _share long, _buckets long, _turn long")
    if len(counts) <= MAX_BROADCAST:
        each = F.broadcast(each)
    salted = rows.join(each, "_source").withColumn("_bucket", F.expr("CAST(conv(substr(_order, 1, 6), 16, 10) AS LONG) * _buckets div 16777216"))
    sizes = salted.groupBy("_source", "_bucket").count()
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_source", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_order"))
    out = salted.withColumn("_rank", inner).join(starts, ["_source", "_bucket"]).withColumn("_rank", F.col("_start") + F.col("_rank") - 1)
    out = out.withColumn("_block", F.expr(f"CAST(_rank div {block} AS LONG)")).withColumn("_place", F.expr(f"CAST(_rank % {block} AS LONG)"))
    out = out.withColumn("_index", F.expr("CASE WHEN _share > 0 THEN _block % _share END")).withColumn("_turns", F.expr("CASE WHEN _share > 0 THEN _block div _share END"))
    out = out.join(plan, ["_source", "_index"], "left")
    for name, place, idle_place in (("_slot", "_at", "_turn"), ("_release", "_from", "0"), ("_due", "_till", f"{len(idle)}")):
        out = out.withColumn(name, F.expr(f"CASE WHEN _share > 0 THEN _turns * {min(total, (1 << 63) - 1)} + {place} ELSE {after} + _block * {len(idle)} + {idle_place} END"))
    return out.drop("_share", "_buckets", "_turn", "_bucket", "_start", "_rank", "_index", "_turns", "_at", "_from", "_till")


def mixing_order(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, block, place, slot, release, due of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), source_of("source").alias("_source"), order_of())
    out = with_slots(rows, weights, block)
    return out.select("doc_id", "source", *[F.col(f"_{c}").cast("long").alias(c) for c in ("block", "place", "slot", "release", "due")])


def order_of() -> Column:
    """A digest of id and text in hexadecimal: a fixed shuffle in which only equal rows tie."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary")).alias("_order")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """All rows of `docs`, in the order of slot and place across and within partitions."""
    cols = docs.columns
    spark = docs.sparkSession
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(cols)], source_of("source").alias("_source"), order_of())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = with_slots(rows, weights, block).repartitionByRange(parts, "_slot", "_place").sortWithinPartitions("_slot", "_place")
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(cols)])


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, place, slot, release, due of every document."""
    return mixing_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same in DuckDB: one period by a recursion over slots."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
c AS (SELECT s, CAST(round(sqrt(count(*))) AS BIGINT) AS k, (count(*) + {BLOCK - 1}) // {BLOCK} AS n FROM d GROUP BY s),
z AS (SELECT s, k, least(k, n) AS n, sum(k) OVER () AS q, row_number() OVER (ORDER BY s) AS i FROM c),
ks AS (SELECT list(k ORDER BY i) AS ks, list(n ORDER BY i) AS ns, CAST(any_value(q) AS BIGINT) AS q FROM z),
run(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ks, lambda v: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM ks
  UNION ALL
  SELECT t + 1, list_transform(done, lambda v, i: CASE WHEN i = p THEN v + 1 ELSE v END), p
  FROM (SELECT t, done, CASE WHEN list_min(cand) < 1000000000000 THEN list_position(cand, list_min(cand)) ELSE 0 END AS p FROM (
    SELECT t, done, list_transform(done, lambda v, i: CASE WHEN v < ns[i] AND v * q // ks[i] <= t + 1 THEN ((v + 1) * q + ks[i] - 1) // ks[i] * 100000 + i ELSE 1000000000000 END) AS cand FROM run, ks WHERE t + 1 < q))),
plan AS (SELECT pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS b, t FROM run WHERE t >= 0),
r AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY o) - 1 AS rk FROM d)
SELECT doc_id, source, block, place, CAST(block // k * q + plan.t AS BIGINT) AS slot, CAST(block * q // k AS BIGINT) AS release, CAST(((block + 1) * q + k - 1) // k AS BIGINT) AS due
FROM (SELECT doc_id, source, s, rk // {BLOCK} AS block, rk % {BLOCK} AS place FROM r) JOIN z USING (s) JOIN plan ON plan.i = z.i AND plan.b = block % k"""
