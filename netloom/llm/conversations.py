"""Structure repair of conversations: the cheapest edits that give the roles a legal order, with an audit of them.

A conversation is a path problem. A node is a row and what the kept roles end with (nothing, system, user, assistant); the arcs keep a
row, change its role, delete it, or insert a turn, at small integer costs. Dial's buckets give every node its distance to the end; the audit
is the walk from the start that always takes the first tight arc in ASCII order. Legal are the role initials `(s?(ua)+)?`.

Rows are ordered by turn (nulls first), then role, then text. Equal rows are counted before anything is sorted, so copies cost one row. Ranges
of this order go to tasks, which cut them into segments of at most SEGMENT rows or SEGMENT_BYTES. A conversation inside one segment is repaired there. The others,
however long, are repaired by segments: the segments' distances between their four first and four last nodes are multiplied up from
the end, the walks of their four possible beginnings tell which node the next segment begins at, and then each segment writes its part. One
task sees of such a conversation 16 numbers a segment; its digest is made from a stream of its parts.

Nulls: a null role or text is one space, a null conv_id or turn counts as one space in the rule that damages rows; a null conv_id is a conversation of its own.
Empty and blank texts are blank rows. Very long texts are carried whole. Repeated rows of the table are duplicates of each other. A conversation
without rows after damage has zeros, an empty audit and the digest of the empty string; an empty table gives no rows. Columns other
than conv_id, turn, role and text are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm._shared import store, tune

SPACES = " \t\n\x0b\f\r"
#: Costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Rows and bytes of a segment; at most 2**13 rows.
SEGMENT, SEGMENT_BYTES = 4096, 4 << 20
#: The state that a user or assistant turn leads to from none, system, user, assistant; distances of the four states at the end.
NEXT, NEVER = (2, 2, 3, 2), 1 << 60
GOAL = [0, NEVER, NEVER, 0]
#: Where a kept row of this initial leads to.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NAME = {2: "user", 3: "assistant"}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PART = "conv {}, seg long, tmin long, tmax long, tkinds long, head string, tail string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines long, repaired binary"


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies: the rows after damage by the crc32 of `conv_id:turn` modulo 20, equal ones counted. A dropped row leaves a
    row of no copies, so that its conversation stays known."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    h, role, text = F.crc32(named.cast("binary")) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    gone = h == 0
    new = rows.select(
        F.col("conv_id").alias("conv"), F.when(~gone, F.col("turn").cast("long")).alias("turn"), F.when(gone, "").when(h == 4, "user").otherwise(role).alias("role"),
        F.when(gone | (h == 1), "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(gone, 0).when(h == 3, 2).otherwise(1).alias("c"),
    )
    return new.groupBy("conv", "turn", "role", "text").agg(F.sum("c").alias("copies"))


def kind_of(rows: DataFrame) -> str:
    return rows.schema["conv"].dataType.simpleString()


def segments(rows: DataFrame) -> DataFrame:
    """conv, seg, open, roles, texts, copies, tmin, tmax, tkinds, stored: the segments in order of seg. A conversation that is not open is one segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # turn, role, text, copies
        conv, size, begun, open_ = None, 0, False, True  # a task's first conversation may have begun in the task before

        def emit(kind: pa.DataType, open_: bool) -> pa.RecordBatch:
            rows_ = [r for r in held if r[3]]
            turns = sorted({r[0] for r in rows_ if r[0] is not None})
            lists = {c: pa.array([[r[k] for r in rows_]], pa.list_(t)) for c, k, t in (("roles", 1, pa.string()), ("texts", 2, pa.string()), ("copies", 3, pa.int64()))}
            return pa.RecordBatch.from_pydict({
                "conv": pa.array([conv], kind), "seg": pa.array([seg], pa.int64()), "open": pa.array([open_]), **lists,
                "tmin": pa.array(turns[:1] or [None], pa.int64()), "tmax": pa.array(turns[-1:] or [None], pa.int64()), "tkinds": pa.array([len(turns)], pa.int64()),
            })

        for b in batches:
            for c, *row in zip(*(col.to_pylist() for col in b.columns), strict=True):
                same = c == conv
                if begun and (not same or len(held) >= SEGMENT or size >= SEGMENT_BYTES):
                    yield emit(b.column(0).type, open_ or same)
                    held, size, seg, open_ = [], 0, seg + 1, same
                conv, begun = c, True
                held.append(tuple(row))
                size += len(row[2])
        if begun:
            yield emit(b.column(0).type, True)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("conv", "turn", "role", "text")
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return store(ranged.mapInArrow(run, f"conv {kind_of(rows)}, seg long, open boolean, roles array<string>, texts array<string>, copies array<long>, tmin long, tmax long, tkinds long"), "segments")


class Segment:
    """Faults of a segment's rows and the rows that an edit may keep. `again`: rows whose role and text an earlier row of the conversation has."""

    def __init__(self, roles: list[str], texts: list[str], copies: list[int], again: set[int] | None = None):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.live: list[tuple[str, str, int]] = []  # role, text, 1 if truncated
        self.deletes = [0]  # required ones before each live row, and behind the last
        seen: set[tuple[str, str]] = set()
        last = None
        for i, (role, text, n) in enumerate(zip(roles, texts, copies, strict=True)):
            core = text.rstrip(SPACES)
            old = (role, text) in seen if again is None else i in again
            if again is None:
                seen.add((role, text))
            initial = role[:1]
            self.illegal += (n - 1) * (initial + initial not in ("su", "ua", "au")) + (last is not None and last + initial not in ("su", "ua", "au"))
            last = initial
            if not core:
                self.blank += n
                self.deletes[-1] += n
            elif old:
                self.duplicate += n
                self.deletes[-1] += n
            else:
                cut = int(core[-1] not in ".!?")
                self.truncated += cut
                self.duplicate += n - 1
                self.live.append((role, text, cut))
                self.deletes.append(n - 1)
        self.ends = (roles[0][:1], roles[-1][:1]) if roles else (None, None)

    def distances(self, goal: list[int]) -> list[int]:
        """Distance of each node 4 * row + state to the end, whose states cost `goal`, by Dial's buckets."""
        m, live = len(self.live), self.live
        dist = [NEVER] * (4 * m + 4)
        low = min(goal)
        buckets: dict[int, list[int]] = {}

        def reach(node: int, d: int) -> None:
            if d < dist[node]:
                dist[node] = d
                buckets.setdefault(d, []).append(node)

        for s in range(4):
            if goal[s] < NEVER:
                reach(4 * m + s, goal[s])
        d = low
        while buckets:
            here = buckets.get(d)
            if not here:  # costs are at most 3, so the next bucket is near
                buckets.pop(d, None)
                d += 1
                continue
            node = here.pop()
            if dist[node] < d:
                continue
            j, s = divmod(node, 4)
            before = [x for x in range(4) if NEXT[x] == s]
            for x in before:
                reach(4 * j + x, d + INSERT)
            if j:
                role, _, cut = live[j - 1]
                at = 4 * j - 4
                reach(at + s, d + DELETE)
                for x, y in KEPT.get(role[:1], {}).items():
                    if y == s:
                        reach(at + x, d + KEEP + cut)
                for x in before:
                    reach(at + x, d + REROLE + cut)
        return dist

    def walk(self, dist: list[int], state: int, last: bool, write: Callable[[str, str | None, str], None]) -> int:
        """Take the first tight arc in ASCII order from the first node of `state` on; the state at the end. The last segment of a
        conversation inserts behind its rows, others leave that to the next one."""
        j, m = 0, len(self.live)
        write("D" * self.deletes[0], None, "")
        while True:
            d = dist[4 * j + state]
            if j == m and (not last or d == 0):
                return state
            to = NEXT[state]
            if j < m:
                role, text, cut = self.live[j]
                after = 4 * j + 4
                if dist[after + state] + DELETE == d:
                    write("D", None, "")
                elif dist[4 * j + to] + INSERT == d:
                    write("I", NAME[to], "")
                    state = to
                    continue
                else:
                    kept = KEPT.get(role[:1], {}).get(state)
                    if kept is not None and dist[after + kept] + KEEP + cut == d:
                        write("K", role, text)
                        state = kept
                    else:
                        write("R", NAME[to], text)
                        state = to
                j += 1
                write("D" * self.deletes[j], None, "")
            else:
                write("I", NAME[to], "")
                state = to


def repaired(s: Segment, dist: list[int], state: int, last: bool) -> tuple[str, list[str], int]:
    """Audit, lines and last state of a segment."""
    audit, lines = [], []

    def write(edit: str, role: str | None, text: str) -> None:
        audit.append(edit)
        if role is not None:
            lines.append(f"{role}:{text}")

    state = s.walk(dist, state, last, write)
    return "".join(audit), lines, state


def _closed(rows: DataFrame) -> DataFrame:
    """Repair of conversations that are one segment."""
    kind = kind_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, roles, texts, copies, tmin, tmax, tkinds in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Segment(roles, texts, copies)
                dist = s.distances(GOAL)
                audit, lines, _ = repaired(s, dist, 0, True)
                gaps = tmax - tmin + 1 - tkinds if tkinds else 0
                out.append((conv, gaps, s.blank, s.duplicate, s.truncated, s.illegal, dist[0] + DELETE * sum(s.deletes), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
            names = ["conv", *[c.split()[0] for c in RESULT.split(", ")]]
            types = [b.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)

    return rows.select("conv", "roles", "texts", "copies", "tmin", "tmax", "tkinds").mapInArrow(run, f"conv {kind}, {RESULT}")


def _by_segment(rows: DataFrame, columns: list[str], schema: str, fn: Callable) -> DataFrame:
    """fn(row) for each segment in plain Python; the rows it returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                got = list(fn(b.slice(i, 1).to_pylist()[0]))
                if got:
                    yield pa.RecordBatch.from_pydict({c: pa.array(v) if t is None else pa.array(v, t) for (c, t), v in zip(kinds(b), zip(*got, strict=True), strict=True)})

    def kinds(b: pa.RecordBatch) -> list[tuple[str, pa.DataType | None]]:
        base = {"conv": b.column(0).type, "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        named = [x.strip().split(" ", 1) for x in schema.split(",")]
        return [(n, base["conv"] if n == "conv" else base[t]) for n, t in named]

    return rows.select(*columns).mapInArrow(run, schema)


def _long(rows: DataFrame) -> DataFrame:
    """Repair of conversations of any number of segments."""
    kind = kind_of(rows)
    texts = ["conv", "seg", "roles", "texts", "copies"]

    # which rows repeat an earlier one, wherever that is
    def digests(r: dict):
        for i, (role, text) in enumerate(zip(r["roles"], r["texts"], strict=True)):
            yield r["conv"], (r["seg"] << 13) | i, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()

    each = store(_by_segment(rows, texts, f"conv {kind}, at long, digest binary", digests), "digests")
    first = each.groupBy("conv", "digest").agg(F.min("at").alias("at"))
    later = each.join(first.select("at"), "at", "left_anti").groupBy(F.expr("shiftright(at, 13)").alias("seg")).agg(F.collect_list(F.col("at").bitwiseAND((1 << 13) - 1)).alias("again"))
    full = store(rows.join(later, "seg", "left").select("conv", *[c for c in rows.columns if c != "conv"], F.coalesce("again", F.expr("array()")).cast("array<long>").alias("again")), "marked")

    def of(r: dict) -> Segment:
        return Segment(r["roles"], r["texts"], r["copies"], set(r["again"]))

    def matrix(r: dict):
        s = of(r)
        to = [s.distances([0 if x == t else NEVER for x in range(4)])[:4] for t in range(4)]
        yield r["conv"], r["seg"], [to[t][x] for x in range(4) for t in range(4)]

    def from_the_end(p: pd.DataFrame) -> pd.DataFrame:
        """What each segment's last states are from the end; the last segment has the goal itself."""
        p = p.sort_values("seg", ascending=False)
        goal, goals = GOAL, []
        for m in p["m"]:
            goals.append(goal)
            goal = [min(min(m[4 * x + t] + goal[t] for t in range(4)), NEVER) for x in range(4)]
        return pd.DataFrame({"seg": p["seg"].to_numpy(), "goal": goals, "last": [1] + [0] * (len(p) - 1)})

    m = _by_segment(full, [*texts, "again"], f"conv {kind}, seg long, m array<long>", matrix)
    goals = store(m.groupBy("conv").applyInPandas(from_the_end, "seg long, goal array<long>, last long"), "goals")
    with_goal = full.join(goals, "seg")

    def walks(r: dict):
        s = of(r)
        dist = s.distances(r["goal"])
        yield r["conv"], r["seg"], [s.walk(dist, x, bool(r["last"]), lambda *a: None) if dist[x] < NEVER else 0 for x in range(4)]

    def from_the_start(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seg")
        state, at = 0, []
        for ends in p["ends"]:
            at.append(state)
            state = int(ends[state])
        return pd.DataFrame({"seg": p["seg"].to_numpy(), "state": at})

    w = _by_segment(with_goal, [*texts, "again", "goal", "last"], f"conv {kind}, seg long, ends array<long>", walks)
    starts = store(w.groupBy("conv").applyInPandas(from_the_start, "seg long, state long"), "starts")

    def parts(r: dict):
        s = of(r)
        dist = s.distances(r["goal"])
        audit, lines, end = repaired(s, dist, r["state"], bool(r["last"]))
        cost = dist[r["state"]] - (0 if r["last"] else r["goal"][end]) + DELETE * sum(s.deletes)
        yield r["conv"], r["seg"], r["tmin"], r["tmax"], r["tkinds"], *s.ends, s.blank, s.duplicate, s.truncated, s.illegal, cost, audit, len(lines), "\n".join(lines).encode()

    written = _by_segment(with_goal.join(starts, "seg"), [*texts, "again", "goal", "last", "state", "tmin", "tmax", "tkinds"], PART.format(kind), parts)
    return _digested(written, kind)


def _digested(parts: DataFrame, kind: str) -> DataFrame:
    """One row a conversation from its parts in order; a task streams the parts, and holds the audit and the digest's state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = None, None
        now: dict | None = None

        def result() -> pa.RecordBatch:
            gaps = now["tmax"] - now["tmin"] + 1 - now["kinds"] if now["kinds"] else 0
            row = (now["conv"], gaps, *now["sums"], "".join(now["audit"]), now["digest"].hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for b in batches:
            names = ["conv", *[c.split()[0] for c in RESULT.split(", ")]]
            types = [b.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if now is None or r["conv"] != now["conv"]:
                    if now is not None:
                        yield result()
                    now = {"conv": r["conv"], "kinds": 0, "tmin": None, "tmax": None, "tail": None, "sums": [0] * 5, "audit": [], "digest": hashlib.sha256(), "lines": 0}
                now["sums"] = [x + r[c] for x, c in zip(now["sums"], ("blank", "duplicate", "truncated", "illegal", "cost"), strict=True)]
                if r["head"] is not None:
                    now["sums"][3] += now["tail"] is not None and now["tail"] + r["head"] not in ("su", "ua", "au")
                    now["tail"] = r["tail"]
                if r["tkinds"]:
                    now["kinds"] += r["tkinds"] - (now["tmax"] == r["tmin"])
                    now["tmin"] = r["tmin"] if now["tmin"] is None else now["tmin"]
                    now["tmax"] = r["tmax"]
                now["audit"].append(r["audit"])
                if r["lines"]:
                    now["digest"].update(b"\n" * (now["lines"] > 0) + r["repaired"])
                    now["lines"] += r["lines"]
        if now is not None:
            yield result()

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "conv").sortWithinPartitions("conv", "seg").mapInArrow(run, f"conv {kind}, {RESULT}")


def repaired_conversations(damaged_rows: DataFrame) -> DataFrame:
    """conv and the columns of RESULT, for each conv of (conv, turn, role, text, copies) as damaged() returns them."""
    every = segments(damaged_rows)
    return _closed(every.where("NOT open")).unionByName(_long(every.where("open")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    tune(spark)
    return repaired_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("conv", "conv_id")
