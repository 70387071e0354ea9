"""Quality rules as weak supervision, in DataFrame functions only.

Every rule reads a few counts of a text and votes 1 (good), -1 (bad) or 0 (abstains). Expectation-maximisation over the table
of vote patterns (at most 3**rules rows, whatever the corpus) estimates how often each rule is right on good and on bad
documents, and the posterior probability of `good` replaces the all-must-pass verdict. Base limits (too few words, too many
repeated 8-word windows) reject a document beforehand; such documents take no part in the estimate.

EM needs a corpus: among a few dozen documents, junk that a single rule notices may pass as good.

A null or empty text has no words: every count is 0 and base_failed is true. Null ids and repeated rows stay as they are, and each repeated
row votes. Very long texts are counted whole. The order of rows plays no part; a posterior that ties with KEEP_AT keeps. An empty
table gives no rows. Only the id and the text are read; keep_good gives all columns back, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm._shared import store

WINDOW = 8
#: Fixed values of the base limits.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
KEEP_AT = 0.5
ROUNDS = 12
#: Pseudo-counts of each rule's votes (right, wrong) on good and on bad documents: a rule seldom rejects a good one, but knows one kind of
#: bad ones only, so its approval says little.
PRIOR_GOOD, PRIOR_BAD = (19.0, 1.0), (1.0, 1.0)
#: Each rule: name, condition for `bad`, condition for `good`, over the count columns; both are SQL that Spark and DuckDB read alike.
RULES = [
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("repeats", "10 * n_repeat_words > n_words", "n_repeat_words = 0"),
    ("lines", "4 * n_dup_lines > n_lines", "n_dup_lines = 0"),
    ("capitals", "10 * n_upper > 4 * word_chars", "10 * n_upper < word_chars"),
    ("shouts", "10 * n_shouts > n_words", "100 * n_shouts <= n_words"),
    ("lengths", "word_chars > 14 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 11 * n_words"),
    ("stops", "40 * n_stops < n_words", "25 * n_stops > n_words"),
    ("variety", "5 * n_distinct < n_words AND n_words < 400", "3 * n_distinct > n_words"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and give it to `body` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more in the array, the first occurrence included."""

    def covered(marked: Column) -> Column:
        size = F.size(marked)
        steps = F.transform(marked, lambda p, k: F.when(k == size - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(marked, k + 1) - p)))
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    def in_order(s: Column) -> Column:
        alike = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: F.when(k > 0, alike(x, k - 1)).otherwise(F.lit(False)) | alike(x, k + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def of_windows(h: Column) -> Column:
        slow = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), in_order)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow)

    def of_words(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        return F.when(n < WINDOW + 1, F.lit(0)).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of_words)


def count_columns(text: Column) -> list[Column]:
    """The counts that base limits and rules read."""
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "")
    pair = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), repeated_words(w).alias("r"), F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("s"))
    line_pair = lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))
    of = lambda c: c.cast("long")
    less = lambda chars: F.length(text) - F.length(without(text, chars))
    return [
        let(word_array(text), pair).alias("_w"), let(lines, line_pair).alias("_l"), of(F.length(without(text, SPACES))).alias("word_chars"),
        of(less(SYMBOLS)).alias("n_symbols"), of(less("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"), of(less("!")).alias("n_shouts"),
    ]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_stops", "n_distinct"]


def with_votes(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` as _k0.., the counts, base_failed and one vote column per rule."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], *count_columns(text))
    rows = rows.select(
        *[f"_k{i}" for i in range(len(keep))], "word_chars", "n_symbols", "n_upper", "n_shouts",
        *[F.col(x).cast("long").alias(y) for x, y in (("_w.n", "n_words"), ("_w.d", "n_distinct"), ("_w.r", "n_repeat_words"), ("_w.s", "n_stops"), ("_l.n", "n_lines"), ("_l.d", "n_dup_lines"))],
    )
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    votes = [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(f"v_{name}") for name, bad, good in RULES]
    return rows.select("*", failed.alias("base_failed"), *votes)


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """EM over vote patterns: prior log odds of `good`, and each rule's log likelihood ratio by vote. An abstention says nothing."""
    rules = len(RULES)
    post = {p: (0.95 if min(p) >= 0 else 0.05) for p in patterns}
    odds, weights = 0.0, [{1: 0.0, -1: 0.0} for _ in range(rules)]
    for _ in range(rounds):
        good = 1.0 + sum(c * post[p] for p, c in patterns.items())
        bad = 1.0 + sum(c * (1 - post[p]) for p, c in patterns.items())
        odds = math.log(good / bad)
        for j in range(rules):
            gp = sum(c * post[p] for p, c in patterns.items() if p[j] == 1)
            gn = sum(c * post[p] for p, c in patterns.items() if p[j] == -1)
            bp = sum(c * (1 - post[p]) for p, c in patterns.items() if p[j] == 1)
            bn = sum(c * (1 - post[p]) for p, c in patterns.items() if p[j] == -1)
            right_good = (gp + PRIOR_GOOD[0]) / (gp + gn + sum(PRIOR_GOOD))
            right_bad = (bn + PRIOR_BAD[0]) / (bp + bn + sum(PRIOR_BAD))
            weights[j] = {1: math.log(right_good / (1 - right_bad)), -1: math.log((1 - right_good) / right_bad)}
        post = {p: 1 / (1 + math.exp(-(odds + sum(w.get(v, 0.0) for w, v in zip(weights, p, strict=True))))) for p in patterns}
    return odds, weights


def judged(votes: DataFrame) -> DataFrame:
    """Adds p_good and kept. `votes` is a stored table: the pattern counts are one aggregation over it."""
    names = [f"v_{name}" for name, _, _ in RULES]
    table = votes.where("NOT base_failed").groupBy(*names).count().collect()
    odds, weights = estimate({tuple(r[:-1]): r[-1] for r in sorted(table)})
    score = F.lit(odds)
    for name, w in zip(names, weights, strict=True):
        score = score + F.when(F.col(name) == 1, F.lit(w[1])).when(F.col(name) == -1, F.lit(w[-1])).otherwise(F.lit(0.0))
    p = 1 / (1 + F.exp(-score))
    return votes.withColumn("p_good", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    votes = store(with_votes(docs, [id_col], text_col), "quality")
    return judged(votes).withColumnRenamed("_k0", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents with the columns of `docs`, in its order."""
    cols = docs.columns
    votes = store(with_votes(docs, cols, text_col), "quality")
    return judged(votes).where("kept").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(cols)])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The same in DuckDB: counts from unnested words, EM as unrolled steps over the pattern table."""
    space = r"[^\x20\x09-\x0D]"
    names = [f"v_{name}" for name, _, _ in RULES]
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{name}" for name, bad, good in RULES)
    less = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    ctes = [
        "d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)",
        f"w AS MATERIALIZED (SELECT rid, doc_id, t, regexp_extract_all(t, '{space}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS ls FROM d)",
        f"g AS MATERIALIZED (SELECT rid, i, list_slice(ws, i, i + {WINDOW - 1}) AS s FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i) WHERE len(ws) >= {WINDOW})",
        "m AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1)",
        f"r AS (SELECT rid, sum(CASE WHEN nxt IS NULL THEN {WINDOW} ELSE least({WINDOW}, nxt - i) END) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM m) GROUP BY rid)",
        f"c AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(ws || [''], 'string_agg', '')) AS BIGINT) AS word_chars, {less(SYMBOLS)} AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, "
        f"CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, {less('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} AS n_upper, {less('!')} AS n_shouts, len(list_filter(ws, lambda x: length(x) <= 3)) AS n_stops, len(list_distinct(ws)) AS n_distinct FROM w LEFT JOIN r USING (rid))",
        f"v AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {votes} FROM c)",
        f"p AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS c FROM v WHERE NOT base_failed GROUP BY ALL)",
        f"q0 AS MATERIALIZED (SELECT *, CASE WHEN least({', '.join(names)}) >= 0 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE END AS g FROM p)",
    ]
    for k in range(ROUNDS):
        parts = []
        for j, n in enumerate(names):
            rg = f"(sum(CASE WHEN {n} = 1 THEN c * g ELSE 0 END) + {PRIOR_GOOD[0]}) / (sum(CASE WHEN {n} <> 0 THEN c * g ELSE 0 END) + {sum(PRIOR_GOOD)})"
            rb = f"(sum(CASE WHEN {n} = -1 THEN c * (1 - g) ELSE 0 END) + {PRIOR_BAD[0]}) / (sum(CASE WHEN {n} <> 0 THEN c * (1 - g) ELSE 0 END) + {sum(PRIOR_BAD)})"
            parts.append(f"{rg} AS rg{j}, {rb} AS rb{j}")
        ctes.append(f"e{k} AS MATERIALIZED (SELECT ln((1 + coalesce(sum(c * g), 0)) / (1 + coalesce(sum(c * (1 - g)), 0))) AS o, {', '.join(parts)} FROM q{k})")
        score = " + ".join(["o", *[f"CASE {n} WHEN 1 THEN ln(rg{j} / (1 - rb{j})) WHEN -1 THEN ln((1 - rg{j}) / rb{j}) ELSE 0 END" for j, n in enumerate(names)]])
        ctes.append(f"q{k + 1} AS MATERIALIZED (SELECT {', '.join(names)}, c, 1 / (1 + exp(-({score}))) AS g FROM p, e{k})")
    on = ", ".join(names)
    return f"WITH {', '.join(ctes)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(g, 0) >= {KEEP_AT} AS kept FROM v LEFT JOIN q{ROUNDS} USING ({on})"
