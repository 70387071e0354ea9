"""Token-count rollups maintained by signed deltas.

A rollup is a folder. Each batch is a table of deltas, summed by source, language and tokenizer version: inserts add, deletes
subtract, a revised count does both. A batch counts from the moment its mark `commit-<batch>` exists, a small file that names its table and
that is moved into place only if no such file is there. So batches may come in any order and many at a time, and a repeated or
retried batch changes nothing, whatever it holds. Totals are the sum over commits.

`compact` folds the commits of one listing into a new base, whose mark names its table and all batches that it holds. Marks of batches never
move, so a name is taken once and for all, whoever folds meanwhile. Readers take the newest base, leave out what it lists, and look again
if a newer one has come meanwhile.

Null source or language is a group of its own. Null and empty texts count as documents of no tokens; very long texts count whole; repeated rows
and equal ids count as often as they stand there. An empty batch is a commit without rows, and totals without commits have no rows. Sums do not
depend on order or ties. Only the named columns are read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import _words
from netloom.llm._shared import fresh_path, local_path, store, tune
from netloom.llm.token_binary import encoder

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def signed(counts: DataFrame, tokenizer: str, sign: int, tokens: str = "n_tokens") -> DataFrame:
    """Deltas of documents with their counts: sign 1 inserts, -1 deletes."""
    return counts.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.col(tokens) * sign).cast("long").alias("tokens"))


def revised(counts: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """Deltas that replace the count in column `old` by that in `new`."""
    return signed(counts, tokenizer, -1, old).unionByName(signed(counts, tokenizer, 1, new))


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        """Names of the marks of one kind."""
        path, fs = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        return sorted(n[len(kind) + 1 :] for s in fs.listStatus(path(self.folder)) if (n := s.getPath().getName()).startswith(kind + "-"))

    def _exists(self, name: str) -> bool:
        path, fs = self._fs()
        return fs.exists(path(f"{self.folder}/{name}"))

    def _read(self, mark: str) -> list[str]:
        path, fs = self._fs()
        stream = fs.open(path(f"{self.folder}/{mark}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()

    def _mark(self, name: str, lines: list[str]) -> bool:
        """Write a whole file and give it its name, unless a file of that name is there: then False."""
        path, fs = self._fs()
        draft, to = path(f"{self.folder}/draft-{uuid.uuid4().hex}"), path(f"{self.folder}/{name}")
        stream = fs.create(draft, False)
        stream.write(bytearray("\n".join(lines).encode()))
        stream.close()
        try:
            if (local := local_path(self.folder)) is not None:
                os.link(f"{local}/{draft.getName()}", f"{local}/{name}")  # a local rename would replace the file
                return True
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, to, none)
            return True
        except Exception:
            if not self._exists(name):
                raise
            return False
        finally:
            fs.delete(draft, False)

    def _base(self) -> tuple[str | None, list[str]]:
        """The newest base's table, and the batches that it holds."""
        names = self._names("base")
        if not names:
            return None, []
        table, *batches = self._read(f"base-{names[-1]}")
        return table, batches

    def apply(self, batch: str, deltas: DataFrame) -> bool:
        """Commit a batch; False if a batch of this name is there already."""
        name = quote(batch, safe="")
        if self._exists(f"commit-{name}"):
            return False
        table = f"data-{uuid.uuid4().hex}"
        deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0").write.parquet(f"{self.folder}/{table}")
        if self._mark(f"commit-{name}", [table]):
            return True
        path, fs = self._fs()
        fs.delete(path(f"{self.folder}/{table}"), True)
        return False

    def batches(self) -> list[str]:
        """Names of the batches since the newest base."""
        held = set(self._base()[1])
        return [unquote(n) for n in self._names("commit") if n not in held]

    def _listing(self) -> tuple[str | None, list[str], dict[str, str]]:
        """The newest base's table, the batches in it, and the table of each commit that is not."""
        while True:
            table, held = self._base()
            known = set(held)
            found = {n: self._read(f"commit-{n}")[0] for n in self._names("commit") if n not in known}
            if self._base()[0] == table:
                return table, held, found

    def _sum(self, base: str | None, commits: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/{t}" for t in [*commits.values(), *([base] if base else [])]]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of what is there."""
        base, _, commits = self._listing()
        return self._sum(base, commits)

    def compact(self) -> None:
        """Fold the commits of one listing into a new base. A commit that comes meanwhile is in none of both and counts on its own; of two
        that compact at a time one does nothing."""
        names = self._names("base")
        base, held, commits = self._listing()
        if not commits or len(self._names("base")) != len(names):
            return
        table = f"data-{uuid.uuid4().hex}"
        self._sum(base, commits).write.parquet(f"{self.folder}/{table}")
        self._mark(f"base-{int(names[-1]) + 1 if names else 1:08d}", [table, *held, *commits])


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, t1 and t2 (hashes of the text, 128 bits together), source, lang, n_tokens (without end id) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts, n = b.column(5).to_pylist(), []
            for i in range(0, len(texts), 64):
                n += [len(x) // 4 for x in enc.encode(texts[i : i + 64])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(n, pa.int64())], ["doc_id", "t1", "t2", "source", "lang", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, t1 long, t2 long, source string, lang string, n_tokens long")


def without_copies(counts: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    """Deltas that delete all rows of each text but one, that of the smallest doc_id (null last; then source and language, then any of
    the equal rows): minus all, plus that one, so that no task sees all copies of a text."""
    one = counts.groupBy("t1", "t2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "source", "lang", tokens)).alias("x")).select("x.source", "x.lang", f"x.{tokens}")
    return signed(counts, tokenizer, -1, tokens).unionByName(signed(one, tokenizer, 1, tokens))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, lang, tokenizer, docs, tokens after four batches over all documents: insert; revise every count to include the end id; delete
    all copies of a text but one; and the first batch once more, which must change nothing."""
    tune(spark)
    counts = store(count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), _words.default_tokenizer()), "token_counts")
    counts = counts.withColumn("with_end", F.col("n_tokens") + 1)
    rollup, name = TokenRollup(spark, fresh_path(spark, "rollup")), "word_bpe_49k/1"
    rollup.apply("0001-insert", signed(counts, name, 1))
    rollup.apply("0002-revise", revised(counts, name, "n_tokens", "with_end"))
    rollup.apply("0003-delete", without_copies(counts, name, "with_end"))
    rollup.apply("0001-insert", signed(counts, name, 1))
    return rollup.totals()
