"""Token ids in fixed-width bit-packed shard files.

File format (little-endian): magic `NLPKID02`; uint32 bits, uint32 ids per block; uint64 ids, documents, documents without id (they come
first), blocks; int64 doc_id[documents] (0 for no id), uint64 first id of each document [documents + 1], uint64 byte
offset of each block [blocks + 1]; then the blocks. A block holds its ids in `bits` bits each, lowest bit first, and
starts on a byte, so one block is unpacked by one numpy call and any id is reached without reading the others.
`bits` is the least that the vocabulary needs: ids 0..49407 take 16.

Null and empty texts have the end id alone. Rows of null doc_id come first; equal ids are ordered by the text's hash, so repeated rows
stand side by side. A task begins a new file after FILE_IDS ids, so it never holds a shard of more than these and one document; a very long
text is one document of one file. An empty table gives no files and no rows. Only the id and the text are read, so other columns may have
any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import _words
from netloom.llm._shared import fresh_path, get_file, put_file, tune

MAGIC = b"NLPKID02"
HEAD = struct.Struct("<8sIIQQQQ")
#: Ids in a block; words kept by a worker; bytes of text that a task is planned for, and tasks at most; ids after which a file ends.
BLOCK = 4096
KEEP_WORDS = 800_000
TASK_BYTES, MAX_TASKS = 24 << 20, 20_000
FILE_IDS = 32 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_shard(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK, nulls: int = 0) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    packed = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    at = np.zeros(len(packed) + 1, "<u8")
    np.cumsum([len(x) for x in packed], out=at[1:])
    head = HEAD.pack(MAGIC, bits, block, len(ids), len(doc_ids), nulls, len(packed))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes(), at.tobytes(), *packed])


class Shard:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.bits, self.block, self.n_ids, n_docs, self.nulls, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at := at + 8 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * (n_docs + 1)).astype(np.int64)
        self.body = at + 8 * (n_blocks + 1)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi-1, unpacking only the blocks that hold them."""
        if lo >= hi:
            return np.zeros(0, np.uint32)
        b0, b1 = lo // self.block, (hi - 1) // self.block + 1
        if self.block * self.bits % 8 == 0:
            n = min(self.n_ids, b1 * self.block) - b0 * self.block
            got = unpack(self.data[self.body + self.offsets[b0] : self.body + self.offsets[b1]], self.bits, n)
        else:
            got = np.concatenate([unpack(self.data[self.body + self.offsets[b] : self.body + self.offsets[b + 1]], self.bits, min(self.block, self.n_ids - b * self.block)) for b in range(b0, b1)])
        return got[lo - b0 * self.block : hi - b0 * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def newest(table: dict, keep: int) -> dict:
    """The table, or its newer half if it has more than `keep` entries; frequent entries come back with the next texts."""
    return dict(islice(table.items(), len(table) // 2, None)) if len(table) > keep else table


class Encoder:
    """The tokenizers library over distinct pretokens; bounded tables keep what it gave for them and for runs between white space."""

    def __init__(self, path: str):
        self.tokenizer, self.words, self.runs = _words.library(path), {}, {}
        vocab = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[i for s, i in vocab.items() if s.endswith("</w>")]] = True

    def learn(self, new: list[str]) -> None:
        """Encode some pretokens as one text and cut its ids where words end."""
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cut = (4 * (np.flatnonzero(self.final[ids]) + 1)).tolist()
            data = ids.tobytes()
            self.words.update(zip(some, [data[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian uint32."""
        split = [_words.units(x) if x else [] for x in texts]
        self.words, self.runs = newest(self.words, KEEP_WORDS), newest(self.runs, KEEP_WORDS)
        if runs := list(set().union(*[x for x in split if x]).difference(self.runs)):
            pieces = list(map(_words.SPLIT.findall, runs))
            if new := set().union(*pieces).difference(self.words):
                self.learn(list(new))
            word = self.words.__getitem__
            self.runs.update(zip(runs, [word(p[0]) if len(p) == 1 else b"".join(map(word, p)) for p in pieces], strict=True))
        get = self.runs.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, whose tasks share its table."""
    return Encoder(path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> list[tuple]:
    """Encode every whole text, append `end_id`, write files in ascending id order (null ids first; equal ids by text
    hash), by `shards` tasks over ranges of ids. Returns the manifest (shard, path, documents, ids) in order: one entry for each file, the
    only thing that the driver sees. A file gets its name in one step, so a repeated task replaces it by equal bytes. Empty table: no files.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("tie", F.xxhash64("t")).repartitionByRange(shards, "k", "tie").sortWithinPartitions("k", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        bits = bits_for(enc.tokenizer.get_vocab_size())
        end = np.array([end_id], "<u4").tobytes()
        keys, lens, packed, nulls, size = [], [], [], 0, 0

        def file() -> pa.RecordBatch:
            starts = np.zeros(len(lens) + 1, np.int64)
            np.cumsum(lens, out=starts[1:])
            path = f"{folder}/shard_{part:06d}_{made:06d}.tok"
            put_file(path, write_shard(np.concatenate(keys), starts, np.concatenate(packed), bits, nulls=nulls))
            return pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int64()), "path": [path], "docs": pa.array([len(lens)], pa.int64()), "ids": pa.array([int(starts[-1])], pa.int64())})

        for b in batches:
            k, texts = b.column(0), b.column(1).to_pylist()
            for i in range(0, len(texts), 64):
                some = k.slice(i, 64)
                got = enc.encode(texts[i : i + 64])
                keys.append(some.fill_null(0).to_numpy(zero_copy_only=False))
                nulls += some.null_count
                lens += [len(x) // 4 + 1 for x in got]
                packed.append(np.frombuffer(b"".join(x + end for x in got), "<u4").astype("<u2" if bits <= 16 else "<u4"))
                size += len(packed[-1])
                if size >= file_ids:
                    yield file()
                    made += 1
                    keys, lens, packed, nulls, size = [], [], [], 0, 0
        if lens:
            yield file()

    return sorted((tuple(r) for r in rows.select("k", "t").mapInArrow(run, "shard long, path string, docs long, ids long").collect()), key=lambda r: r[1])


def read_token_files(spark: SparkSession, manifest: list[tuple]) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, shard. `start` counts the ids of all
    documents before it, by the manifest's running totals."""
    base, rows = 0, []
    for i, (_, path, _, ids) in enumerate(manifest):
        rows.append((i, path, base))
        base += ids
    frame = spark.createDataFrame(rows, "shard long, path string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Shard(get_file(path))
                for lo in range(0, len(s.doc_ids), 4096):
                    hi = min(lo + 4096, len(s.doc_ids))
                    crc = [zlib.crc32(s.doc(i).astype("<u4").tobytes()) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(s.doc_ids[lo:hi], pa.int64(), mask=np.arange(lo, hi) < s.nulls), "start": pa.array(first + s.starts[lo:hi]),
                        "n_tokens": pa.array(np.diff(s.starts[lo : hi + 1])), "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array([shard] * (hi - lo), pa.int64()),
                    })

    out = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"
    if not rows:
        return spark.createDataFrame([], out)
    return frame.repartition(max(1, len(rows)), "shard").mapInArrow(run, out)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard (number of the file) of every document, read from the files."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(4, min(MAX_TASKS, -(-int(size) // TASK_BYTES)))
    return read_token_files(spark, write_token_files(docs, fresh_path(spark, "tokens"), _words.default_tokenizer(), 1, tasks))
