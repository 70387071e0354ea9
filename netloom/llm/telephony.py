"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded to 16-bit PCM and resampled.

mu-law and A-law expand by 256-entry tables built from their rule; ADPCM blocks are decoded with numpy across all blocks of a
batch, one step for each nibble position. `media_pcm` and `with_pcm` give the PCM at the target rate as a binary column of little-endian
16-bit samples, to be stored like any column; the query's features are computed from that column.

Null and empty texts are a file of 192 spaces; null media have null PCM. A very long text is one file; files are decoded in groups of
bounded bytes. Repeated rows and equal texts have equal files, each row its own; ties cannot occur. An empty table gives no rows. to_media
and media_pcm read only the id and the text or media; with_pcm keeps all columns but replaces those named rate and pcm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from netloom.llm._shared import arrow_map, store, tune

#: Fixed values of the formats: WAV format tags, bytes of an ADPCM block's data, the IMA index steps; sample rates.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
UNIT = 192
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
RATE, TARGET_RATE = 8000, 16000
#: Bytes of files that are decoded together.
GROUP_BYTES = 1 << 20
#: The IMA step sizes, 89 of them, fixed values.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371,
    408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    part, exp = (a & 15) << 4, a >> 4 & 7
    size = np.where(exp == 0, part + 8, (part + 264) << np.maximum(exp - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def wav(codec: str, payload: bytes) -> bytes:
    """A WAV file around the codes; ADPCM data is cut into blocks of 192 bytes, each behind a header of predictor 0, index 0."""
    if codec == "adpcm":
        body = b"".join(b"\0\0\0\0" + payload[i : i + UNIT] for i in range(0, len(payload), UNIT))
        align, per_block, bits = UNIT + 4, 2 * UNIT + 1, 4
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * align // per_block, align, bits, 2, per_block)
        samples = per_block * (len(payload) // UNIT)
    else:
        body, fmt, samples = payload, struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0), len(payload)
    body_chunk = b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + body_chunk
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(data: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and codes of a stored file; ValueError for what isn't such a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate, align, body = 12, None, 0, 1, None
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate, _, align = struct.unpack_from("<HHIIH", data, at + 8)
        elif kind == b"data":
            body = data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    codec = next((k for k, v in TAGS.items() if v == tag), None)
    if codec is None or body is None:
        raise ValueError("not a telephony codec")
    return codec, rate, align, body


def payload_of(codec: str, align: int, body: bytes) -> bytes:
    """The codes without ADPCM block headers."""
    return b"".join(body[i + 4 : i + align] for i in range(0, len(body), align)) if codec == "adpcm" else body


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of equal-size mono IMA blocks (uint8 [blocks, size]): int16 [blocks, 2 * (size - 4) + 1]."""
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), len(STEPS) - 1)
    out = np.empty((n, 2 * (size - 4) + 1), np.int16)
    out[:, 0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int64)
    for i in range(size - 4):
        for half in (0, 1):
            c = codes[i] >> 4 if half else codes[i] & 15
            step = STEPS[index]
            move = (step >> 3) + np.where(c & 4, step, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 1, step >> 2, 0)
            value = np.clip(value + np.where(c & 8, -move, move), -32768, 32767)
            index = np.clip(index + INDEX_STEP[c & 7], 0, len(STEPS) - 1)
            out[:, 2 * i + half + 1] = value
    return out


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation on the target's time grid, in whole numbers so that every machine gives the same samples. To a lower rate, each
    sample is the mean of the samples that it stands for, which takes out what lies far above the new rate."""
    if rate == target or not len(pcm):
        return pcm.astype(np.int16)
    n = len(pcm) * target // rate
    if target < rate:
        cut = np.arange(n + 1, dtype=np.int64) * rate // target
        total = np.concatenate([[0], np.cumsum(pcm, dtype=np.int64)])[cut]
        return (np.diff(total) // np.diff(cut)).astype(np.int16)
    num = np.arange(n, dtype=np.int64) * rate
    i, frac = num // target, num % target
    a = pcm[i].astype(np.int64)
    b = pcm[np.minimum(i + 1, len(pcm) - 1)].astype(np.int64)
    return (a + (b - a) * frac // target).astype(np.int16)


def decode_batch(files: list[bytes], target: int = TARGET_RATE) -> list[np.ndarray]:
    """PCM at the target rate of each file; ADPCM blocks of one size are decoded together."""
    out: list[np.ndarray | None] = [None] * len(files)
    by_size: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for k, data in enumerate(files):
        codec, rate, align, body = read_wav(data)
        if codec == "adpcm":
            by_size.setdefault(align, []).append((k, rate, np.frombuffer(body, np.uint8).reshape(-1, align)))
        else:
            out[k] = resample(TABLES[codec][np.frombuffer(body, np.uint8)], rate, target)
    for group in by_size.values():
        pcm, at = decode_adpcm(np.concatenate([b for _, _, b in group])), 0
        for k, rate, b in group:
            out[k] = resample(pcm[at : at + len(b)].ravel(), rate, target)
            at += len(b)
    return out


def feature_of(codec: str, pcm: np.ndarray) -> str:
    """codec;samples;crc32 of the resampled PCM;root mean square;peak;zero crossings;share of silent 20 ms frames in percent."""
    x = pcm.astype(np.int64)
    frame = TARGET_RATE // 50
    whole = np.abs(x[: len(x) // frame * frame].reshape(-1, frame)).max(1) if len(x) >= frame else np.abs(x[None, :]).max(1)
    cross = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    rms = int(np.sqrt((x * x).sum() / max(1, len(x))))
    return f"{codec};{len(x)};{zlib.crc32(pcm.astype('<i2').tobytes())};{rms};{int(np.abs(x).max(initial=0))};{cross};{int(100 * (whole < 256).mean())}"


def codec_for(payload: bytes) -> str:
    """Which codec carries a payload: by its own bytes, so that equal texts have equal media."""
    return ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


def payload_for(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a stored telephony file. Null text is empty (192 spaces)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in b.column(1).to_pylist()]
        loads = [payload_for(x) for x in texts]
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "media": pa.array([wav(codec_for(x), x) for x in loads], pa.binary())})

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), run, "doc_id long, n_bytes long, media binary")


def with_pcm(media: DataFrame, target: int = TARGET_RATE, media_col: str = "media") -> DataFrame:
    """The rows with `rate` and `pcm`: the media column decoded and resampled, as little-endian 16-bit samples. Null media give null."""
    schema = media.drop("rate", "pcm")
    at = schema.columns.index(media_col)
    out = StructType([*schema.schema.fields, StructField("rate", LongType()), StructField("pcm", BinaryType())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        files = b.column(at).to_pylist()
        pcm: list[bytes | None] = [None] * len(files)
        some = [i for i, x in enumerate(files) if x is not None]
        sizes = np.cumsum([len(files[i]) for i in some]) // GROUP_BYTES if some else np.zeros(0, np.int64)
        for part in np.split(np.array(some, np.int64), np.flatnonzero(np.diff(sizes)) + 1):
            for i, x in zip(part.tolist(), decode_batch([files[i] for i in part], target), strict=True):
                pcm[i] = x.astype("<i2").tobytes()
        rate = pa.array([None if x is None else target for x in pcm], pa.int64())
        return pa.RecordBatch.from_arrays([*b.columns, rate, pa.array(pcm, pa.binary())], names=[*b.schema.names, "rate", "pcm"])

    return arrow_map(schema, run, out)


def media_pcm(media: DataFrame, target: int = TARGET_RATE, media_col: str = "media") -> DataFrame:
    """doc_id, rate, pcm of each file of a media column."""
    return with_pcm(media.select("doc_id", media_col), target, media_col).select("doc_id", "rate", "pcm")


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored files back: payload and media digests, and features of the resampled PCM."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data, pcm in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            codec, _, align, body = read_wav(data)
            p = payload_of(codec, align, body)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(codec, np.frombuffer(pcm, "<i2"))))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": b.column(1)} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return arrow_map(with_pcm(media.select("doc_id", "n_bytes", "media")).select("doc_id", "n_bytes", "media", "pcm"), run, out)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every document's file, read back from the table in which the files are stored."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_features(store(to_media(docs), "media"))
