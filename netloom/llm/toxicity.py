"""Toxicity: a sparse linear classifier with a counterfactual penalty.

A document's features are the distinct words it holds (letters, lower case) and their first 4 to 7 bytes, as 64-bit hashes, so no
two share a weight; a beginning that several different words have is a feature of its own, which is what finds stems that a language
compounds.
It learns from a bounded sample of labelled rows (MAX_TRAIN, the smallest by hash of the id). For labelled sentences that hold an
identity term the term is swapped for each other one, or dropped, and the change of the score over all features (the word and its
beginnings) is penalised; every term is also put into neutral sentences. Of a text only the words that start like a term matter for
that change, so these are what the driver gets. L1 keeps only words that carry the label, which is what makes long clean texts safe.

The fit has three documented bounds: MAX_TRAIN labelled rows, MAX_TRAIN_BYTES of their features (rows in hash order up to that, at least
one), and MAX_FEATURES features of those rows, the ones that tell most about the label, with all identity terms among them. Scoring
has none. The rows stay a table on the executors, which count their features and choose those; only the chosen features of each row reach the
driver, two bytes each.

Null and empty texts score the bias alone and teach nothing if null. Rows without id or label teach nothing. Of repeated labels of one id the
largest counts; equal feature sets (copies of a text among them) teach once. Ties of the hash order are broken by id. A very long
text is read whole, in learning and in scoring. Empty labels, or labels of one kind, give a model of the bias alone; an empty table gives no
rows. Only doc_id, text and toxic are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import _bytes as B
from netloom.llm._shared import discard, store, tune

MAX_TRAIN, MAX_TRAIN_BYTES = 8000, 64 << 20
#: Bytes of word beginnings; different words of one beginning that make it a feature of its own.
BEGINNINGS, SEVERAL = (4, 5, 6, 7), 3
MAX_FEATURES = 4096
THRESHOLD = 0.7
#: Weight of the counterfactual penalty, of L1 (over the root of the rows), and gradient steps.
COUNTERFACTUAL, L1, STEPS = 5.0, 0.09, 600
#: Fixed word list: terms that name groups of people and are neutral in themselves.
IDENTITY = """women woman men man girl boy female male gay lesbian bisexual transgender trans queer straight heterosexual homosexual
muslim islam christian catholic protestant jew jewish hindu buddhist sikh atheist black white asian african latino latina hispanic
arab american european mexican chinese indian japanese german french spanish immigrant immigrants refugee refugees foreigner disabled
deaf blind autistic elderly old young teenager frauen männer muslime juden christen ausländer femmes hommes musulmans juifs chrétiens
mujeres hombres musulmanes judíos cristianos""".split()
#: Bytes that two words must share at the start before the features of one depend on the other.
STEM = min(BEGINNINGS)


def row_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes and their rows, sorted by row and hash."""
    start, end, row = B.words(buf, offs, B.LETTER)
    h = B.span_hashes(buf, start, end)
    order = np.lexsort((h, row))
    h, row, start, end = h[order], row[order], start[order], end[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row, start, end = h[new], row[new], start[new], end[new]
    hs, rs = [h], [row]
    for n in BEGINNINGS:
        long = end - start > n
        p = B.mix(B.span_hashes(buf, start[long], start[long] + n) + np.uint64(n))
        order = np.lexsort((p, row[long]))
        p, r = p[order], row[long][order]
        first = np.ones(len(p), bool)
        first[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
        count = np.diff(np.append(np.flatnonzero(first), len(p)))
        p, r = p[first], r[first]
        hs += [p, B.mix(p[count >= SEVERAL] + np.uint64(0xABCDEF))]
        rs += [r, r[count >= SEVERAL]]
    h, row = np.concatenate(hs), np.concatenate(rs)
    order = np.lexsort((h, row))
    return h[order], row[order]


def word_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature hashes of each row: values and offsets."""
    h, row = row_features(buf, offs)
    return h, np.searchsorted(row, np.arange(len(offs)))


def hash_words(words: list[str]) -> np.ndarray:
    """The features that stand for whole words."""
    buf, offs = B.column(pa.array(words))
    return B.span_hashes(buf, offs[:-1], offs[1:])


def stem(word: str) -> bytes:
    return word.encode()[:STEM]


def near_terms(buf: np.ndarray, offs: np.ndarray) -> list[str]:
    """Of each row that holds an identity term, its distinct words (lower case) that start like any term; else an empty text."""
    start, end, row = B.words(buf, offs, B.LETTER)
    short = [t.encode() for t in IDENTITY]
    first = B.span_hashes(np.frombuffer(b"".join(t[:STEM] for t in short), np.uint8), *_spans([len(t[:STEM]) for t in short]))
    like = np.isin(B.span_hashes(buf, start, np.minimum(end, start + STEM)), first)
    start, end, row = start[like], end[like], row[like]
    held = np.isin(np.arange(len(offs) - 1), row[np.isin(B.span_hashes(buf, start, end), hash_words(IDENTITY))])
    found: dict[int, set[str]] = {}
    for a, z, r in zip(start.tolist(), end.tolist(), row.tolist(), strict=True):
        if held[r]:
            found.setdefault(r, set()).add(buf[a:z].tobytes().lower().decode(errors="replace"))
    return [" ".join(sorted(found.get(i, ()))) for i in range(len(offs) - 1)]


def _spans(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum(lengths)
    return end - lengths, end


def swap_form(near: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and the matrix M for which w'Mw is the mean squared change of the score when a term is dropped, plus that when it is swapped
    for another one, all others alike. `near` counts texts of near_terms()."""
    terms = list(dict.fromkeys(IDENTITY))
    near = near + Counter(terms)  # neutral sentences
    cache: dict[tuple, int] = {}
    vectors: dict[frozenset, int] = {}

    def change(before: list[str], after: list[str]) -> int:
        key = (tuple(before), tuple(after))
        if key not in cache:
            h, row = row_features(*B.column(pa.array([" ".join(before), " ".join(after)])))
            x, y = set(h[row == 0].tolist()), set(h[row == 1].tolist())
            cache[key] = vectors.setdefault(frozenset({(f, -1) for f in x - y} | {(f, 1) for f in y - x}), len(vectors))
        return cache[key]

    plain = np.array([change([], [b]) for b in terms])
    alike: dict[bytes, list[int]] = {}
    for i, b in enumerate(terms):
        alike.setdefault(stem(b), []).append(i)
    drops: Counter[int] = Counter()
    swaps: dict[int, np.ndarray] = {}
    for text, c in near.items():
        groups: dict[bytes, list[str]] = {}
        for w in text.split():
            groups.setdefault(stem(w), []).append(w)
        added = plain.copy()
        for g, ws in groups.items():
            for i in alike.get(g, ()):
                added[i] = change(ws, sorted({*ws, terms[i]}))
        for g, ws in groups.items():
            for i in alike.get(g, ()):
                if terms[i] not in ws:
                    continue
                rest = [w for w in ws if w != terms[i]]
                r, to = change(ws, rest), added.copy()
                for j in alike[g]:
                    to[j] = change(rest, sorted({*rest, terms[j]}))
                drops[r] += c
                count = np.bincount(np.delete(to, i), minlength=len(vectors)) * float(c)
                if r in swaps:
                    count[: len(swaps[r])] += swaps[r]
                swaps[r] = count
    hashes = np.unique(np.array([f for v in vectors for f, _ in v], np.uint64))
    d = np.zeros((len(vectors), len(hashes)))
    for v, i in vectors.items():
        for f, sign in v:
            d[i, np.searchsorted(hashes, np.uint64(f))] = sign
    pair = np.zeros((len(vectors), len(vectors)))
    for r, count in swaps.items():
        pair[r, : len(count)] = count / (len(terms) - 1)
    form = pair + pair.T
    form[np.diag_indices(len(form))] += pair.sum(0) + pair.sum(1)
    for r, c in drops.items():
        form[r, r] += c
    return hashes, d.T @ form @ d / sum(drops.values())


class Model:
    """Weights of words by sorted hash, and a bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(words)
        self.words, self.weights, self.bias = words[order], weights[order], float(bias)

    def score(self, arr: pa.Array) -> np.ndarray:
        buf, offs = B.column(arr)
        out = np.full(len(offs) - 1, self.bias)
        if len(self.words):
            for lo, hi, b, o in B.parts(buf, offs):
                h, row = row_features(b, o)
                at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                hit = self.words[at] == h
                out[lo:hi] += np.bincount(row[hit], self.weights[at[hit]], hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def gain(vocab: np.ndarray, pos: np.ndarray, both: np.ndarray, n: int, toxic: float) -> np.ndarray:
    """What each feature tells about the label, given its toxic rows and all its rows, of n rows with `toxic` toxic ones; identity terms are always wanted."""
    mean = toxic / n
    p, q = (pos + 0.5) / (toxic + 1), (both - pos + 0.5) / (n - toxic + 1)
    worth = np.where(both >= 3, np.abs(pos - both * mean) / np.sqrt(both * mean + 1) * np.abs(np.log(p / q)), 0)
    return np.where(np.isin(vocab, hash_words(IDENTITY)), np.inf, worth)


def train(features: list[np.ndarray], labels: np.ndarray, near: list[str] | None = None) -> Model:
    """Proximal gradient steps on logistic loss + COUNTERFACTUAL * mean squared score change over swapped pairs + L1. `near` gives each
    row's text of near_terms(); without it a row's terms stand alone."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 20)
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.log(rate / (1 - rate)))
    row = np.repeat(np.arange(len(y)), [len(f) for f in features])
    vocab, col = np.unique(np.concatenate(features), return_inverse=True)
    worth = gain(vocab, np.bincount(col, y[row], len(vocab)), np.bincount(col, minlength=len(vocab)), len(y), y.sum())
    chosen = np.sort(np.argsort(-worth, kind="stable")[: min(MAX_FEATURES, len(vocab))])
    place = np.full(len(vocab), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    k = len(chosen)
    if near is None:
        word = dict(zip(hash_words(IDENTITY).tolist(), IDENTITY, strict=True))
        near = [" ".join(sorted(word[h] for h in f.tolist() if h in word)) for f in features]
    swapped, form = swap_form(Counter(t for t in near if t))
    at = np.minimum(np.searchsorted(vocab[chosen], swapped), k - 1)
    hit = vocab[chosen][at] == swapped
    part, form = at[hit], form[np.ix_(hit, hit)]
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, v, b, vb, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    per_row = np.bincount(row, minlength=len(y))
    rate = 4.0 / max(1.0, float((weight * (per_row + 1)).sum()) + 8 * COUNTERFACTUAL * np.linalg.eigvalsh(form).max(initial=0.0))
    for _ in range(STEPS):
        z = vb + np.bincount(row, v[col], len(y))
        d = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(col, d[row], k)
        g[part] += 2 * COUNTERFACTUAL * form @ v[part]
        new = v - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * L1 / np.sqrt(len(y)), 0)
        nb = vb - rate * d.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    on = np.abs(w) > 1e-9
    return Model(vocab[chosen][on], w[on], b)


def not_held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def choose(rows: DataFrame, n: int, toxic: float) -> np.ndarray:
    """The MAX_FEATURES features of `rows` (toxic, f; n rows) that tell most about the label, sorted. They are counted on the executors."""
    top = np.uint64(1 << 63)  # so that the order of longs is that of the hashes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            vocab, col = np.unique(np.concatenate(f), return_inverse=True)
            pos = np.bincount(col, np.repeat(b.column(0).to_numpy().astype(float), [len(x) for x in f]), len(vocab))
            yield pa.RecordBatch.from_pydict({"key": pa.array((vocab ^ top).view(np.int64)), "pos": pa.array(pos), "n": pa.array(np.bincount(col, minlength=len(vocab)).astype(np.int64))})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, pos, both = (b.column(i).to_numpy() for i in range(3))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "gain": pa.array(gain(key.view(np.uint64) ^ top, pos, both, n, toxic))})

    counts = rows.select("toxic", "f").mapInArrow(count, "key long, pos double, n long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    best = counts.mapInArrow(weigh, "key long, gain double").orderBy(F.desc("gain"), "key").limit(MAX_FEATURES).select("key").collect()
    return np.sort(np.array([r["key"] for r in best], np.int64).view(np.uint64) ^ top)


def chosen_only(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(h, toxic, near, at): of each row's features the places of those that were chosen, as 2-byte integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = []
            for x in b.column(3).to_pylist():
                f = np.frombuffer(x, np.uint64)
                k = np.minimum(np.searchsorted(chosen, f), max(0, len(chosen) - 1))
                at.append(k[chosen[k] == f].astype(np.uint16).tobytes() if len(chosen) else b"")
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(at, pa.binary())], ["h", "toxic", "near", "at"])

    return rows.select("h", "toxic", "near", "f").mapInArrow(run, "h long, toxic int, near string, at binary")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample. Rows without id, text or label don't teach; the sample's ids are broadcast (MAX_TRAIN rows at most)."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(not_held_out("doc_id"))
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels_ = b.column(0).to_pylist()
            buf, offs = B.column(b.column(1))
            for lo, hi, x, o in B.parts(buf, offs):
                vals, at = word_features(x, o)
                yield pa.RecordBatch.from_pydict({"toxic": pa.array(labels_[lo:hi], pa.int32()), "f": pa.array([vals[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()), "near": pa.array(near_terms(x, o), pa.string())})

    # one row per text: copies of a labelled text must not count as evidence of their own
    got = rows.mapInArrow(run, "toxic int, f binary, near string").groupBy("f").agg(F.max("toxic").alias("toxic"), F.min("near").alias("near"))
    got = store(got.withColumn("h", F.xxhash64("f")).orderBy("h").limit(MAX_TRAIN), "training")
    order = sorted((r[0], r[1], r[2]) for r in got.select("h", F.length("f") + F.length("near"), "toxic").collect())
    size = np.cumsum([n for _, n, _ in order])
    taken = max(1, int(np.searchsorted(size, MAX_TRAIN_BYTES, "right")))
    rows = got.where(F.col("h") <= order[taken - 1][0]) if order else got
    known = [y for h, _, y in order if h <= order[taken - 1][0]]
    chosen = choose(rows, len(known), float(sum(known))) if known else np.zeros(0, np.uint64)
    sample = sorted((r["h"], r["near"], bytes(r["at"]), r["toxic"]) for r in chosen_only(rows, chosen).collect()) if known else []
    discard(got)
    return train([chosen[np.frombuffer(at, np.uint16)] for _, _, at, _ in sample], np.array([y for *_, y in sample]), [near for _, near, _, _ in sample])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted. Null and empty texts score the bias alone."""
    words, weights, bias = model.words, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(words, weights, bias)
        for b in batches:
            s = m.score(b.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    tune(spark)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_documents(docs, learn(docs, labels))
    return out.select("doc_id", F.coalesce(~not_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
