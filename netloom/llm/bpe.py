"""BPE encoding by speculation and verification, and decoding.

Each distinct pretoken is cut greedily into the longest vocabulary entries. A cut is the exact encoding when every
adjacent pair of entries is: numpy takes the pairs of all new words at once, undoes the merges next to the border from the last
to the first, and looks whether a merge across the border would have come earlier. Only words with a failing pair are merged
step by step, by a queue of pairs over a linked list, so that a word of n letters takes O(n log n). Decoding joins the entries'
strings by a space, as the library does for a file without a decoder.

Null and empty texts have no ids and decode to the empty string. Very long texts and words are encoded whole; what a worker keeps of
words is bounded by number and by letters. Repeated rows and null ids stay as they are, in any order; equal merges go leftmost first. An
empty table gives no rows. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from netloom.llm import _words
from netloom.llm._shared import tune

NEVER = np.int64(1) << 60
#: Words that a worker keeps, and their letters altogether.
KEEP_WORDS, KEEP_LETTERS = 400_000, 16_000_000


class SpeculativeBPE:
    """A word-level BPE file with end-of-word entries."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.suffix = path, model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*self.vocab.values(), *self.special.values()]) + 1
        self.shown = [""] * n
        for s, i in (self.vocab | self.special).items():
            self.shown[i] = s
        self.char_of_byte = [c for c, _ in sorted(_words.byte_of_char().items(), key=lambda x: x[1])]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes an entry; -1: an alphabet entry
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.left[z], self.right[z], self.rank[z] = x, y, r
            self.merges[x, y] = (r, z)
        keys = np.array([a * n + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.n, self.pair_key, self.pair_rank = n, keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        whole = [i for s, i in self.vocab.items() if self.rank[i] < 0 or self.merge([self.vocab[c] for c in self.letters(s)]) == [i]]
        usable = set(whole)
        self.inner = {s: i for s, i in self.vocab.items() if i in usable and not s.endswith(self.suffix)}
        self.final = {s[: -len(self.suffix)]: i for s, i in self.vocab.items() if i in usable and s.endswith(self.suffix)}
        self.longest = max(map(len, self.final))
        self.reach: dict[str, int] = {}  # the longest inner entry by its first letters, three at most
        for s in self.inner:
            for k in range(1, min(3, len(s)) + 1):
                self.reach[s[:k]] = max(self.reach.get(s[:k], 0), len(s))
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.failed = self.seen = self.letters_kept = 0

    def letters(self, shown: str) -> list[str]:
        """An entry's string or a byte-level word with suffix as alphabet strings."""
        if shown.endswith(self.suffix) and len(shown) > len(self.suffix):
            core = shown[: -len(self.suffix)]
            return [*core[:-1], core[-1] + self.suffix]
        return list(shown)

    def merge(self, ids: list[int]) -> list[int]:
        """Exact: the earliest merge first, the leftmost of equals."""
        ids, n, merge = list(ids), len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [m[0] * n + i for i, pair in enumerate(itertools.pairwise(ids)) if (m := merge(pair))]  # by rank, then place
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(heapq.heappop(queue), n)
            j = after[i]
            m = merge((ids[i], ids[j])) if j < n else None
            if m is None or m[0] != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = m[1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merge((ids[i], ids[after[i]])):
                    heapq.heappush(queue, m[0] * n + i)
            if (h := before[i]) >= 0 and (m := merge((ids[h], ids[i]))):
                heapq.heappush(queue, m[0] * n + h)
        return [t for t in ids if t >= 0]

    def greedy(self, word: str) -> list[int]:
        """Longest entries from the left; `word` is byte-level."""
        out, i, n, inner, final, reach = [], 0, len(word), self.inner, self.final, self.reach
        while i < n:
            if n - i <= self.longest and (t := final.get(word[i:])) is not None:
                out.append(t)
                break
            far = reach.get(word[i : i + 3]) or 2
            for j in range(min(n - 1, i + far), i, -1):
                if (t := inner.get(word[i:j])) is not None:
                    break
            else:
                raise KeyError(word[i])
            out.append(t)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: does the merged form of both entries side by side keep the border?"""
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(x), NEVER)
        good, live = np.zeros(len(x), bool), np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            key = u * self.n + v
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            across = np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)
            ok = across >= limit[live]
            live, u, v = live[ok], u[ok], v[ok]
            ru, rv = self.rank[u], self.rank[v]
            bare = (ru < 0) & (rv < 0)
            good[live[bare]] = True
            live, u, v, ru, rv = (z[~bare] for z in (live, u, v, ru, rv))
            undo_left = ru > rv  # of equal merges the right one came later
            x[live] = np.where(undo_left, self.right[u], u)
            y[live] = np.where(undo_left, v, self.left[v])
            # a merge across the border of the same rank stands left of the right entry's and right of the left entry's
            limit[live] = np.where(undo_left, ru, rv + 1)
        return good

    def learn(self, new: list[str]) -> None:
        """Encode words that are not in the table."""
        chars = self.char_of_byte
        level = ["".join([chars[b] for b in w.encode("utf-8")]) for w in new]
        cut = [self.greedy(w) for w in level]
        flat = np.fromiter((t for c in cut for t in c), np.int64)
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        inside = owner[1:] == owner[:-1]
        key, back = np.unique((flat[:-1] * self.n + flat[1:])[inside], return_inverse=True)
        fresh = np.array([k for k in key.tolist() if k not in self.pairs], np.int64)
        if len(self.pairs) > KEEP_WORDS:
            self.pairs, fresh = {}, key
        self.pairs.update(zip(fresh.tolist(), self.compatible(fresh // self.n, fresh % self.n).tolist(), strict=True))
        bad = ~np.array([self.pairs[k] for k in key.tolist()], bool)[back] if len(key) else np.zeros(0, bool)
        for i in np.unique(owner[1:][inside][bad]).tolist():
            cut[i] = self.merge([self.vocab[c] for c in self.letters(level[i] + self.suffix)])
            self.failed += 1
        self.seen += len(new)
        self.letters_kept += sum(map(len, new))
        shown = self.shown
        for w, c in zip(new, cut, strict=True):
            self.known[w] = (len(c), " ".join(map(str, c)), " ".join([shown[t] for t in c]))

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, the ids in decimal joined by a space, and the decoded text."""
        split = [_words.pieces(x, self.path) if x else [] for x in texts]
        if len(self.known) > KEEP_WORDS or self.letters_kept > KEEP_LETTERS:
            self.known, self.letters_kept = {}, 0
        for s, i in self.special.items():
            self.known[s] = (1, str(i), s)
        if new := list({w for ws in split for w in ws if w not in self.known}):
            self.learn(new)
        get, out = self.known.__getitem__, []
        for ws in split:
            v = list(map(get, ws))
            out.append((sum([x[0] for x in v]), " ".join([x[1] for x in v]), " ".join([x[2] for x in v])))
        return out

    def ids(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encode([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """The entries' strings joined by a space; an id beyond the vocabulary adds nothing."""
        return " ".join([self.shown[i] for i in ids if 0 <= i < self.n and self.shown[i]])


@lru_cache(maxsize=2)
def codec(path: str) -> SpeculativeBPE:
    return SpeculativeBPE(path)


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. A null or empty text has no ids and decodes to the
    empty string; null ids and repeated rows stay as they are; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for b in batches:
            texts, n, ids, dec = b.column(1).to_pylist(), [], [], []
            for i in range(0, len(texts), 64):
                for k, x, y in bpe.encode(texts[i : i + 64]):
                    n.append(k)
                    ids.append(hashlib.sha256(x.encode()).hexdigest())
                    dec.append(hashlib.sha256(y.encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(dec, pa.string())})

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    tune(spark)
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), _words.default_tokenizer())
