import hashlib
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netloom.llm import _words, bpe, token_binary, token_rollup
from netloom.llm._shared import fresh_path

PATH = _words.default_tokenizer()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("abcdeinorst 'ds1!?é", max_size=60))
def test_encoding_equals_the_library(text):
    lib, own = _words.library(PATH), bpe.codec(PATH)
    e = lib.encode(text, add_special_tokens=False)
    assert own.ids(text) == e.ids
    assert own.encode([text])[0][2] == own.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)
    assert np.frombuffer(token_binary.encoder(PATH).encode([text])[0], "<u4").tolist() == e.ids


def test_every_low_code_point():
    lib, own, enc = _words.library(PATH), bpe.codec(PATH), token_binary.encoder(PATH)
    for cp in range(0x250):
        c = chr(cp)
        x = f"a{c}b{c}1{c}!{c} {c}{c}'s"
        ids = lib.encode(x, add_special_tokens=False).ids
        assert own.ids(x) == ids and np.frombuffer(enc.encode([x])[0], "<u4").tolist() == ids


def test_failing_words_are_merged_exactly():
    own = bpe.codec(PATH)
    own.encode(["thntedble whenthan erthation inglyesat"])
    assert 0 < own.failed <= own.seen


def test_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 50)
    own = bpe.SpeculativeBPE(PATH)
    for i in range(30):
        own.encode([" ".join(f"w{i}q{j}" for j in range(20))])
    assert len(own.known) < 200


def test_round_trip_query(docs, nothing):
    lib = _words.library(PATH)
    got = bpe.bpe_round_trip(docs, PATH).collect()
    want = []
    for r in docs.collect():
        e = lib.encode(r["text"] or "", add_special_tokens=False)
        want.append((r["doc_id"], len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.bpe_round_trip(nothing, PATH).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    data = token_binary.write_shard(np.array([5, 9]), np.array([0, 4000, 10_001]), ids, bits, 100)
    s = token_binary.Shard(data)
    assert (s.ids(0, 10_001) == ids).all() and (s.doc(1) == ids[4000:]).all() and (s.ids(123, 457) == ids[123:457]).all() and len(s.ids(7, 7)) == 0


def test_packing_refuses_large_ids():
    with pytest.raises(ValueError):
        token_binary.write_shard(np.array([1]), np.array([0, 1]), np.array([8], np.uint32), 3)
    assert token_binary.bits_for(49408) == 16 and token_binary.bits_for(50257) == 16 and token_binary.bits_for(32000) == 15


def test_token_files(spark, docs, nothing):
    lib = _words.library(PATH)
    got = token_binary.read_token_files(spark, token_binary.write_token_files(docs, fresh_path(spark, "t"), PATH, 1, 3)).collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == [r["doc_id"] for r in rows]
    at = 0
    for r in by_start:
        assert r["start"] == at
        at += r["n_tokens"]
    want = []
    for r in rows:
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got)
    assert token_binary.read_token_files(spark, token_binary.write_token_files(nothing, fresh_path(spark, "t"), PATH)).count() == 0


def test_rollup(spark, docs, nothing):
    counts = token_rollup.count_tokens(docs, PATH).persist()
    r = token_rollup.TokenRollup(spark, fresh_path(spark, "r"))
    assert r.totals().count() == 0
    assert r.apply("a", token_rollup.signed(counts, "v1", 1))
    assert not r.apply("a", token_rollup.signed(counts, "v1", 1))
    more = counts.selectExpr("*", "n_tokens + 1 AS m")
    assert r.apply("b", token_rollup.revised(more, "v1", "n_tokens", "m"))
    want = {}
    lib = _words.library(PATH)
    for d in docs.collect():
        k = (d["source"], d["lang"], "v1")
        n = len(lib.encode(d["text"] or "", add_special_tokens=False).ids) + 1
        want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + n)
    read = lambda: {tuple(x[:3]): tuple(x[3:]) for x in r.totals().collect()}
    assert read() == want
    r.compact()
    assert read() == want and not r.apply("a", token_rollup.signed(counts, "v1", 1))
    assert r.apply("c", token_rollup.signed(more, "v1", -1, "m"))
    assert read() == {}
    assert r.apply("empty", token_rollup.signed(token_rollup.count_tokens(nothing, PATH), "v1", 1)) and read() == {}


def test_very_long_words_take_no_quadratic_time():
    rng = np.random.default_rng(6)
    lib, own = _words.library(PATH), bpe.SpeculativeBPE(PATH)
    for word in ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000)), "a" * 200_000):
        start = time.perf_counter()
        got = own.ids(word)
        assert time.perf_counter() - start < 8  # about 1.5 s where the machine is idle; a scan for each merge would take hours
        assert got == lib.encode(word, add_special_tokens=False).ids


def test_long_words_are_not_kept_without_bound(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_LETTERS", 10_000)
    own = bpe.SpeculativeBPE(PATH)
    for i in range(20):
        own.encode(["x" * (3000 + i)])
    assert sum(map(len, own.known)) < 20_000


def test_a_task_rolls_its_files(spark, docs, monkeypatch):
    folder, many = fresh_path(spark, "t"), fresh_path(spark, "t")
    rows = docs.where("length(text) < 1000").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(20))))
    one = token_binary.write_token_files(rows, folder, PATH, 1, 2)
    rolled = token_binary.write_token_files(rows, many, PATH, 1, 2, file_ids=100)
    assert len(rolled) > len(one) and sum(r[2] for r in rolled) == rows.count()
    read = lambda m: sorted(str(tuple(r)[:4]) for r in token_binary.read_token_files(spark, m).collect())
    assert read(one) == read(rolled)


def test_ids_of_any_value_are_kept(spark):
    ids = [None, -(1 << 63), 0, (1 << 63) - 1]
    df = spark.createDataFrame([(i, f"some text {i}") for i in ids], "doc_id long, text string")
    got = token_binary.read_token_files(spark, token_binary.write_token_files(df, fresh_path(spark, "t"), PATH, 1, 1)).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == ids


def test_commits_during_and_between_compactions(spark):
    rows = lambda n: spark.createDataFrame([("s", "l", "v", 1, n)], token_rollup.SCHEMA)
    r = token_rollup.TokenRollup(spark, fresh_path(spark, "r"))
    read = lambda: [tuple(x)[3:] for x in r.totals().collect()]
    assert r.apply("a/1", rows(5)) and r.apply("b", rows(7)) and read() == [(2, 12)]
    plain = r._sum

    def late(base, commits):
        out = plain(base, commits)
        assert r.apply("late", rows(100))  # lands after the listing
        return out

    r._sum = late
    r.compact()
    r._sum = plain
    assert read() == [(3, 112)] and r.batches() == ["late"]
    assert not r.apply("a/1", rows(5)) and not r.apply("late", rows(1)) and read() == [(3, 112)]
    r.compact()
    assert read() == [(3, 112)] and r.batches() == [] and not r.apply("b", rows(7))
    assert not r._mark("base-00000002", ["x"]) and r._read("base-00000002")[0] != "x"


def test_a_batch_counts_once_when_a_fold_comes_between_look_and_mark(spark):
    """Two writers of one batch: the first commits and is folded while the second writes its table."""
    rows = lambda n: spark.createDataFrame([("s", "l", "v", 1, n)], token_rollup.SCHEMA)
    folder = fresh_path(spark, "r")
    first, second = token_rollup.TokenRollup(spark, folder), token_rollup.TokenRollup(spark, folder)
    plain = second._mark

    def late(name, lines):
        assert first.apply("x", rows(5))
        first.compact()
        return plain(name, lines)

    second._mark = late
    assert not second.apply("x", rows(5))
    first.compact()
    assert [tuple(x)[3:] for x in first.totals().collect()] == [(1, 5)] and first.batches() == []


def test_rollup_query(spark, docs, tmp_path):
    docs.union(docs.where("doc_id = 5")).write.parquet(str(tmp_path / "documents.parquet"))
    lib, want, seen = _words.library(PATH), {}, set()
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    for d in sorted(rows, key=lambda d: (d["doc_id"] is None, d["doc_id"] or 0, d["source"] or "")):
        if (t := d["text"] or "") not in seen:
            seen.add(t)
            k = (d["source"], d["lang"], "word_bpe_49k/1")
            n, m = want.get(k, (0, 0))
            want[k] = (n + 1, m + len(lib.encode(t, add_special_tokens=False).ids) + 1)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in token_rollup.op2_token_rollup(spark, str(tmp_path)).collect()} == want
