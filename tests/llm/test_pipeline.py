from collections import Counter

import numpy as np

import corpus_pipeline
from netloom.llm import _shared, _words, ngram_join, quality_rules
from test_documents import components, removed_spans, shingle_set


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocab = [f"{a}{b}{c}" for a in ("ba", "re", "to", "mi") for b in ("la", "n", "sk", "um") for c in ("", "or", "is", "t", "ing")]
    prose = lambda n: " ".join(rng.choice(vocab, n)) + "."
    passage = prose(60)
    texts = [prose(int(rng.integers(60, 160))) for _ in range(40)]
    texts += [texts[0], " ".join([*texts[1].split(), "end"]), f"{prose(40)} {passage} {prose(30)}", f"{prose(50)} {passage} {prose(20)}", "### $$$ " * 30, "too short", "same line again\n" * 30, None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in quality_rules.quality_verdicts(docs).where("kept").collect()}
    assert {44, 45, 46, 47, 48}.isdisjoint(kept) and len(kept) >= 40
    ids = sorted(kept)
    comp = components([shingle_set(texts[i], 5) for i in ids], 80)
    ids = [i for k, i in enumerate(ids) if comp[k] == k]
    lib, want = _words.library(_words.default_tokenizer()), Counter()
    for i, (b, m) in zip(ids, removed_spans([texts[i] for i in ids]), strict=True):
        rest = np.frombuffer(b, np.uint8)[~m].tobytes().decode()
        want[i] = len(lib.encode(rest, add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == dict(want)
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None] and ngram_join.PERCENT == 85


def test_stages_take_odd_rows_and_empty_tables(spark, docs, nothing):
    """Nulls in every column, repeated rows, a very long text, and columns named like those that operators use inside."""
    for rows in (docs, nothing):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, "")
            assert out.columns == rows.columns if k < 4 else out.columns[0] == "doc_id", name
            n = out.count()
            assert n == rows.count() if k > 1 or rows is nothing else n < rows.count(), name


def test_a_sweep_leaves_tables_of_others(spark):
    mine = _shared.store(spark.range(3).toDF("a"), "mine")
    with _shared.owned("someone"):
        _shared.store(spark.range(3).toDF("a"), "theirs")
    corpus_pipeline.begin(spark)
    _shared.sweep(spark, "someone")
    assert mine.count() == 3
    _shared.discard(mine, spark.range(1))
