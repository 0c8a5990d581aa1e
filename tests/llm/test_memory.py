"""What bounds the memory of executors: small batches for Python, and memory that workers return."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from auditlake.llm import common, ctw, langid

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_op3_sends_small_batches(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and more text {i}") for i in range(1200)], "doc_id long, text string").coalesce(1)
    was = spark.conf.get(NAME)
    try:
        got = {}
        for start, want in (("10000", common.BATCH), ("7", 7)):
            spark.conf.set(NAME, start)
            got[want] = {r.doc_id: (r.score, r.base_score, r.n_known) for r in ctw.score(docs, F.col("doc_id") % 5 != 1).collect()}
            assert int(spark.conf.get(NAME)) == want
        assert len(got[7]) == 1200 and all(np.allclose(x, got[common.BATCH][i]) for i, x in got[7].items())
    finally:
        spark.conf.set(NAME, was)


def test_give_back_keeps_what_is_made():
    assert list(common.give_back(lambda xs: (x + 1 for x in xs))(iter(range(3)))) == [1, 2, 3]


def test_pipeline_sends_small_batches(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, with_ids: docs)
    was = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, "10000")
        corpus_pipeline.packed(spark, spark.range(1), "")
        assert int(spark.conf.get(NAME)) <= 500
    finally:
        spark.conf.set(NAME, was)


def test_workers_drop_what_another_function_held():
    common.held()["words"] = 1
    assert list(common.give_back(iter, keep=True)(iter([1]))) == [1] and common.held()["words"] == 1
    assert list(common.give_back(iter)(iter([1]))) == [1] and not common.held().get("words")


def test_language_counts_come_by_language_and_length():
    texts = [("x", "ab abc"), ("y", "ab"), ("x", "ab " + "q" * (langid.WORD_LETTERS + 1))]
    frames = list(langid._counts(iter([pd.DataFrame(texts, columns=["lang", "text"])])))
    assert all(len(f.groupby(["lang", "n"])) == 1 for f in frames)
    want = Counter()
    for lang, text in texts:
        for w in text.split():
            for n in range(langid.GRAMS + 1):
                want.update((lang, n, g) for g in (langid.grams_of(w, n) if n else [w] * (len(w) <= langid.WORD_LETTERS)))
    got = Counter()
    for f in frames:
        for r in f.itertuples(index=False):
            got[r.lang, r.n, r.key] += r.c
    assert got == want


def test_small_tables_take_no_workers(spark, monkeypatch):
    made, was = [], type(spark).createDataFrame
    docs = spark.createDataFrame([(i, "ab cd", "xy"[i % 2]) for i in range(4)], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: made.append(type(data).__name__) or was(self, data, *a, **b))
    assert langid.fit(docs).langs == ["x", "y"]
    assert made and set(made) == {"Table"}
    rows = [("a", None), (None, 2.5)]
    assert [tuple(r) for r in common.local_table(spark, rows, "k string, v double").collect()] == rows
    assert common.local_table(spark, [], "k string, v double").count() == 0
