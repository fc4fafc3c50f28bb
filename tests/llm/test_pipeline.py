"""Each stage of the pipeline, on what its predecessor kept."""

import re

import corpus_pipeline as cp
from data import SF, all_rows, documents, empty
from pyspark.sql import functions as F
from test_sets import brute_components


def test_stages(spark, tmp_path):
    docs = all_rows(spark)
    kept = {}
    for name, stage in cp.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        rows, was = docs.collect(), before.collect()
        texts = {r["doc_id"]: r["text"] for r in was}
        if name != "packed":
            assert docs.columns == list(cp.COLUMNS) and {r["doc_id"] for r in rows} <= set(texts)
        if name == "language":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in was if any(c.isalpha() for c in r["text"] or "")}
        if name == "near_duplicates":
            named = [(i, t) for i, t in texts.items() if i is not None]
            assert {r["doc_id"] for r in rows} == {None} | {c for _, c in brute_components(named).values()}
        if name == "personal_data":
            assert len(rows) == len(was) and not any(re.search(r"[\w.]+@[\w-]+\.\w+", r["text"] or "") for r in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "mixture":
            assert 0.3 * len(was) < len(rows) < len(was)
        if name == "packed":
            assert {r["doc_id"] for r in rows} == set(texts)
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_whole_run_and_empty(spark):
    assert cp.run(spark, SF).count() > 0
    for _, stage in cp.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0
    assert documents(spark).columns
