"""Rows with null or repeated ids are judged by their own texts; merge levels keep the right identifier."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, exact_dedup, minhash, storage

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, "Same text", 0), (None, "same TEXT", 1), (1, "same text", 2), (4, LONG, 3), (None, LONG + " end", 4), (4, "another", 5), (None, None, 6), (9, "", 7), (None, "lone", 8)]


@pytest.mark.parametrize("most", [2_000_000, 1])
def test_rows_of_any_id(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", most)
    made = spark.createDataFrame(ROWS, "doc_id long, text string, n long").repartition(3)
    made.write.parquet(str(tmp_path / "rows"))
    for docs in (made, spark.read.parquet(str(tmp_path / "rows"))):
        left = exact_dedup.distinct_texts(docs)
        got = sorted(r["n"] for r in left.collect())
        assert left.columns == docs.columns and got in ([0, 3, 4, 5, 7, 8], [2, 3, 4, 5, 7, 8])
        assert sorted(r["n"] for r in minhash.distinct_groups(docs).filter("n > 2").collect()) == [3, 5, 6, 7, 8]
    assert exact_dedup.distinct_texts(docs.limit(0)).count() == 0


def test_contaminated_twins_go(spark):
    docs = spark.createDataFrame([(1, "clean words"), (1, "alpha beta gamma"), (None, "alpha beta gamma"), (None, "also clean")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert sorted(r["text"] for r in decontaminate.without_hits(docs, item).collect()) == ["also clean", "clean words"]
    assert [n for n, _ in corpus_pipeline.STAGES][3] == "benchmark decontamination"


@pytest.mark.parametrize("keep, want", [("max", 996), ("min", 6)])
def test_merge_levels_retain_the_identifier(spark, keep, want):
    rows = spark.range(1, 1001).select(F.when(F.col("id") % 4 < 3, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("text"), F.pmod("id", F.lit(exact_dedup.RUNS)).alias("r"))
    runs = exact_dedup.digests(rows.withColumn("row", F.lit(0).cast("long"))).drop("run")
    runs = runs.withColumn("run", F.pmod(F.coalesce("doc_id", F.lit(7)), F.lit(exact_dedup.RUNS)).cast("int"))
    merged = exact_dedup.merge_runs(runs, keep)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("SortAggregate") >= 2 * 4
    got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in merged.collect()}
    best = max if keep == "max" else min
    for k in range(3):
        ids = [i for i in range(1, 1001) if i % 3 == k]
        assert got[hashlib.sha256(f"t{k}".encode()).digest()] == (best(i for i in ids if i % 4 < 3), len(ids))
    assert got[hashlib.sha256(b"t0").digest()][0] == want
