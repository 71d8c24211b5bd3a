"""Plans and results that only larger or odder tables than sf0.001 would show."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import events as linked
from panelforge.operators import grids as ranking
from panelforge.operators import polygons, resample, tables, terrain
from panelforge.plans import catalog, events, grids, refits
from panelforge.plans.registry import Tables
from panelforge.sources import stations
from panelforge.streaming import states


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicated_labels_are_not_broadcast(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 4).alias("s"), (F.col("id") % 2).alias("y"), (F.col("id") % 7).alias("z")).write.parquet(str(tmp_path / "t"))
    got = resample.label_shuffle(spark.read.parquet(str(tmp_path / "t")), ["s"], "k", "y", 20, 5)
    assert "BroadcastHashJoin" not in plan_of(got) and "BroadcastExchange" not in plan_of(got)
    assert got.columns == ["replicate", "s", "k", "y", "z"] and got.filter("z = k % 7").count() == 40000


def test_flagged_calls_take_many_idents(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60)
    spark.range(20000).select(F.when(F.col("id") % 50 > 0, F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(9000)).cast("string"))).alias("k"), at.alias("ts"), "id").repartition(3).write.parquet(str(tmp_path / "in"))
    given = spark.read.parquet(str(tmp_path / "in"))
    flagged = states.flagged(spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "k", "ts", "id", "40 days", 64)
    q = flagged.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 20000 and rows.groupBy("k").agg(F.max("nth").alias("n"), F.count(F.lit(1)).alias("m"), F.count_distinct("nth").alias("d")).filter("n <> m OR d <> m").count() == 0
    assert max(p["numRowsTotal"] for b in q.recentProgress for p in b["stateOperators"]) == 64


def test_digests_beyond_a_long(spark):
    df = spark.range(150000).select(F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") < 9, F.col("id")).alias("w"))
    got = {r["name"]: (r["n"], r["digest"]) for r in tables.column_digests(df, ["v", "w"]).collect()}
    bits = lambda texts: sum(int(hashlib.sha256(x.encode()).hexdigest()[:12], 16) for x in texts)
    whole = bits(f"v{i}" for i in range(150000))
    assert whole >= 1 << 63 and got["v"] == (150000, (whole + (1 << 63)) % (1 << 64) - (1 << 63)) and got["w"] == (9, bits(map(str, range(9))))
    assert tables.column_digests(df.limit(0), ["v"]).count() == 0 and tables.column_digests(df.filter("w IS NULL"), ["w"]).first()["digest"] is None


def test_spans_begin_at_the_nearest_second(spark, tmp_path):
    at = [(1, "2024-01-01 00:00:00.4"), (2, "2024-01-01 00:00:00.6"), (3, "2024-01-01 00:00:00.5"), (4, "2024-01-01 00:00:01.5"), (5, "2024-01-01 23:59:59.999999")]
    spark.createDataFrame(at, "event_id long, at string").selectExpr("event_id", "1L AS user_id", "'view' AS event_type", "CAST(at AS timestamp_ntz) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["s"] - 1704067200 for r in events.spans(Tables(spark, str(tmp_path))).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2, 5: 86400}


def test_weights_of_rounding_take_no_part(spark):
    source = spark.createDataFrame([(1, 0, 5.0)], "row long, col long, v double")
    targets = spark.createDataFrame([(0, 0), (1, 0)], "row long, col long")
    got = terrain.warped(source, "v", targets, lambda r, c: (r / 2 + 1e-14, c * 1.0)).collect()
    assert {r["row"]: r["value"] for r in got} == {0: None, 1: 5.0}


def test_weekly_rows_are_kept(spark):
    assert "Aggregate" not in plan_of(refits.weekly(Tables(spark, "/root/testdata/sf0.001")))


def test_traces_are_found_without_row_numbers(spark):
    days = [(s, dt.datetime(2024, 1, d)) for s in ("A", "B") for d in (1, 5, 9)]
    traces = spark.createDataFrame([("XX", s, "", "E", d, d + dt.timedelta(days=1), i) for i, (s, d) in enumerate(days + days[:1])], "network string, station string, location string, channel string, starts timestamp_ntz, ends timestamp_ntz, i int")
    epochs = spark.createDataFrame([("XX", "A", "", "E", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5, 12), 2.0), ("XX", "A", "", "E", dt.datetime(2024, 1, 8), None, 3.0)], "network string, station string, location string, channel string, starts timestamp_ntz, ends timestamp_ntz, sensitivity double")
    got = stations.covered(traces, epochs)
    assert "monotonically_increasing_id" not in plan_of(got)
    assert sorted((r["i"], r["status"], r["sensitivity"]) for r in got.collect()) == [(0, "COVERED", 2.0), (1, "PARTLY", None), (2, "COVERED", 3.0), (3, "NO_RESPONSE", None), (4, "NO_RESPONSE", None), (5, "NO_RESPONSE", None), (6, "COVERED", 2.0)]


def test_copies_of_places_are_met_once(spark):
    dice = random.Random(4)
    at = [(dice.randrange(30) / 2, dice.randrange(30) / 2) for _ in range(25)]
    points = [(i, *at[i % 25]) for i in range(300)] + [(900, None, 1.0), (901, 500.0, 500.0)]
    targets = [(i, at[i % 12][0] + 1.0, at[i % 12][1]) for i in range(150)]
    far = {(p, t): math.hypot(a - u, b - v) for p, a, b in points if a is not None for t, u, v in targets}
    least = {p: min(d for (q, _), d in far.items() if q == p) for p, a, _ in points if a is not None}
    want = {(p, t) for (p, t), d in far.items() if d == least[p] and d <= 4}
    p, t = (spark.createDataFrame(rows, "id long, x double, y double") for rows in (points, targets))
    got = linked.nearest(p, t, "id", "id", "x", "y", 4.0)
    assert sorted((r["point"], r["target"]) for r in got.collect()) == sorted(want) and {p for p, _ in want} >= {1, 2}
    assert "BroadcastExchange" not in plan_of(got).split("SortMergeJoin")[0]
    assert {r["point"]: r["distance"] for r in linked.nearest_distance(p, t, "id", "x", "y", 4.0).collect()} == pytest.approx({p: least[p] for p, _ in want})


def test_pairs_of_places_grow_with_places(spark, tmp_path):
    for n in (1, 8):
        spark.range(400 * n).select(F.col("id").alias("p_partkey"), (F.pmod("id", F.lit(5)) + 1).cast("int").alias("p_size")).selectExpr("(p_partkey % 400) + 1000 * (p_partkey div 400) AS p_partkey", "p_size").write.parquet(str(tmp_path / f"{n}/part.parquet"))
        spark.range(100 * n).selectExpr("(id % 100) + 1000 * (id div 100) AS s_suppkey").write.parquet(str(tmp_path / f"{n}/supplier.parquet"))
    for name in ("q119_nearest_join", "q121_box_overlaps", "q122_point_in_box"):
        one, many = (catalog.QUERIES[name](spark, str(tmp_path / n)) for n in ("1", "8"))
        assert (name == "q119_nearest_join" or many.count() == 64 * one.count() > 0) and many.rdd.getNumPartitions() == 4
    pairs = catalog.QUERIES["q121_box_overlaps"](spark, str(tmp_path / "8"))
    assert pairs.filter("pattern <> 'MANY_TO_MANY'").count() == 0


def test_copies_of_shapes_are_judged_once(spark):
    square = lambda x, y: [[{"x": x, "y": y}, {"x": x + 2, "y": y}, {"x": x + 2, "y": y + 2}, {"x": x, "y": y + 2}]]
    at = [(0.0, 0.0), (1.0, 1.0), (9.0, 9.0)]
    layer = spark.createDataFrame([(i, square(*at[i % 3])) for i in range(30)], "id long, rings array<array<struct<x: double, y: double>>>")
    got = polygons.meeting(layer, 4.0)
    alike = lambda i, j: (i % 3 == 2) == (j % 3 == 2)
    assert sorted(map(tuple, got.collect())) == [(i, j) for i in range(30) for j in range(i + 1, 30) if alike(i, j)] and got.rdd.getNumPartitions() == 4
    points = spark.createDataFrame([(i, 0.5, 0.5) for i in range(8)] + [(8, 50.0, 50.0), (9, None, 1.0)], "point long, x double, y double")
    found = polygons.located(points, layer, 4.0)
    assert sorted((r["point"], r["id"], r["class"]) for r in found.filter("id IS NOT NULL").collect()) == [(p, i, "inside") for p in range(8) for i in range(0, 30, 3)]
    assert sorted((r["point"], r["class"]) for r in found.filter("id IS NULL").collect()) == [(8, "none"), (9, "none")] and found.rdd.getNumPartitions() == 4


def test_layers_rank_over_ranges(spark):
    plan = grids.layers(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.replace("partitionBy(_range", "") or all("_range" in x for x in plan.splitlines() if "Window [" in x)
    ties = spark.createDataFrame([(i, 1, 0.1 * (3 if i % 2 else 1) / (3 if i % 2 else 1)) for i in range(9, 0, -1)], "id long, one int, t double").withColumn("o", F.lit(1.0))
    got = ranking.top_without_each(ties, "id", ["t"], ["o"], "o", 3).filter("left_out = ''").orderBy("place").collect()
    assert [r["id"] for r in got] == [1, 2, 3]
