"""Record rules and whole-table operators on hand-worked cases."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelforge.functions import catalogue as C
from panelforge.functions import scalars as X
from panelforge.operators import cases, intake, order, spatial, tables

D = datetime.date


def test_timing_intervals(spark):
    rows = [
        ("2012", "1990", "5", "5", D(2012, 5, 5), D(2012, 5, 6), "day", None),
        ("NA", "1990", "4", "NA", D(1990, 4, 1), D(1990, 5, 1), "interval", None),
        ("NA", "1990", "12", "", D(1990, 12, 1), D(1991, 1, 1), "month", None),
        ("1985", "NA", "", "", D(1985, 1, 1), D(1986, 1, 1), "year", None),
        ("1985", "NA", "2", "30", None, None, None, "unparseable_date"),
        ("NA", "NA", "2", "3", None, None, None, "unresolved_timing"),
        ("20th", "NA", "2", "3", None, None, None, "unparseable_year"),
        ("1985", "NA", "NA", "14", D(1985, 1, 1), D(1986, 1, 1), "year", None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "a string, b string, c string, d string")
    got = df.select(*[x.alias(n) for n, x in C.timing_interval(*map(F.col, "abcd")).items()]).collect()
    assert [tuple(r) for r in got] == [r[4:] for r in rows]


def test_horizons(spark):
    df = spark.createDataFrame([("day", None, 7), ("month", None, 7), ("month", None, 30), ("unresolved", None, 0), ("interval", 5, 3), ("interval", 5, 7), ("exact_timestamp", None, 90)], "p string, w int, h int")
    assert [r[0] for r in df.select(C.horizon_admissible(F.col("p"), F.col("w"), F.col("h"))).collect()] == [True, False, True, True, False, True, True]
    assert spark.range(1).select(C.lookback_days(F.lit("30d"))).first()[0] == 30
    for bad in ("7", "d", "1.5d", None):
        with pytest.raises(PySparkException):
            spark.range(1).select(C.lookback_days(F.lit(bad).cast("string"))).collect()


def test_placeholders_and_locations(spark):
    df = spark.createDataFrame([(" Not Identified ",), ("Unnamed glacier",), ("--",), ("nan",), (None,), ("Imja",)], "t string")
    assert [r[0] for r in df.select(X.meaningful(F.col("t"))).collect()] == ["", "", "", "nan", "", "Imja"]
    points = spark.createDataFrame([([(27.5, 86.9), (91.0, 0.0), (float("nan"), 1.0), (10.0, 181.0)], 1.0, 2.0), ([], 1.0, 2.0), (None, None, 2.0)], "p array<struct<lat: double, lon: double>>, a double, o double")
    got = [[(x["lat"], x["lon"]) for x in r[0]] for r in points.select(C.impact_locations(F.col("p"), F.col("a"), F.col("o"))).collect()]
    assert got == [[(27.5, 86.9)], [(1.0, 2.0)], []]


def test_observability_and_states(spark):
    df = spark.createDataFrame([(5.0, "FULL", {"snow": D(2000, 1, 1)}, D(2001, 1, 1)), (0.5, None, {"snow": D(2002, 1, 1)}, D(2001, 1, 1)), (float("inf"), "AVAILABLE", {}, None)], "v double, c string, a map<string,date>, d date")
    got = [r[0] for r in df.select(C.observability_reasons(F.col("v"), F.lit(1.0), F.col("c"), F.col("a"), ["snow"], F.col("d"))).collect()]
    late, unknown = "FEATURE_NOT_AVAILABLE_AS_OF_EVENT:snow", "FEATURE_AVAILABILITY_UNKNOWN:snow"
    assert got == [[], ["BELOW_MIN_DETECTABLE_SIZE", late, "OBSERVATION_NOT_ADEQUATE:UNKNOWN"], ["BELOW_MIN_DETECTABLE_SIZE", "EVENT_DATE_UNRESOLVED", unknown]]
    gate = spark.createDataFrame([(0.2, 0.1, 0.01), (0.2, -0.1, 0.01), (0.2, 0.1, 0.05), (None, 0.1, 0.01)], "m double, l double, p double")
    assert [r[0] for r in gate.select(C.triple_gate(F.col("m"), F.col("l"), F.col("p"))).collect()] == ["PASS", "NULL", "NULL", "NULL"]


def test_shift_null_censors_offsets_without_labels(spark):
    labels = spark.createDataFrame([("u", D(2000, 1, d), int(d == 10)) for d in range(1, 21)], "unit string, day date, label int")
    events = spark.createDataFrame([("u", D(2000, 1, 10))], "unit string, day date")
    r = cases.shift_null(events, labels, "unit", "day", "label", [-5, 5, 500]).first()
    assert (r["observed"], r["n"], r["ge"]) == (1.0, 2, 0) and r["p"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("at", [[0.0, 0.25, 0.5, 1.0]])
def test_quantiles_and_running_sums(spark, at):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 400), rng.integers(0, 60, 400) / 4)] + [(9, None), (9, 2.5)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {r["k"]: r["q"] for r in order.quantiles(df, ["k"], "v", at).collect()}
    for k in (0, 1, 2, 9):
        assert got[k] == pytest.approx(np.quantile([v for x, v in rows if x == k and v is not None], at))
    total = order.quantiles(df, [], "v", [0.5]).first()["q"][0]
    assert total == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_whole_table_checks(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "i int, e string, s string")
    assert tables.without_empty_columns(df).columns == ["i", "s"]
    one, two = (tables.column_digests(x, ["i", "s"]).collect() for x in (df, df.orderBy(F.desc("i"))))
    assert sorted(one) == sorted(two)
    merged = intake.coalesced(spark.createDataFrame([(1, "a", 1.0, None), (1, "b", None, 2.0), (2, "a", 1.0, None), (2, "b", 5.0, None)], "t int, m string, x double, y double"), ["t"], "m", ["x", "y"])
    assert sorted((r["t"], r["sources"]) for r in merged.collect()) == [(1, 1), (2, 2)]


def test_rings(spark):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.5, 2.5), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(spatial.inside(F.col("x"), F.col("y"), ring)).collect()] == [True, False, True, False]
    assert spark.range(1).select(spatial.ring_area(ring)).first()[0] == 10.0
