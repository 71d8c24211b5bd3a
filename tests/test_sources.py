"""Sources, sinks, resampling and signal features on small planted inputs."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import models, resample, signal
from panelforge.sources import files, sinks


def test_records_in_any_shape(spark, tmp_path):
    rows = [{"id": 1, "name": "é"}, {"id": 2, "name": None}]
    for i, body in enumerate((rows, {"events": rows}, {"records": rows})):
        (tmp_path / f"{i}.json").write_text(json.dumps(body))
        assert [r["id"] for r in files.records(spark, str(tmp_path / f"{i}.json"), "id int, name string").orderBy("id").collect()] == [1, 2]
    (tmp_path / "a.csv").write_bytes("id,name\n1,caf\xe9\n".encode("windows-1252"))
    assert files.table_csv(spark, str(tmp_path / "a.csv"), "id int, name string", "windows-1252").first()["name"] == "café"


def test_manifest_finds_every_difference(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    for n in "abc":
        (d / n).write_text(n)
    before = spark.createDataFrame(files.manifest(spark, str(d)).collect())
    assert files.verify_manifest(before, files.manifest(spark, str(d))).count() == 0
    (d / "a").write_text("changed")
    (d / "b").unlink()
    (d / "x").write_text("new")
    got = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in files.verify_manifest(before, files.manifest(spark, str(d))).collect()}
    assert got == {"a": "mismatch", "b": "missing", "x": "extra"}


def test_zip_members_and_kinds(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("t.csv", "h\n1\n2")
        z.writestr("other.txt", "no")
    got = files.zip_members(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["member"], r["text"]) for r in got] == [("t.csv", "h"), ("t.csv", "1"), ("t.csv", "2")]
    assert files.raw_files(spark, str(tmp_path)).select(files.file_kind(F.col("content")).alias("k")).first()["k"] == "zip"


def test_exact_coverage(spark):
    df = spark.createDataFrame([("2020-01-01 00:00:00", 1.0), ("2020-01-01 02:00:00", float("nan")), ("2020-01-01 03:00:00", 1.0), ("2020-01-01 03:00:00", 1.0), ("2020-01-02 00:00:00", 1.0)], "t string, v double").withColumn("t", F.to_timestamp("t"))
    got = [r["problem"] for r in files.exact_coverage(df, "t", ["v"], "2020-01-01 00:00:00", "2020-01-01 03:00:00").orderBy("time").collect()]
    assert got == ["missing", "not finite", "repeated", "unexpected"]


def test_sinks_refuse_to_overwrite_and_keep_order(spark, tmp_path):
    df = spark.createDataFrame([(2, ["b", "c"]), (1, None)], "id int, tags array<string>")
    sinks.write_once(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="exists"):
        sinks.write_once(df, str(tmp_path / "p"))
    sinks.ordered_csv(df, str(tmp_path / "c"), ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("id").collect()[1]["tags"] == "b|c"
    a, b = sinks.table_digest(df).first(), sinks.table_digest(df.repartition(3)).first()
    assert a == b and sinks.table_digest(df.limit(1)).first() != a


def test_shuffles_keep_margins(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2, i * i) for i in range(60)], "k int, s int, y int, z int")
    got = resample.label_shuffle(df, ["s"], "k", "y", 2, 5)
    assert got.count() == 120 and got.groupBy("replicate", "s").agg(F.sum("y").alias("n")).filter("n <> 10").count() == 0
    x = resample.column_shuffle(df, "k", ["y", "z"], 1)
    assert sorted(r["z"] for r in x.collect()) == [i * i for i in range(60)]
    assert [r["z"] for r in x.orderBy("k").collect()] != [i * i for i in range(60)]


def test_calibration_recovers_the_line(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.02, 0.98, 4000)
    z = np.log(p / (1 - p))
    y = rng.uniform(size=4000) < 1 / (1 + np.exp(-(0.5 * z - 0.3)))
    a, b = resample.calibration_fit(spark.createDataFrame([(int(t), float(q)) for t, q in zip(y, p)], "y int, p double"), "y", "p")
    assert abs(a - 0.5) < 0.08 and abs(b + 0.3) < 0.1


def test_sine_burst_and_silence():
    t = np.arange(3000) / 50
    f = dict(zip(signal.FEATURES, signal.window_features(np.sin(2 * np.pi * 5 * t), 50)))
    assert abs(f["dominant_hz"] - 5) < 0.05 and f["band_mid"] > 0.99 and abs(f["crest"] - 2**0.5) < 0.08
    burst = np.random.default_rng(0).normal(0, 0.01, 3000)
    burst[2000:2200] += 5
    assert signal.window_features(burst, 50)[-1] > 3 and signal.window_features(np.zeros(100), 50) == [0.0] * 12
    noise = np.random.default_rng(1).normal(size=(2, 3000))
    assert min(signal.coherence(noise[0], noise[0], 50)) > 0.99 and max(signal.coherence(noise[0], noise[1], 50)) < 0.5


def test_kmeans_silhouette_and_alignment():
    x = np.concatenate([np.random.default_rng(0).normal(c, 0.2, (50, 2)) for c in (0, 4)])
    label, centres, _ = models.kmeans(x, 2, 0)
    assert models.silhouette(x, label) > 0.9 and sorted(np.bincount(label)) == [50, 50]
    assert models.aligned(np.array([[0.0], [1], [2]]), np.array([[2.1], [0.1], [1.1]])) == [1, 2, 0]
