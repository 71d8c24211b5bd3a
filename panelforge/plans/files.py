"""Queries that go through files in the shared folder and come back: record files, ordered sinks, manifests, coverage (inventory 2.1)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.order import checkpointed, shared_folder
from panelforge.operators.signal import tiles
from panelforge.plans.registry import Tables, query
from panelforge.sources import files, sinks


def place(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/{uuid.uuid4().hex}-{name}"


@query("q3_file_kind", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'zip' WHEN 1 THEN 'hdf5' WHEN 2 THEN 'gzip' ELSE 'unknown' END AS kind FROM part")
def kinds(t: Tables) -> DataFrame:
    k = F.col("p_size") % 4
    head = F.when(k == 0, files.MAGIC["zip"]).when(k == 1, files.MAGIC["hdf5"]).when(k == 2, files.MAGIC["gzip"]).otherwise("00ff")
    content = F.concat(F.unhex(head), F.col("p_name").cast("binary"))
    return t.part.select("p_partkey", files.file_kind(content).alias("kind"))


FIRST, LAST = "2024-01-01 00:00:00", "2024-01-31 05:00:00"


@query("q4_exact_coverage", f"WITH e AS (SELECT date_trunc('hour', ts) AS h, max(value) AS v FROM events GROUP BY 1), w AS (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 HOUR)) AS h) SELECT CASE WHEN e.h IS NULL THEN 'missing' WHEN w.h IS NULL THEN 'unexpected' ELSE 'not finite' END AS problem, count(*) AS n FROM w FULL JOIN e ON w.h = e.h WHERE e.h IS NULL OR w.h IS NULL OR v > 200 GROUP BY 1")
def coverage(t: Tables) -> DataFrame:
    h = t.events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.max("value").alias("v"))
    h = h.withColumn("v", F.when(F.col("v") <= 200, F.col("v")))
    return files.exact_coverage(h, "h", ["v"], FIRST, LAST).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("q448_expected_hours", "WITH m AS (SELECT DISTINCT date_trunc('month', ts) AS m FROM events), h AS (SELECT m, unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h FROM m), e AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events) SELECT h.h::DATE AS day, count(*) AS hours, count(e.h) AS seen FROM h LEFT JOIN e ON e.h = h.h GROUP BY 1")
def hours(t: Tables) -> DataFrame:
    """Every hour of the months that events fall in, by day, and how many of them have events."""
    at = t.events.select(F.col("ts").cast("timestamp").alias("ts"))
    want = files.hours_of_months(at, "ts")
    have = at.select(F.date_trunc("hour", "ts").alias("time"), F.lit(1).alias("seen")).distinct()
    return want.join(have, "time", "left").groupBy(F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("hours"), F.count("seen").alias("seen"))


@query("q13_csv_scan", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def csv_scan(t: Tables) -> DataFrame:
    """A feature table as CSV, read back with a declared schema: the reader parses days and numbers, nothing is inferred."""
    path = place(t, "features")
    t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice").write.option("header", True).csv(path)
    back = files.table_csv(t.spark, path, "o_orderkey long, day date, o_totalprice double")
    return back.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("q14_csv_in_another_encoding", "SELECT c_custkey, c_name || ' é€' AS name FROM customer")
def encoded(t: Tables) -> DataFrame:
    """A table in another encoding. The session takes it only while the file is written and read."""
    path, name = place(t, "cp1252"), "spark.sql.legacy.javaCharsets"
    before = t.spark.conf.get(name, None)
    t.spark.conf.set(name, "true")
    try:
        t.customer.select("c_custkey", F.concat("c_name", F.lit(" é€")).alias("name")).write.option("header", True).option("encoding", "windows-1252").csv(path)
        return checkpointed(files.table_csv(t.spark, path, "c_custkey long, name string", "windows-1252"))
    finally:
        if before is None:
            t.spark.conf.unset(name)
        else:
            t.spark.conf.set(name, before)


@query("q15_json_records", "SELECT r_regionkey, r_name FROM region")
def json_records(t: Tables) -> DataFrame:
    """A document that holds its records under a name. The region table is the five regions."""
    path = place(t, "records")
    t.region.agg(F.to_json(F.struct(F.collect_list(F.struct("r_regionkey", "r_name")).alias("records")))).write.text(path)
    return files.records_json(t.spark, path, "r_regionkey int, r_name string").filter("r_name IS NOT NULL")


@query("q16_records_by_suffix", "SELECT n_nationkey, n_name FROM nation")
def by_suffix(t: Tables) -> DataFrame:
    path = place(t, "nations.csv")
    t.nation.select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return files.records(t.spark, path, "n_nationkey int, n_name string")


@query("q31_write_once", "SELECT s_suppkey, s_name, s_acctbal, TRUE AS refused FROM supplier")
def once(t: Tables) -> DataFrame:
    """A second write to the same place is refused, and every row of what was written first stays as it is."""
    path = place(t, "once")
    sinks.write_once(t.supplier, path)
    try:
        sinks.write_once(t.supplier.withColumn("s_acctbal", F.lit(0.0)), path)
        refused = False
    except AnalysisException:
        refused = True
    return t.spark.read.parquet(path).select("s_suppkey", "s_name", "s_acctbal", F.lit(refused).alias("refused"))


@query("q33_ordered_json", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def ordered_json(t: Tables) -> DataFrame:
    path = place(t, "json")
    sinks.ordered_json(t.nation, path, ["n_nationkey"])
    return t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@query("q34_ordered_csv", "SELECT 'n_name,n_nationkey,n_regionkey' AS header, count(*) AS n FROM nation")
def ordered_csv(t: Tables) -> DataFrame:
    path = place(t, "csv")
    sinks.ordered_csv(t.nation, path, ["n_nationkey"])
    lines = t.spark.read.text(path)
    return lines.agg(F.max(F.when(F.startswith("value", F.lit("n_name,")), F.col("value"))).alias("header"), F.count(F.when(~F.startswith("value", F.lit("n_name,")), 1)).alias("n"))


@query("q35_array_cells", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS words FROM part")
def array_cells(t: Tables) -> DataFrame:
    path = place(t, "cells")
    sinks.ordered_csv(t.part.select("p_partkey", F.split("p_name", " ").alias("words")), path, ["p_partkey"])
    return files.table_csv(t.spark, path, "p_partkey long, words string").select("p_partkey", "words")


#: One text file for each region, with its nations in order.
CONTENT_SQL = "f AS (SELECT n_regionkey AS region, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS body FROM nation GROUP BY 1)"


def named_manifest(t: Tables) -> DataFrame:
    """region and the manifest entry of its file."""
    path = place(t, "manifest")
    body = t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\n").alias("value"))
    body.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return files.manifest(t.spark, path).filter("path LIKE '%.txt'").withColumn("region", F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast("int"))


@query("q36_manifest", f"WITH {CONTENT_SQL} SELECT region, strlen(body)::BIGINT AS bytes, sha256(body) AS sha256 FROM f")
def manifest(t: Tables) -> DataFrame:
    return named_manifest(t).select("region", "bytes", "sha256")


@query("q37_manifest_verify", "SELECT DISTINCT n_regionkey AS region, CASE n_regionkey % 4 WHEN 1 THEN 'mismatch' WHEN 2 THEN 'extra' WHEN 3 THEN 'missing' END AS problem FROM nation WHERE n_regionkey % 4 <> 0")
def verify(t: Tables) -> DataFrame:
    """Files against a manifest that has another digest for one, lacks one, and names one that is gone."""
    known = named_manifest(t).select(F.col("region").cast("string").alias("path"), "region", "sha256")
    k = F.col("region") % 4
    declared = known.filter(k != 2).withColumn("sha256", F.when(k == 1, "other").otherwise(F.col("sha256")))
    return files.verify_manifest(declared, known.filter(k != 3)).select(F.col("path").cast("int").alias("region"), "problem")


@query("q24_zip_members", "SELECT n_regionkey AS region, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INT AS line, n_name AS text FROM nation")
def zip_lines(t: Tables) -> DataFrame:
    """The lines of the text members of archives: one archive for each region."""
    folder = place(t, "archives")
    body = t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\n").alias("text"))
    files.write_archives(body.select(F.col("n_regionkey").cast("string").alias("name"), "text"), folder).count()
    lines = files.zip_members(t.spark, folder)
    return lines.select(F.regexp_extract("path", "/(\\d+)[.]zip$", 1).cast("int").alias("region"), "line", "text")


@query("q101_table_digest", "SELECT count(*) AS rows_, TRUE AS same FROM supplier")
def digest(t: Tables) -> DataFrame:
    """The digest of a table is that of its rows, however they lie."""
    one, two = sinks.table_digest(t.supplier), sinks.table_digest(t.supplier.repartition(5, "s_nationkey"))
    return one.join(F.broadcast(two.select(F.col("digest").alias("other")))).select(F.col("rows").alias("rows_"), (F.col("digest") == F.col("other")).alias("same"))


@query("q417_tiles", "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, time_bucket(INTERVAL 3 HOUR, hour) AS \"start\", count(v) AS covered, round(max(v), 8) AS most FROM h GROUP BY 1, 2 HAVING count(v) = 3")
def tiled(t: Tables) -> DataFrame:
    h = t.events.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.avg("value").alias("v"))
    w = tiles(h, "event_type", "hour", "v", 3 * 3600, 3)
    return w.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "covered", F.round(F.array_max("samples"), 8).alias("most"))
