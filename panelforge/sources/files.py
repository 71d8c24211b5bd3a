"""Sources: record files in several shapes, archive members, byte manifests. All reads go through Spark's readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes of the formats.
MAGIC = {"zip": "504b0304", "hdf5": "89484446", "parquet": "50415231", "gzip": "1f8b", "cdf1": "43444601", "cdf2": "43444602"}


def records_json(spark: SparkSession, path: str, schema: str, under: tuple[str, ...] = ("events", "records")) -> DataFrame:
    """Records of a JSON file that is an array, or an object that holds the array under one of these names."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    arrays = [F.from_json("t", f"array<struct<{schema}>>")] + [F.from_json("t", f"struct<`{u}`: array<struct<{schema}>>>").getField(u) for u in under]
    picked = F.when(F.startswith("t", F.lit("[")), arrays[0]).otherwise(F.coalesce(*arrays[1:]))
    return whole.select(F.explode(picked).alias("r")).select("r.*")


def table_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """A headed CSV file with a declared schema; encoding by name, windows-1252 for instance."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else only ISO-8859-1, US-ASCII and the UTFs are taken
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("enforceSchema", False).csv(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV or JSON record file, by its suffix."""
    return table_csv(spark, path, schema) if path.lower().endswith(".csv") else records_json(spark, path, schema)


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def file_kind(content: Column) -> Column:
    """Format by leading bytes; unknown otherwise."""
    head = F.lower(F.hex(F.substring(content, 1, 4)))
    kind = F.lit("unknown")
    for name, magic in reversed(MAGIC.items()):
        kind = F.when(F.startswith(head, F.lit(magic)), name).otherwise(kind)
    return kind


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files under path, one task a file split; contents never reach the driver."""
    return raw_files(spark, path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, problem): missing, extra or mismatch, of what differs."""
    both = declared.select("path", F.col("sha256").alias("want")).join(actual.select("path", F.col("sha256").alias("have")), "path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "mismatch")
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def zip_members(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """(path, member, line, text) of the text members of the archives under path."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        lines = z.read(name).decode("utf-8", "replace").splitlines()
                        yield pd.DataFrame({"path": at, "member": name, "line": range(len(lines)), "text": lines})

    return raw_files(spark, path, "*.zip").select("path", "content").mapInPandas(unpack, "path string, member string, line int, text string")


def write_archives(texts: DataFrame, folder: str, member: str = "data.csv") -> DataFrame:
    """Write each (name, text) as the member of a ZIP archive of that name; (path)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(member, text)
                with store.open_output_stream(f"{root}/{name}.zip", compression=None) as out:
                    out.write(held.getvalue())
            yield pd.DataFrame({"path": [f"{folder}/{n}.zip" for n in batch["name"]]})

    return texts.select("name", "text").mapInPandas(pack, "path string")


def hours_of_months(df: DataFrame, ts: str) -> DataFrame:
    """(time): every hour of every month that a row's time falls in."""
    month = df.select(F.date_trunc("month", ts).alias("m")).distinct()
    return month.select(F.explode(F.sequence("m", F.col("m") + F.expr("INTERVAL 1 MONTH") - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))).alias("time"))


def expected_hours(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(time): every hour from first to last, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"), F.expr("INTERVAL 1 HOUR"))).alias("time"))


def exact_coverage(df: DataFrame, time: str, values: list[str], first: str, last: str) -> DataFrame:
    """(time, problem): missing, unexpected or repeated times, and rows with a value that is null or not finite."""
    want = expected_hours(df.sparkSession, first, last)
    bad = F.lit(False)
    for c in values:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    got = df.groupBy(F.col(time).alias("time")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(bad).alias("bad"))
    both = want.withColumn("want", F.lit(True)).join(got, "time", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(F.col("bad"), "not finite")
    return both.select("time", problem.alias("problem")).filter("problem IS NOT NULL")
