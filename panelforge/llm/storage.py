"""Where intermediate tables go, and the few session settings the Arrow stages rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); one of our own, the same all session long, only where that is
    unset and there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="panelforge-")
    return _OWN[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by bytes: whole texts may be long, plain numbers are short."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")


def parts(spark: SparkSession, least: int = 12) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: The column that numbered() adds.
ROW = "_row_number"
#: Rows (a number each) that are broadcast at most; more are joined by a shuffle of both sides.
BROADCAST_ROWS = 2_000_000


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW, a number of its own for every row that is the same whenever and wherever the row is read.

    It is the row's place in its file and the file's place among the table's, so no row moves for it. What is not read
    straight from Parquet files is written first. The file names (not rows) pass through the driver.
    """
    spark = docs.sparkSession

    def places(df: DataFrame) -> DataFrame:
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_nth"))

    try:
        rows = places(docs.drop(ROW))
        files = sorted(r[0] for r in rows.select("_file").distinct().collect())
    except AnalysisException:
        rows = places(stored(docs.drop(ROW), "rows"))
        files = sorted(r[0] for r in rows.select("_file").distinct().collect())
    place = spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_file string, _at long")
    return rows.join(F.broadcast(place), "_file").withColumn(ROW, F.shiftleft("_at", 40) + F.col("_nth")).drop("_file", "_at", "_nth")


def plain(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ...: whatever their own names, none is that of a column added on the way."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def called(docs: DataFrame, name: str) -> str:
    """What plain() calls the column of this name."""
    return f"c{docs.columns.index(name)}"


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """numbered rows without those whose ROW is in gone, and without ROW. Rows stay where they are if few go."""
    gone = stored(gone, "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone.hint("merge"), ROW, "left_anti").drop(ROW)


def with_rows(rows: DataFrame, facts: DataFrame, how: str = "inner", entries: Column | None = None) -> DataFrame:
    """numbered rows joined to facts on ROW, which has any number of rows for each. Texts stay where they are if facts are few.

    entries: what a fact holds besides itself, in numbers of 16 bytes or so, where it has arrays; they count as rows do.
    """
    size = facts.limit(BROADCAST_ROWS + 1).count() if entries is None else facts.agg(F.sum(F.lit(1) + entries)).first()[0] or 0
    return rows.join(F.broadcast(facts) if size <= BROADCAST_ROWS else facts.hint("merge"), ROW, how)
