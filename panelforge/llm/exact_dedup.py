"""Exact dedup by a tree-merge of digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.skew import lookup
from panelforge.llm.storage import ROW, called, numbered, parts, plain, stored, without_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS, FAN_IN = 64, 4
KEY = ["digest", "n_bytes", "guard"]


def normalised(text: str) -> Column:
    """The text with A-Z (and nothing else) lower-cased; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, row, digest, n_bytes, guard, run): SHA-256, length and an independent 64-bit hash of each text.

    row: the column that tells rows apart, 0 if there is none. run: the sorted run that a row starts in, one of RUNS, by
    the partition that read it.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), (F.lit(0).cast("long") if row is None else F.col(row)).alias("row"), normalised(text_col).alias("t"))
    return norm.select(
        "doc_id",
        "row",
        F.unhex(F.sha2(F.encode("t", "utf-8"), 256)).alias("digest"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("guard"),
        F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"),
    )


def _merged(sorted_runs: DataFrame, entry: Column, size: Column) -> DataFrame:
    """One entry for each text of each run. Rows stay sorted: the least or largest struct is kept by merging, not hashing."""
    return sorted_runs.groupBy("run", "slice", *KEY).agg(entry.alias("keep"), size.alias("group_size"))


def merge_runs(rows: DataFrame, keep: str = "max") -> DataFrame:
    """(digest, n_bytes, guard, keep_id, keep_row, group_size) after the binomial rounds.

    A run is what a partition read, sorted by digest, with equal texts already one entry. In each round FAN_IN neighbouring
    runs become one: their partitions exchange slices of the digests, so that every task gets one slice of all FAN_IN runs,
    merges them in digest order, and of entries of the same text retains the one to keep. An entry is a candidate only for
    entries whose digest, length and guard all agree, so each level verifies the identifier it retains. A hot text is one
    entry a run before anything moves, and slices spread each round evenly. The last round leaves one run, in slices.
    """
    first = F.col("doc_id").isNull() if keep == "min" else F.col("doc_id").isNotNull()
    best = {"max": F.max, "min": F.min}[keep]
    level = _merged(rows.withColumn("slice", F.substring("digest", 1, 2)), best(F.struct(first.alias("named"), F.col("doc_id").alias("id"), F.col("row").alias("row"))), F.count(F.lit(1)))
    n = RUNS
    while n > 1:
        n = -(-n // FAN_IN)
        moved = level.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")).repartition(parts(rows.sparkSession), "run", "slice")
        level = _merged(moved.sortWithinPartitions("run", "slice", *KEY), best("keep"), F.sum("group_size"))
    return level.select(*KEY, F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", row: str | None = None) -> DataFrame:
    """Every input row as (doc_id, row, digest, keep_id, keep_row, group_size)."""
    rows = stored(digests(docs, id_col, text_col, row), "digests")
    groups = stored(merge_runs(rows, keep), "merged")
    return lookup(rows.drop("run"), groups, KEY, "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text, which is a text
    like any other. Of equal texts the row of the largest (keep="max") or smallest id stays. Rows that
    repeat an id with the same text are all kept or all dropped. A null id loses to any other; where a
    group has null ids only, keep_id is null and its rows are kept. An empty table gives no rows. Other
    columns are not read, so their names cannot clash.
    """
    return judged(docs, id_col, text_col, keep).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs with one row for each text, all columns as they are, whatever their names; ids only say which row that is (of equal ids any one)."""
    rows = numbered(plain(docs))
    gone = judged(rows, called(docs, id_col), called(docs, text_col), keep, ROW).filter("row <> keep_row").select(F.col("row").alias(ROW))
    return without_rows(rows, gone).toDF(*docs.columns)
