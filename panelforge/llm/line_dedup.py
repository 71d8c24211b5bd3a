"""Line dedup over content-defined chunks of lines. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.skew import lookup
from panelforge.llm.storage import ROW, numbered, stored, with_rows

#: Of the 256 first hex pairs of a rolling hash, those from here on do not end a stretch: 31 of 32 lines do.
UNCUT = "f8"
KEY = ["digest", "n_bytes"]


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value at hand, so that what refers to it often does not work it out anew each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines_of(text: str) -> Column:
    return F.split(text, "\n", -1)


def stretch_ends(lines: Column) -> Column:
    """Where stretches of lines end, as places from 0 on: after a line that is not blank and whose hash, rolled over its own
    and the previous line's, says so, and after the last. Boundaries depend on two lines, so they fall alike wherever the
    same lines occur."""

    def from_marks(marks: Column) -> Column:
        rolled = F.zip_with(F.array_prepend(F.slice(marks, 1, F.size(marks) - 1), ""), marks, lambda before, own: F.substring(F.md5(F.encode(F.concat(before, own), "utf-8")), 1, 2) < UNCUT)
        cut = F.zip_with(rolled, lines, lambda r, line: r & (F.trim(line) != ""))
        placed = F.filter(F.transform(cut, lambda c, i: F.when(c, i)), lambda i: i.isNotNull())
        return F.array_union(placed, F.array(F.size(marks) - 1))

    return held(F.transform(lines, lambda line: F.substring(F.md5(F.encode(line, "utf-8")), 1, 8)), from_marks)


def chunks_of(text: str) -> Column:
    """The chunks of a text: (from, to, digest, n_bytes) of every two neighbouring stretches together. Chunks overlap, so that
    a passage of few lines holds whole ones wherever its own boundaries fall."""

    def made(lines: Column) -> Column:
        def between(ends: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1))
            both = F.filter(F.zip_with(starts, F.slice(ends, 2, F.size(ends)), lambda a, z: F.struct(a.alias("from"), z.alias("to"))), lambda p: p["to"].isNotNull())
            said = lambda p: F.array_join(F.slice(lines, p["from"] + 1, p["to"] - p["from"] + 1), "\n")
            return F.transform(both, lambda p: held(said(p), lambda s: F.struct(p["from"].alias("from"), p["to"].alias("to"), F.unhex(F.sha2(F.encode(s, "utf-8"), 256)).alias("digest"), F.octet_length(s).alias("n_bytes"))))

        return held(stretch_ends(lines), between)

    return held(lines_of(text), made)


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed (lines), n_chunks (repeated ones but the first), kept (the other lines).

    A chunk is two neighbouring stretches of lines. Of equal chunks the first stays, by doc_id (null last), the row's place in
    the table and position; the lines of the others go, whichever chunk covers them. Chunks are judged on the input. They
    meet by SHA-256 and length, once worked out, and those that meet are compared byte by byte: only repeated chunks move as
    text, one for each task that has them. Chunks that meet but are not equal stay. The empty text has one empty line; null
    has none and is kept as the empty text. An empty table gives no rows; other columns are not read.
    """
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    found = rows.filter("text IS NOT NULL").select(ROW, "doc_id", F.explode(chunks_of("text")).alias("c"))
    chunks = stored(found.select(ROW, "doc_id", "c.*"), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW, "from")
    repeated = stored(chunks.groupBy(*KEY).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    asked = lookup(chunks, repeated.select(*KEY, "n"), KEY, "n").groupBy(ROW).agg(F.collect_list(F.struct("from", "to", *KEY)).alias("asked"))
    texts = with_rows(rows.select(ROW, "text"), stored(asked, "asked"), entries=F.size("asked") * 4)
    said = held(lines_of("text"), lambda lines: F.transform("asked", lambda x: F.struct(*[x[k].alias(k) for k in KEY], F.array_join(F.slice(lines, x["from"] + 1, x["to"] - x["from"] + 1), "\n").alias("chunk"))))
    equal = texts.select(F.explode(said).alias("x")).select("x.*").groupBy(*KEY).agg((F.min("chunk") == F.max("chunk")).alias("equal"))
    sure = stored(repeated.join(equal.filter("equal"), KEY, "left_semi"), "sure")
    gone = lookup(chunks, sure, KEY, "n").filter(place != F.col("first")).groupBy(ROW).agg(F.collect_list(F.struct("from", "to")).alias("gone"))
    gone = gone.select(ROW, F.size("gone").cast("long").alias("n_chunks"), F.array_distinct(F.flatten(F.transform("gone", lambda x: F.sequence(x["from"], x["to"])))).alias("gone"))
    marked = with_rows(rows, stored(gone, "gone"), "left", entries=F.size("gone"))
    stay = held(lines_of("text"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i)), "\n"))
    return marked.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(line_count(F.col("text"))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(stay).alias("kept"),
    )


def line_digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chunks, kept_sha256."""
    return deduped.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
