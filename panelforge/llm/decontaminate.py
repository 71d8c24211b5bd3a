"""Benchmark decontamination: a broadcast hash set of test windows against the windows of every text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import kernels as K
from panelforge.llm.skew import lookup
from panelforge.llm.storage import BROADCAST_ROWS, called, plain, small_batches, stored

WINDOW = 10
#: Item text (bytes, 64 more an item) up to which the windows themselves are broadcast. An index takes about
#: 6 bytes a byte of text (a window a word: hash, place, length and item, 24 bytes), so 100 MB a worker at most.
BLOCK_BYTES = 16_000_000
#: Bits of the filter that is broadcast in place of a larger index: 32 MB, whatever the benchmark.
FILTER_BITS = 1 << 28


class Words:
    """The words of texts laid end to end, lower-cased and one space apart."""

    def __init__(self, texts: pa.Array) -> None:
        data, off = K.text_buffers(texts)
        self.starts, self.ends, self.h, self.at = K.words(data, off, K.ALNUM_WORD, lower=True)
        self._data, self._joined = data, None

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each begins."""
        if self._joined is None:
            length = self.ends - self.starts + 1
            off = np.concatenate([[0], np.cumsum(length)])
            where = np.repeat(self.starts - off[:-1], length) + np.arange(off[-1])
            flat = K.LOWER[self._data[np.minimum(where, len(self._data) - 1)]] if len(where) else np.zeros(0, np.uint8)
            flat[off[1:] - 1] = 32
            self._joined = flat.tobytes(), off
        return self._joined

    def windows(self, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, row, first word) of the windows of every row: of fewer words than window, the row as a whole."""
        n = np.diff(self.at)
        many = np.maximum(n - window + 1, 0)
        row = np.repeat(np.arange(len(n)), many)
        yield window, row, self.at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        for size in np.unique(n[(n > 0) & (n < window)]).tolist():
            row = np.flatnonzero(n == size)
            yield size, row, self.at[:-1][row]


class Windows:
    """The distinct windows of the items as flat arrays: sorted hashes, the words behind each and the items that have it."""

    def __init__(self, items: list[tuple], window: int) -> None:
        self.names = [str(i) for i, _ in items]
        words = Words(pa.array([t for _, t in items], pa.large_string()))
        self.text, off = words.joined()
        self.by: dict[int, tuple[np.ndarray, ...]] = {}
        for size, row, first in words.windows(window):
            if not len(row):
                continue
            h = K.grams(words.h, size)[first]
            order = np.argsort(h, kind="stable")
            h, row, a = h[order], row[order], off[first[order]]
            n = off[first[order] + size] - 1 - a
            head = np.concatenate([[True], h[1:] != h[:-1]])
            group = np.cumsum(head) - 1
            if not head.all():  # of windows with equal hashes those with other words become groups of their own
                starts = np.flatnonzero(head)
                leader = starts[group]
                odd = [i for i in np.flatnonzero(~head).tolist() if self.text[a[i] : a[i] + n[i]] != self.text[a[leader[i]] : a[leader[i]] + n[leader[i]]]]
                if odd:
                    _, group = np.unique(np.array([self.text[x : x + y] for x, y in zip(a.tolist(), n.tolist(), strict=True)], object), return_inverse=True)
                    order = np.lexsort((group, h))
                    h, row, a, n, group = h[order], row[order], a[order], n[order], group[order]
                    head = np.concatenate([[True], group[1:] != group[:-1]])
            lead = np.flatnonzero(head)
            self.by[size] = (h[lead], a[lead], n[lead], np.concatenate([lead, [len(h)]]), row.astype(np.int32))

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Words of each text, the hit word ranges of each, and the items found in each."""
        words = Words(texts)
        rows = len(words.at) - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        found: list[set[tuple[int, int]]] = [set() for _ in range(rows)]
        for size, (hashes, a, n, _, _) in self.by.items():
            g = K.grams(words.h, size)
            where = np.searchsorted(hashes, g)
            hit = np.flatnonzero(hashes[np.minimum(where, len(hashes) - 1)] == g)
            row = np.searchsorted(words.at, hit, "right") - 1
            inside = hit + size <= words.at[row + 1]
            if not inside.any():
                continue
            joined, off = words.joined()
            for i, r, k in zip(hit[inside].tolist(), row[inside].tolist(), where[hit[inside]].tolist(), strict=True):
                own = joined[off[i] : off[i + size] - 1]
                while k < len(hashes) and hashes[k] == g[i]:
                    if n[k] == len(own) and self.text[a[k] : a[k] + n[k]] == own:
                        spans[r].append((i - int(words.at[r]), i - int(words.at[r]) + size))
                        found[r].add((size, k))
                        break
                    k += 1
        names = [{self.names[j] for size, k in x for j in self.by[size][4][self.by[size][3][k] : self.by[size][3][k + 1]].tolist()} for x in found]
        return np.diff(words.at), spans, names


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("_n_words", T.LongType()), T.StructField("_spans", SPAN), T.StructField("_items", T.ArrayType(T.StringType()))]
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _broadcast_scan(docs: DataFrame, known: DataFrame, text_col: str, window: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(Windows([(r.i, r.t) for r in known.collect()], window))
    schema = T.StructType([*docs.schema.fields, *FOUND])
    column = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = K.text_buffers(batch.column(column))
            for a, b in K.slices(off):
                part = batch.slice(a, b - a)
                n, spans, found = index.value.scan(part.column(column))
                merged = [[{"start": s, "end": e} for s, e in _merged(x)] for x in spans]
                more = [pa.array(n, pa.int64()), pa.array(merged, _SPAN), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema.names)

    return docs.mapInArrow(K.tidy(scan), schema)


def _item_windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item, text) -> the words, size and slot of each of its windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = K.text_buffers(batch.column(1))
            for a, b in K.slices(off):
                words = Words(batch.column(1).slice(a, b - a))
                joined, at = words.joined()
                for size, row, first in words.windows(window):
                    texts = [joined[x:y].decode() for x, y in zip(at[first].tolist(), (at[first + size] - 1).tolist(), strict=True)]
                    slot = (K.mix(K.grams(words.h, size)[first], 51) % K.U(FILTER_BITS)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(texts, pa.string()), pa.array(np.full(len(row), size, np.int32)), pa.array(slot)], ["item", "words", "size", "slot"])

    return scan


def _joined_scan(docs: DataFrame, known: DataFrame, text_col: str, window: int) -> DataFrame:
    """The same result for a benchmark of any size: documents send the windows that pass a filter of fixed size, which
    are joined to the items' by their words. Rows are told apart by a number of their own."""
    spark = docs.sparkSession
    items = stored(known.select(F.col("i").cast("string").alias("item"), F.col("t")).mapInArrow(K.tidy(_item_windows(window)), "item string, words string, size int, slot long"), "windows")
    bits = items.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most `window` of them
    passing = spark.sparkContext.broadcast(table)
    hit = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64()), ("words", pa.string())]))
    names, column = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([T.StructField("_row", T.LongType()), *docs.schema.fields, FOUND[0], T.StructField("_near", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("size", T.LongType()), T.StructField("words", T.StringType())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row0 = TaskContext.get().partitionId() << 40
        for batch in batches:
            _, off = K.text_buffers(batch.column(column))
            for a, b in K.slices(off):
                part = batch.slice(a, b - a)
                words = Words(part.column(column))
                near: list[list[dict]] = [[] for _ in range(b - a)]
                for size in sizes:
                    slot = K.mix(K.grams(words.h, size), 51) % K.U(FILTER_BITS)
                    at = np.flatnonzero(passing.value[(slot >> K.U(6)).astype(np.int64)] >> (slot & K.U(63)) & K.U(1))
                    row = np.searchsorted(words.at, at, "right") - 1
                    inside = at + size <= words.at[row + 1]
                    if inside.any():
                        joined, place = words.joined()
                        for i, r in zip(at[inside].tolist(), row[inside].tolist(), strict=True):
                            near[r].append({"start": i - int(words.at[r]), "size": size, "words": joined[place[i] : place[i + size] - 1].decode()})
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row0, row0 + b - a)), *part.columns, pa.array(np.diff(words.at), pa.int64()), pa.array(near, hit)], schema.names)
                row0 += b - a

    rows = stored(docs.mapInArrow(K.tidy(scan), schema), "scanned")
    near = stored(rows.select("_row", F.explode("_near").alias("w")).select("_row", "w.*"), "near")
    windows = items.select("words", "item").distinct()
    # a passage that a third of all documents hold is joined where its rows lie
    known_words = stored(near.groupBy("words").agg(F.count(F.lit(1)).alias("n")).join(windows.select("words").distinct(), "words"), "met")
    hits = lookup(near, known_words, ["words"], "n").select("_row", "words", "start", (F.col("start") + F.col("size")).alias("end"))
    w = Window.partitionBy("_row").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("_row", "start", "end").distinct().withColumn("fresh", (before.isNull() | (before < F.col("start"))).cast("int")).withColumn("run", F.sum("fresh").over(w))
    united = runs.groupBy("_row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = united.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).cast(SPAN).alias("_spans"))
    met = windows.join(known_words, "words")
    few = met.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and (met.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0) <= BLOCK_BYTES
    owners = hits.select("_row", "words").distinct().join(F.broadcast(met) if few else met, "words").select("_row", "item").distinct().groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("_items"))
    found = spans.join(owners, "_row")
    out = rows.join(found, "_row", "left").withColumn("_spans", F.coalesce("_spans", F.array().cast(SPAN))).withColumn("_items", F.coalesce("_items", F.array().cast("array<string>")))
    return out.select(*docs.columns, "_n_words", "_spans", "_items").toDF(*names, "_n_words", "_spans", "_items")


def scanned(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, every row and column as it is, with _n_words, _spans (maximal hit word ranges) and _items (ids found, sorted
    as strings). Columns of these names in the input are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("_n_words", "_spans", "_items")
    known = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i IS NOT NULL")
    total = known.agg(F.sum(F.octet_length(F.coalesce("t", F.lit(""))) + 64)).first()[0] or 0
    return (_broadcast_scan if total <= block_bytes else _joined_scan)(docs, known, text_col, window)


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans (maximal hit word ranges), items (ids found, sorted as strings).

    Words are runs of digits, letters a-z and non-ASCII characters after lower-casing A-Z. A window is
    `window` consecutive words of an item; a shorter item that has words is one window. Hash hits are
    verified word by word. Null and empty texts have no words, hence no hits; items with a null id or
    without words match nothing; without items every row comes back clean. Repeated rows each come back,
    judged by their own text, null ids too. A benchmark over block_bytes is not broadcast but joined.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = scanned(rows, items, "text", item_id, item_text, window, block_bytes)
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def without_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, whatever their ids, in which no window of an item occurs: judged where they lie, in one pass."""
    rows = plain(docs)
    return scanned(rows, items, called(docs, text_col), **options).filter("size(_spans) = 0").select(*rows.columns).toDF(*docs.columns)


def hit_digest(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
