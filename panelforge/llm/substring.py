"""Substring dedup by seed and extend: winnowed anchors join documents, matches are extended both ways."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import kernels as K
from panelforge.llm.groups import whole_groups
from panelforge.llm.repeats import Shape, Units, by_row, id_and_text, matrices, removed_units, repeated_windows, unpacked

SPAN, GRAM = 35, 16


def _side(rows: np.ndarray, have: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order by seed and words, and how many words each shares with the one before (-1: another seed)."""
    order = np.lexsort((*rows.T[::-1], seed))
    x, y = order[:-1], order[1:]
    differ = rows[x] != rows[y]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared = np.where(seed[x] == seed[y], np.minimum(shared, np.minimum(have[x], have[y])), -1)
    return order, np.concatenate([[-1], shared])


def _parts(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """A number for each row, equal where rows of one seed share `least` words or more."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < least)
    return out


def extended(right: np.ndarray, right_have: np.ndarray, left: np.ndarray, left_have: np.ndarray, seed: np.ndarray, span: int) -> np.ndarray:
    """hit[i, j]: whether occurrence i of its seed and some other share j words to the left of it and span - j from it on.

    The seeds' occurrences are extended to the right and to the left once each, all together: sorted by
    what follows (or precedes) them, neighbours show how far any two agree. No pairs are formed.
    """
    hit = np.zeros((len(seed), left.shape[1] + 1), bool)
    right_order, right_shared = _side(right, right_have, seed)
    left_order, left_shared = _side(left, left_have, seed)
    for j in range(left.shape[1] + 1):
        able = np.flatnonzero((left_have >= j) & (right_have >= span - j))
        pair = np.stack([_parts(right_order, right_shared, span - j)[able], _parts(left_order, left_shared, j)[able]], axis=1)
        if len(pair):
            key = pair[:, 0] * (len(seed) + 1) + pair[:, 1]
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            hit[able, j] = count[back] > 1
    return hit


def _look(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "anchor"):
            right, right_have, left, left_have = matrices(table, shape)
            doc, place = table.column("doc_id").to_numpy(), table.column("place").to_numpy()
            lo, count, before = unpacked(place)
            hit = extended(right, right_have, left, left_have, table.column("anchor").to_numpy(), shape.span)
            j = np.arange(hit.shape[1])
            hit &= (j <= before[:, None]) & (j > (before - count)[:, None])
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, first = np.nonzero(edge == 1)
            last = np.nonzero(edge == -1)[1] - 1
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(lo[row] + before[row] - last), pa.array(last - first + 1)], ["doc_id", "lo", "n"])

    return look


KEPT = "doc_id long, n_words long, n_removed long, kept binary"


def word_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the other words joined by one space, UTF-8).

    Words are runs of non-blanks, unchanged; null has none. Removed is every word covered by a window of
    span consecutive words whose sequence also starts anywhere else, in any document, the same included;
    windows are judged on the input. Rows with a null id are compared with nothing and keep all. Rows that
    repeat an id are documents of their own, each with its own text. An empty table gives no rows; other columns are
    not read. span: from 20 to 250.
    """
    shape = Shape("word", span, GRAM, False)
    return by_row(id_and_text(docs, id_col, text_col), lambda base: _word_dedup(base, shape))


def _word_dedup(base: DataFrame, shape: Shape) -> DataFrame:
    span = shape.span
    marked = repeated_windows(base, shape, _look)
    lone = base.filter("doc_id IS NULL").select("doc_id", "text", F.lit(False).alias("repeats"), F.lit(False).alias("copy"), F.lit(None).cast("array<struct<lo: long, n: long>>").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = K.text_buffers(batch.column(1))
            for a, b in K.slices(off):
                part = batch.slice(a, b - a)
                u = Units(part.column(1), "word")
                size = np.diff(u.at)
                gone = removed_units(part.column(4), u.at, span)
                gone |= np.repeat(part.column(2).to_numpy(zero_copy_only=False).astype(bool) & (size >= span), size)
                total = np.concatenate([[0], np.cumsum(gone)])
                n_removed = total[u.at[1:]] - total[u.at[:-1]]
                start, length = u.starts[~gone], (u.ends - u.starts)[~gone] + 1
                out_off = np.concatenate([[0], np.cumsum(length)])
                where = np.repeat(start - out_off[:-1], length) + np.arange(out_off[-1])
                flat = u.data[np.minimum(where, len(u.data) - 1)] if len(where) else np.zeros(0, np.uint8)
                flat[out_off[1:] - 1] = 32
                raw, stay = flat.tobytes(), out_off[np.concatenate([[0], np.cumsum(size - n_removed)])].tolist()
                kept = [raw[x : y - 1] if y > x else b"" for x, y in zip(stay[:-1], stay[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n_removed), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return marked.unionByName(lone).mapInArrow(K.tidy(cut), KEPT)


def word_digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
