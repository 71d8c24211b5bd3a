"""Suffix-array dedup: maximal repeat groups from the common-prefix intervals of an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import kernels as K
from panelforge.llm.groups import whole_groups
from panelforge.llm.repeats import Shape, by_row, id_and_text, matrices, removed_units, repeated_windows, unpacked

SPAN, GRAM = 100, 24


def suffix_order(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The suffix array: rows in lexicographic order inside each group (rows are byte matrices)."""
    pad = -rows.shape[1] % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    return np.lexsort((*words.T[::-1], group))


def common_prefixes(rows: np.ndarray, have: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[i]: units that rows order[i-1] and order[i] share from the front; 0 over a change of group, lcp[0] = 0."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 50_000):
        x, y = order[at - 1 : at + 49_999], order[at : at + 50_000]
        x = x[: len(y)]
        differ = rows[x] != rows[y]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[at : at + len(y)] = np.where(group[x] == group[y], np.minimum(first, np.minimum(have[x], have[y])), 0)
    return out


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
    """(depth, parent depth, first, last) of every node of the common-prefix interval tree of depth least or more.

    One scan with a stack of open intervals; children come before their parents.
    """
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp[1:], 0], 1):
        first = i - 1
        while stack[-1][0] > depth:
            top, first = stack.pop()
            if top >= least:
                yield top, max(depth, stack[-1][0]), first, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, first))


def left_extents(left: np.ndarray, have: np.ndarray, members: np.ndarray) -> np.ndarray:
    """For members in order of priority: the longest left context each shares with any of higher priority, -1 for the first.

    This is the left-extension test of an interval: occurrences whose left contexts part are different
    maximal repeats, those that go on together are one.
    """
    n = len(members)
    out = np.full(n, -1, np.int64)
    if n == 2:
        a, b = members
        differ = left[a] != left[b]
        out[1] = min(int(differ.argmax()) if differ.any() else left.shape[1], have[a], have[b])
        return out
    order = suffix_order(left[members], np.zeros(n, np.int64))
    lcp = common_prefixes(left[members], have[members], np.zeros(n, np.int64), order)
    for places, shared in ((order, lcp), (order[::-1], np.concatenate([[0], lcp[1:][::-1]]))):
        open_: list[tuple[int, int]] = []  # (priority, lcp with what comes after), nearest last
        for p, s in zip(places.tolist(), shared.tolist(), strict=True):
            while open_ and open_[-1][0] > p:
                s = min(s, open_.pop()[1])
            if open_:
                out[p] = max(out[p], s)
            open_.append((p, s))
    return out


def repeat_groups(right: np.ndarray, right_have: np.ndarray, left: np.ndarray, left_have: np.ndarray, group: np.ndarray, span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(shared, parent's shared, members, left extents): every interval whose windows of `span` units may repeat.

    right, left: units after and before an aligned place, of members already in order of priority. All
    members of an interval share `shared` units to the right, so the windows that start j units to the
    left, span - shared <= j <= left extent, are repeats.
    """
    order = suffix_order(right, group)
    lcp = common_prefixes(right, right_have, group, order)
    for depth, parent, first, last in intervals(lcp.tolist(), span - left.shape[1]):
        members = np.sort(order[first : last + 1])
        yield depth, parent, members, left_extents(left, left_have, members)


def _look(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "anchor"):
            right, right_have, left, left_have = matrices(table, shape)
            doc, place = table.column("doc_id").to_numpy(), table.column("place").to_numpy()
            lo, count, before = unpacked(place)
            _, group = np.unique(table.column("anchor").to_numpy(), return_inverse=True)
            out: list[tuple[np.ndarray, ...]] = []
            for shared, parent, members, extent in repeat_groups(right, right_have, left, left_have, group, shape.span):
                # windows start j units before the anchor: those of this interval and not of its parent, of this run
                most = np.minimum(np.minimum(extent, shape.span - parent - 1), before[members])
                least = np.maximum(shape.span - shared, before[members] - count[members] + 1)
                ok = most >= least
                if ok.any():
                    m = members[ok]
                    out.append((doc[m], lo[m] + before[m] - most[ok], most[ok] - least[ok] + 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["doc_id", "lo", "n"])

    return look


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def byte_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes).

    Removed is every byte covered by a span-byte string that also starts earlier, in a document of smaller
    doc_id or earlier in the same one; matches never cross documents and strings are judged on the input.
    Texts are UTF-8 bytes, null counts as empty. Rows with a null id are compared with nothing and keep all.
    Rows that repeat an id are documents of their own, in order of their place in the table. An empty
    table gives no rows; other columns are not read. span: from 40 to 170.
    """
    shape = Shape("byte", span, GRAM, True)
    return by_row(id_and_text(docs, id_col, text_col), lambda base: _byte_dedup(base, shape))


def _byte_dedup(base: DataFrame, shape: Shape) -> DataFrame:
    span = shape.span
    marked = repeated_windows(base, shape, _look)
    lone = base.filter("doc_id IS NULL").select("doc_id", "text", F.lit(False).alias("repeats"), F.lit(False).alias("copy"), F.lit(None).cast("array<struct<lo: long, n: long>>").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = K.text_buffers(batch.column(1))
            for a, b in K.slices(off):
                part = batch.slice(a, b - a)
                data, at = K.text_buffers(part.column(1))
                gone = removed_units(part.column(4), at, span)
                size = np.diff(at)
                gone |= np.repeat(part.column(3).to_numpy(zero_copy_only=False).astype(bool) & (size >= span), size)
                total = np.concatenate([[0], np.cumsum(gone)])
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                edge = at[1:-1][at[1:-1] < len(gone)]
                head[edge] |= gone[edge]
                heads = np.concatenate([[0], np.cumsum(head)])
                n_removed = total[at[1:]] - total[at[:-1]]
                raw, stay = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(size - n_removed)]).tolist()
                kept = [raw[x:y] for x, y in zip(stay[:-1], stay[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n_removed), pa.array(heads[at[1:]] - heads[at[:-1]]), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.unionByName(lone).mapInArrow(K.tidy(cut), KEPT)


def byte_digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return deduped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
