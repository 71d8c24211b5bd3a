"""Repeated fixed-length strings over all documents: shared plan of the substring and suffix-array dedup.

A document is a sequence of units (bytes or words). A window is `span` consecutive units. Among the grams
(`gram` consecutive units) of a window, the leftmost of least hash is its anchor: content alone decides, so
equal windows have equal anchors at the same place. Consecutive windows of one anchor are a run. Runs are
what moves between machines: about two for every span - gram + 2 units, 4 numbers each.

1. Runs meet by anchor. An anchor seen once proves all its windows unique: most text ends here.
2. Runs of the same anchor and the same units are a class: its repeats are settled by counting.
   A class that a sample of the documents shows to be hot (a passage that many share) is settled before it
   moves: rows after the sample's first one are repeats whatever else there is, and go their own ways; the
   others, few, stand for the class. The sample decides only how rows travel, never what they are.
3. Anchors with several classes need a closer look, at one run of each class: its units (at most
   2 * span - gram) are fetched and compared by a method of the caller's. Of anchors with very many runs
   the windows of each such run are fetched as hashes, and each window's content is a group of its own:
   however many texts share a passage, no task holds them.
4. Windows found repeated are applied to the documents.

Texts move once (both fetches read the same exchange by id). Exact copies of whole documents are settled
by digest first, so a group of copies, however large, takes part as one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import kernels as K
from panelforge.llm.groups import bounded_groups, dealt
from panelforge.llm.skew import lookup
from panelforge.llm.storage import BROADCAST_ROWS, ROW, numbered, parts, small_batches, stored
from panelforge.operators.order import running

SEGMENT = 1 << 20
PLACE = 22
#: Rows of one anchor that a task holds at once. An anchor with more is taken in parts, and what needs a closer
#: look in it is compared window by window, by content, instead of run by run.
HELD_ROWS = 200_000
#: One document in SAMPLE is looked at for hot classes and anchors: those with a share HOT of a task's rows, MOST_HOT at most.
SAMPLE, HOT, MOST_HOT = 64, 0.1, 1024
#: Parts that the copies of one window are first settled in.
SALTS = 16


@dataclass(frozen=True)
class Shape:
    """unit: byte or word. span: units of a window. gram: units of an anchor. earlier: only windows that also
    start earlier count (else all that also start elsewhere)."""

    unit: str
    span: int
    gram: int
    earlier: bool

    @property
    def width(self) -> int:
        return self.span - self.gram + 1


class Units:
    """The unit codes of a range of texts, with where each text's units begin."""

    def __init__(self, col: pa.Array, unit: str) -> None:
        self.data, self.off = K.text_buffers(col)
        if unit == "byte":
            self.at, self.codes = self.off, K.BYTE_CODES[self.data]
        else:
            self.starts, self.ends, self.codes, self.at = K.words(self.data, self.off, K.BLANK_WORD, lower=False)


def runs_of(codes: np.ndarray, at: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """row, first window, number of windows, units before the anchor, anchor hash and class hash of every run."""
    gathered: list[tuple[np.ndarray, ...]] = []
    row0, rows = 0, len(at) - 1
    while row0 < rows:
        row1 = max(row0 + 1, int(np.searchsorted(at, at[row0] + SEGMENT, "right")) - 1)
        base, stop = int(at[row0]), int(at[row1])
        while stop - base >= shape.span:  # a longer text goes in segments that share span - 1 units
            top = min(stop, base + SEGMENT + shape.span - 1) if row1 == row0 + 1 else stop
            gathered.append(_segment(codes[base:top], at[row0 : row1 + 1] - base, row0, shape))
            base = top - shape.span + 1 if top < stop else stop
        row0 = row1
    if not gathered:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*gathered, strict=True))


def _segment(codes: np.ndarray, at: np.ndarray, row0: int, shape: Shape) -> tuple[np.ndarray, ...]:
    n = len(codes)
    g = K.mix(K.grams(codes, shape.gram), 7)
    place = np.arange(len(g), dtype=np.uint64)
    least = K.sliding((g & ~K.U((1 << PLACE) - 1)) | place, shape.width, np.minimum) & K.U((1 << PLACE) - 1)
    least = least.astype(np.int64)
    windows = len(least)
    valid = np.ones(windows, bool)
    for edge in np.clip(at[1:-1], 0, n):  # windows over the edge of two texts are none
        valid[max(0, edge - shape.span + 1) : edge] = False
    head = valid.copy()
    head[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    edges = np.clip(at[1:-1], 0, windows - 1) if windows else at[:0]
    head[edges] |= valid[edges]
    lo = np.flatnonzero(head)
    tail = valid.copy()
    tail[:-1] &= head[1:] | ~valid[1:]
    count = np.flatnonzero(tail) - lo + 1
    anchor = least[lo]
    up, down = K._powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(K.mix(codes, 8) * up[:n], out=prefix[1:])
    end = lo + count - 1 + shape.span
    whole = K.mix((prefix[end] - prefix[lo]) * down[lo], 9)
    whole = K.mix(whole ^ (count.astype(np.uint64) << K.U(32)) ^ (anchor - lo).astype(np.uint64), 10)
    row = np.searchsorted(at, lo, "right") - 1
    return row + row0, lo - at[row], count, anchor - lo, g[anchor], whole


#: more: places (8 bytes each) of further runs of the same class in the same document.
#: spread: what rows of one task have in common. done: a row of a hot class that is a repeat for certain.
RUN = "anchor long, class long, doc_id long, place long, more binary, spread long, done boolean"
RUN_NAMES = ["anchor", "class", "doc_id", "place", "more", "spread", "done"]


@dataclass(frozen=True)
class Heat:
    """What the sample found: hot classes with the first (doc_id, place) of each in it, and anchors hot in other classes."""

    classes: np.ndarray
    docs: np.ndarray
    places: np.ndarray
    anchors: np.ndarray

    @staticmethod
    def none() -> Heat:
        z = np.zeros(0, np.int64)
        return Heat(z, z, z, z)


def packed(lo: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
    return lo << 16 | count << 8 | before


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, place >> 8 & 255, place & 255


def _emit_runs(shape: Shape, heat: Callable[[], Heat] = Heat.none) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each class of runs in a document, so that text that repeats itself is one row however long it is.

    Rows of a hot class beyond the sample's first are done; if all that occur elsewhere count, so are the others, besides
    standing for the class. Rows of a hot anchor go by class.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            _, off = K.text_buffers(texts)
            for a, b in K.slices(off):
                u = Units(texts.slice(a, b - a), shape.unit)
                row, lo, count, before, anchor, whole = runs_of(u.codes, u.at, shape)
                if not len(row):
                    continue
                place, more = packed(lo, count, before), None
                _, first, back = np.unique(K.mix(whole ^ K.mix(row.astype(np.uint64))), return_index=True, return_inverse=True)
                if len(first) < len(row):
                    order = np.argsort(back, kind="stable")
                    others = np.split(order, np.cumsum(np.bincount(back))[:-1])
                    more = pa.array([place[x[1:]].tobytes() if len(x) > 1 else None for x in others], pa.binary())
                    row, place, anchor, whole = row[first], place[first], anchor[first], whole[first]
                more = pa.nulls(len(row), pa.binary()) if more is None else more
                anchor, whole, doc = K.signed(anchor), K.signed(whole), ids[a:b][row]
                spread, done = anchor, np.zeros(len(doc), bool)
                known = heat()
                if len(known.classes):
                    at = np.minimum(np.searchsorted(known.classes, whole), len(known.classes) - 1)
                    hot = known.classes[at] == whole
                    done = hot & ((doc > known.docs[at]) | ((doc == known.docs[at]) & (place > known.places[at])))
                    again = np.flatnonzero(hot & ~done) if not shape.earlier else np.zeros(0, np.int64)
                    if len(again):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[again], whole[again], doc[again], place[again])] + [more.take(pa.array(again)), pa.array(K.signed(K.mix(doc[again].view(np.uint64)))), pa.array(np.ones(len(again), bool))], RUN_NAMES)
                    spread = np.where(done, K.signed(K.mix(doc.astype(np.int64).view(np.uint64))), anchor)
                if len(known.anchors):
                    spread = np.where(~done & np.isin(anchor, known.anchors), K.signed(K.mix(anchor.view(np.uint64) ^ whole.view(np.uint64), 15)), spread)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor, whole, doc, place)), more, pa.array(spread), pa.array(done)], RUN_NAMES)

    return scan


def _heat(runs: DataFrame, tasks: int) -> Heat:
    """The hot classes and anchors among the runs of a sample of documents."""
    c = stored(runs.groupBy("anchor", "class").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "place")).alias("first")), "sampled")
    least = max(8.0, HOT * (c.agg(F.sum("n")).first()[0] or 0) / tasks)
    classes = c.filter(F.col("n") >= least).orderBy(F.desc("n"), "class").limit(MOST_HOT).select("class", "first.doc_id", "first.place").toArrow().sort_by("class")
    rest = c.filter(F.col("n") < least).groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).filter((F.col("n") >= least) & (F.col("k") > 1))
    anchors = rest.orderBy(F.desc("n"), "anchor").limit(MOST_HOT).select("anchor").toArrow()
    return Heat(*(classes.column(x).to_numpy() for x in ("class", "doc_id", "place")), anchors.column("anchor").to_numpy())


MET = "doc_id long, place long, anchor long, sure boolean, look boolean, many boolean"
_NAMES = ["doc_id", "place", "anchor", "sure", "look", "many"]


def _met(doc: np.ndarray, place: np.ndarray, anchor: np.ndarray, sure: np.ndarray, look: np.ndarray, more: pa.Array, many: bool | np.ndarray) -> pa.RecordBatch | None:
    """The rows worth keeping, with the further runs of their documents, which are sure whatever the shape."""
    keep = np.flatnonzero(sure | look)
    again = np.flatnonzero(np.asarray(more.is_valid()))
    others = [np.frombuffer(x, np.int64) for x in more.take(pa.array(again)).to_pylist()]
    mine = np.repeat(again, [len(x) for x in others])
    rows = np.concatenate([keep, mine])
    if not len(rows):
        return None
    yes, no = np.ones(len(mine), bool), np.zeros(len(mine), bool)
    flags = [np.concatenate([sure[keep], yes]), np.concatenate([look[keep], no]), np.broadcast_to(many, len(doc))[rows]]
    return pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(np.concatenate([place[keep], *others])), pa.array(anchor[rows]), *map(pa.array, flags)], _NAMES)


def _meet(shape: Shape, heat: Callable[[], Heat] = Heat.none) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs sorted by spread, anchor, class, doc_id, place -> those of repeated anchors. Hot anchors count as having several
    classes and very many runs.

    sure: all windows of the run are repeated. look: stands for its class where the anchor has several.
    many: the anchor has more than HELD_ROWS runs; of it only the last row and the first are remembered
    between parts, since a row's flags depend on its neighbours alone (and for the very first, on whether
    any other class follows).
    """

    def whole(table: pa.Table) -> pa.RecordBatch | None:
        anchor, kind = table.column("anchor").to_numpy(), table.column("class").to_numpy()
        head = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        first = head | np.concatenate([[True], kind[1:] != kind[:-1]])
        group, cls = np.cumsum(head) - 1, np.cumsum(first) - 1
        more = table.column("more").combine_chunks()
        weight = 1 + np.asarray(more.is_valid()).astype(np.int64)
        per_class = np.bincount(cls, weights=weight)[cls]
        several = np.bincount(group[first], minlength=group[-1] + 1)[group] > 1
        sure = ~first if shape.earlier else per_class > 1
        hot = heat().anchors
        many = bool(len(hot)) and np.isin(anchor, hot)
        several |= many
        return _met(table.column("doc_id").to_numpy(), table.column("place").to_numpy(), anchor, sure, first & several, more, many)

    def parted(batches: Iterator[pa.RecordBatch], ready: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = batch.column(6).to_numpy(zero_copy_only=False).astype(bool)
            if done.any():
                rows = batch.filter(pa.array(done))
                yes = np.ones(rows.num_rows, bool)
                out = _met(rows.column(2).to_numpy(), rows.column(3).to_numpy(), rows.column(0).to_numpy(), yes, ~yes, rows.column(4), False)
                if out is not None:
                    ready.append(out)
                batch = batch.filter(pa.array(~done))
            yield batch

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, before, last = None, None, None  # first row of the first class; class before `last`; the row held back
        ready: list[pa.RecordBatch] = []
        for table, part in bounded_groups(parted(batches, ready), "spread", HELD_ROWS):
            yield from ready
            ready.clear()
            if part == "whole":
                out = whole(table)
            else:
                rows = pa.concat_tables([t for t in (last, table) if t is not None])
                kind = rows.column("class").to_numpy()
                first = np.concatenate([[before is None or kind[0] != before], kind[1:] != kind[:-1]])
                ends = np.concatenate([kind[1:] != kind[:-1], [True]])
                n = len(kind) if part == "end" else len(kind) - 1  # the last row waits for the next
                more = rows.column("more").combine_chunks()
                twice = np.asarray(more.is_valid())
                sure = ~first if shape.earlier else ~(first & ends) | twice
                look = first.copy()
                if before is None and rows.column("anchor")[0].as_py() not in heat().anchors:
                    opening, look[0] = rows.slice(0, 1), False
                elif opening is not None and first[:n].any():
                    yield pa.RecordBatch.from_arrays([*(pa.array(opening.column(c).to_numpy()) for c in ("doc_id", "place", "anchor")), *(pa.array([x]) for x in (False, True, True))], _NAMES)
                    opening = None
                if before is None and first[1:n].any():
                    look[0], opening = True, None
                out = _met(rows.column("doc_id").to_numpy()[:n], rows.column("place").to_numpy()[:n], rows.column("anchor").to_numpy()[:n], sure[:n], look[:n], more.slice(0, n), True)
                before = kind[n - 1] if n else before
                last = rows.slice(n)
                if part == "end":
                    opening, before, last = None, None, None
            if out is not None:
                yield out
        yield from ready

    return meet


#: units: of a run to look at. second: instead of units, for a single window, whose hashes are anchor and second.
LOOKED = "anchor long, second long, doc_id long, place long, sure boolean, units binary"
LOOKED_NAMES = ["anchor", "second", "doc_id", "place", "sure", "units"]


#: open: the first of its window in its part, still to be settled. twice: its part has others.
WINDOW = "doc_id long, lo long, n long, anchor long, second long, place long, open boolean, twice boolean"


def _window_parts(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Single windows of one part, sorted by their two hashes, doc_id and place -> the repeats, and the first of each, open."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        for batch in chain(batches, [None]):
            rows = pa.Table.from_batches([x for x in (held, batch) if x is not None]) if held is not None or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            key = np.stack([rows.column(c).to_numpy() for c in ("anchor", "second")], axis=1)
            change = (key[1:] != key[:-1]).any(axis=1)
            first = np.concatenate([[before is None or (key[0] != before).any()], change])
            alone = first & np.concatenate([change, [True]])
            n = len(key) if batch is None else len(key) - 1
            if n:
                before = key[n - 1]
                place = rows.column("place").to_numpy()[:n]
                yield pa.RecordBatch.from_arrays([pa.array(rows.column("doc_id").to_numpy()[:n]), pa.array(unpacked(place)[0]), pa.array(np.ones(n, np.int64)), pa.array(key[:n, 0].copy()), pa.array(key[:n, 1].copy()), pa.array(place), pa.array(first[:n]), pa.array((first & ~alone)[:n])], ["doc_id", "lo", "n", "anchor", "second", "place", "open", "twice"])
            held = rows.slice(n).combine_chunks().to_batches()[0] if n < len(key) else None

    return look


def _same_windows(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Single windows sorted by their two hashes, doc_id and place -> the repeated ones. One row is held back between batches."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        for batch in chain(batches, [None]):
            rows = pa.Table.from_batches([x for x in (held, batch) if x is not None]) if held is not None or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            key = np.stack([rows.column(c).to_numpy() for c in ("anchor", "second")], axis=1)
            change = (key[1:] != key[:-1]).any(axis=1)
            first = np.concatenate([[before is None or (key[0] != before).any()], change])
            alone = first & np.concatenate([change, [True]])
            n = len(key) if batch is None else len(key) - 1
            pick = np.flatnonzero((~first if shape.earlier else ~alone)[:n])
            if n:
                before = key[n - 1]
            held = rows.slice(n).combine_chunks().to_batches()[0] if n < len(key) else None
            if len(pick):
                lo, _, _ = unpacked(rows.column("place").to_numpy()[pick])
                yield pa.RecordBatch.from_arrays([pa.array(rows.column("doc_id").to_numpy()[pick]), pa.array(lo), pa.array(np.ones(len(pick), np.int64))], ["doc_id", "lo", "n"])

    return look


def _fetch(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text, looks) -> the units of each run to look at (bytes, or the 8-byte codes of words), or the hashes of its windows."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = K.text_buffers(batch.column(1))
            for a, b in K.slices(off):
                part = batch.slice(a, b - a)
                u = Units(part.column(1), shape.unit)
                size = np.asarray(part.column(2).value_lengths())
                looks = part.column(2).flatten()
                row = np.repeat(np.arange(b - a), size)
                place, anchor, sure, many = (looks.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                doc, many = part.column(0).to_numpy(), many.astype(bool)
                lo, count, before = unpacked(place)
                start, length = u.at[row] + lo, count - 1 + shape.span

                def gathered(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    off = np.concatenate([[0], np.cumsum(length)])
                    return off, np.repeat(start - off[:-1], length) + np.arange(off[-1])

                few = np.flatnonzero(~many)
                if len(few):
                    out_off, where = gathered(start[few], length[few])
                    flat, scale = (u.data[where], 1) if shape.unit == "byte" else (u.codes[where].view(np.uint8), 8)
                    units = pa.Array.from_buffers(pa.binary(), len(few), [None, pa.py_buffer((out_off * scale).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[few]), pa.nulls(len(few), pa.int64()), pa.array(doc[row[few]]), pa.array(place[few]), pa.array(sure[few]), units], LOOKED_NAMES)
                lot = np.flatnonzero(many)
                if len(lot):
                    _, window = gathered(start[lot], count[lot])
                    own = np.repeat(lot, count[lot])
                    one, two = K.grams(u.codes, shape.span), K.grams(K.mix(u.codes, 12), shape.span, K.WORD_MULT)
                    keys = [pa.array(K.signed(K.mix(x[window], seed))) for seed, x in ((13, one), (14, two))]
                    single = packed(window - u.at[row[own]], np.ones(len(own), np.int64), before[own] - (window - start[own]))
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(doc[row[own]]), pa.array(single), pa.array(sure[own]), pa.nulls(len(own), pa.binary())], LOOKED_NAMES)

    return fetch


def matrices(table: pa.Table, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units from the anchor on, units before it (nearest first), and how many of each there are.

    Missing units are 0 and present ones are not, so a shorter row sorts before its extensions.
    """
    place = table.column("place").to_numpy()
    _, count, before = unpacked(place)
    col = table.column("units").combine_chunks()
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_binary())
    raw = np.frombuffer(col.buffers()[2], np.uint8) if len(col) else np.zeros(0, np.uint8)
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    if shape.unit == "byte":
        units = raw + np.uint8(1)
    else:
        units, off = raw.view(np.uint64), off // 8
        units = np.where(units == 0, K.U(1), units)
    after = count - 1 + shape.span - before

    def rows(start: np.ndarray, step: int, have: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(start), width), units.dtype)
        for j in range(width):
            ok = have > j
            out[ok, j] = units[start[ok] + step * j]
        return out

    anchor_at = off[:-1] + before
    return rows(anchor_at, 1, np.minimum(after, shape.span), shape.span), np.minimum(after, shape.span), rows(anchor_at - 1, -1, before, shape.width - 1), before


SPANS = "doc_id long, lo long, n long"


def repeated_windows(docs: DataFrame, shape: Shape, looker: Callable[[Shape], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """(doc_id, text, repeats, copy, spans): every document with a non-null id, none twice, whether its whole text occurs
    more than once, whether it is a later copy of such a text (then it has no spans of its own), and the
    repeated windows as array<struct<lo, n>>: n windows that start at unit lo and after.

    docs: (doc_id, text). looker: turns rows of LOOKED, sorted by anchor, into (doc_id, lo, n).
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    digest = stored(texts.select("doc_id", F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)).alias("d"), F.xxhash64("text").alias("x")), "digests")
    first = digest.groupBy("d", "x").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    settled = lookup(digest, stored(first, "copies"), ["d", "x"], "copies").groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("first")).alias("copy"))
    settled = stored(settled, "settled")
    own = texts.join(settled.filter("copy").hint("merge"), "doc_id", "left_anti").select("doc_id", "text")
    few = settled.filter("copy").select("doc_id").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    some = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    copies = settled.filter("copy").select("doc_id")
    some = some.join(F.broadcast(copies) if few else copies.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), "doc_id", "left_anti").select("doc_id", "text")
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(_heat(some.mapInArrow(K.tidy(_emit_runs(shape)), RUN), parts(spark)))
    known = lambda: table.value
    # One plan from here, so that the three joins by id read one exchange of the texts.
    runs = own.mapInArrow(K.tidy(_emit_runs(shape, known)), RUN)
    met = dealt(runs, "spread", "anchor", "class", "doc_id", "place").mapInArrow(K.tidy(_meet(shape, known)), MET)
    looks = met.filter("look").groupBy("doc_id").agg(F.collect_list(F.struct("place", "anchor", "sure", "many")).alias("looks"))
    fetched = texts.join(looks.hint("merge"), "doc_id").select("doc_id", "text", "looks").mapInArrow(K.tidy(_fetch(shape)), LOOKED)
    found = dealt(fetched.filter("units IS NOT NULL"), "anchor", "doc_id", "place").mapInArrow(K.tidy(looker(shape)), SPANS)
    single = fetched.filter("units IS NULL").select("anchor", "second", "doc_id", "place", F.xxhash64("anchor", "second", F.pmod("doc_id", F.lit(SALTS))).alias("part"))
    ordered = dealt(single, "part", "anchor", "second", "doc_id", "place").select("anchor", "second", "doc_id", "place")
    windows = ordered.mapInArrow(K.tidy(_window_parts(shape)), WINDOW)
    firsts = dealt(windows.filter("open").select("anchor", "second", "doc_id", "place"), "anchor", "second", "doc_id", "place").mapInArrow(K.tidy(_same_windows(shape)), SPANS)
    again = windows.filter("NOT open" if shape.earlier else "NOT open OR twice").select("doc_id", "lo", "n")
    same = firsts.unionByName(again)
    sure = met.filter("sure").select("doc_id", F.shiftright("place", 16).alias("lo"), F.shiftright("place", 8).bitwiseAND(F.lit(255)).alias("n"))
    spans = found.unionByName(same).unionByName(sure).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    marks = spans.join(settled, "doc_id", "full").select("doc_id", "copy", "spans")
    return texts.join(marks.hint("merge"), "doc_id", "left").select("doc_id", "text", F.col("copy").isNotNull().alias("repeats"), F.coalesce("copy", F.lit(False)).alias("copy"), "spans")


def with_own_ids(base: DataFrame) -> DataFrame | None:
    """(doc_id, given, text) with ids of their own in order of (given id, row), if rows of base repeat an id; else None.

    Only numbers move to find the order; texts move once, to be written with their new ids.
    """
    again = base.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not again.limit(1).count():
        return None
    rows = numbered(base)
    ranks = running(rows.filter("doc_id IS NOT NULL").select("doc_id", ROW, F.lit(1).cast("long").alias("one")), [], ["doc_id", ROW], "one", "own").select(ROW, "own")
    few = ranks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return stored(rows.join(F.broadcast(ranks) if few else ranks.hint("merge"), ROW, "left").select(F.col("own").alias("doc_id"), F.col("doc_id").alias("given"), "text"), "own-ids")


def by_row(base: DataFrame, dedup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """dedup of base (doc_id, text), which asks for ids that tell rows apart, with the ids of base."""
    keyed = with_own_ids(base)
    if keyed is None:
        return dedup(base)
    done = dedup(keyed.select("doc_id", "text"))
    named = done.join(keyed.filter("doc_id IS NOT NULL").select("doc_id", "given").hint("merge"), "doc_id", "left")
    return named.select(F.col("given").alias("doc_id"), *done.columns[1:])


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text), without a projection where the columns are so already: reads of equal plans share an exchange."""
    kinds = dict(docs.dtypes)
    ident = F.col(id_col) if kinds[id_col] == "bigint" else F.col(id_col).cast("long")
    return docs.select(ident if (id_col, kinds[id_col]) == ("doc_id", "bigint") else ident.alias("doc_id"), F.col(text_col) if text_col == "text" else F.col(text_col).alias("text"))


def removed_units(spans: pa.ListArray, at: np.ndarray, span: int) -> np.ndarray:
    """For the units of texts laid end to end (offsets at), whether any repeated window covers them."""
    size = np.asarray(spans.fill_null([]).value_lengths()) if spans.null_count else np.asarray(spans.value_lengths())
    flat = spans.flatten()
    lo, n = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    start = at[:-1][np.repeat(np.arange(len(size)), size)] + lo
    return K.cover(start, start + n - 1 + span, int(at[-1]))

