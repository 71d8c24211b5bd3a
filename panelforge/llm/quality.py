"""Ordinal quality classifier: a cumulative-link model on hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import kernels as K
from panelforge.llm.storage import called, plain, small_batches

BITS = 18
SAMPLE_ROWS = 16_000
GRADES = 3
#: How much more a rated text of a rare grade may weigh than one of the commonest.
MOST_WEIGHT = 4.0
#: Standard errors that a feature's presence must differ by across some grade boundary, to choose from by held-out likelihood.
EVIDENCE = (3.0, 4.0, 6.0, 9.0, 13.0)
#: Shares of a text's bytes or words that are cut into tenths and hashed like words.
STEMS = (4, 5)
#: Features of rated texts that a step of the fit takes at a time (or one text's): what it holds besides the lists is of this length.
SLICE = 1 << 16
SHAPES = ("upper", "digit", "symbol", "space", "repeat", "adjacent")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text: ids and n+1 offsets. From whole texts, case-folded words and shape tenths."""
    data, off = K.text_buffers(texts)
    _, _, h, at = K.words(data, off, K.BLANK_WORD, lower=True)
    starts, ends, plain, plain_at = K.words(data, off, K.ALNUM_WORD, lower=True)
    n = len(off) - 1
    row, row2 = K.row_of(at), K.row_of(plain_at)
    size = np.maximum(np.diff(off), 1)
    share = lambda lo, hi: np.diff(np.concatenate([[0], np.cumsum((data >= lo) & (data <= hi))])[off]) / size
    upper, digit, space = share(65, 90), share(48, 57), share(9, 13) + share(32, 32)
    symbol = share(33, 43) + share(58, 64) + share(91, 96) + share(123, 126)
    count = np.maximum(np.diff(at), 1)
    key = np.unique((row.astype(np.uint64) << K.U(44)) | (h >> K.U(20)))
    distinct = np.bincount((key >> K.U(44)).astype(np.int64), minlength=n) / count
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    adjacent = np.bincount(row[same], minlength=n) / count
    shape = np.stack([upper, digit, symbol, space, 1 - distinct, adjacent])
    level = np.minimum((shape * 20).astype(np.uint64), K.U(20))
    shape_h = K.mix(level + (np.arange(len(SHAPES), dtype=np.uint64) * K.U(64))[:, None], 5)
    mask = K.U((1 << BITS) - 1)
    stems = [K.word_prefixes(data, starts, ends, k, k) for k in STEMS]
    every = np.concatenate([*((row2.astype(np.uint64) << K.U(32)) | (x & mask) for x in (plain, *stems)), (np.tile(np.arange(n, dtype=np.uint64), len(SHAPES)) << K.U(32)) | (shape_h & mask).ravel()])
    every = np.unique(every)
    return (every & mask).astype(np.int32), np.searchsorted(every, np.arange(n + 1, dtype=np.uint64) << K.U(32)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(threshold[k] - score), with one weight vector for all grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        out, done = np.zeros(len(off) - 1), 0.0
        for a, b in K.slices(off, SLICE):
            total = np.cumsum(np.concatenate([[done], self.weights[ids[off[a] : off[b]]]]), dtype=np.float64)  # a score does not depend on the batch
            at = off[a : b + 1] - off[a]
            out[a:b], done = total[at[1:]] - total[at[:-1]], total[-1]
        return out

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        below = np.concatenate([np.zeros((len(score), 1)), _sigmoid(self.thresholds[None, :] - score[:, None]), np.ones((len(score), 1))], axis=1)
        return np.diff(below, axis=1)


def presence(ids: np.ndarray, off: np.ndarray, grade: np.ndarray, grades: int) -> np.ndarray:
    """For each grade and feature the rows of that grade that have it; rows of a grade below 0 are passed over."""
    out = np.zeros((grades, 1 << BITS), np.int64)
    for a, b in K.slices(off, SLICE):
        x, g = ids[off[a] : off[b]], np.repeat(grade[a:b], np.diff(off[a : b + 1]))
        for k in range(grades):
            np.add.at(out[k], x[g == k].astype(np.intp), 1)
    return out


def evidence(present: np.ndarray, have: np.ndarray) -> np.ndarray:
    """For each feature the largest |z| over the grade boundaries of its presence above against below the boundary. have: rows by grade."""
    n, df = have.sum(), present.sum(axis=0)
    out = np.zeros(1 << BITS)
    for k in range(1, len(have)):
        share = have[k:].sum() / n
        hits = present[k:].sum(axis=0)
        spread = df * share * (1 - share) * (1 - df / n)
        out = np.maximum(out, np.abs(hits - df * share) / np.sqrt(spread + 1.0))
    return out


def _narrowed(ids: np.ndarray, off: np.ndarray, rows: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature lists of the picked rows, without features other than kept, as places in kept."""
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    kind = np.min_scalar_type(max(len(kept) - 1, 0))
    parts, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for a, b in K.slices(off, SLICE):
        row = np.repeat(np.arange(b - a), np.diff(off[a : b + 1]))
        x = place[ids[off[a] : off[b]]]
        hit = (x >= 0) & rows[a:b][row]
        parts.append(x[hit].astype(kind))
        sizes.append(np.bincount(row[hit], minlength=b - a)[rows[a:b]])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def fit(ids: np.ndarray, off: np.ndarray, grade: np.ndarray, grades: int = GRADES, rounds: int = 400, rate: float = 0.05, ridge: float = 3e-4, least_z: float | None = None, most_weight: float = MOST_WEIGHT, rows: np.ndarray | None = None) -> OrdinalModel:
    """Maximum likelihood by Adam over all rows each round; thresholds stay ordered as sums of positive gaps.

    A feature takes part if its presence differs across some grade boundary by least_z standard errors or
    more, so that words seen by chance in a few rated texts get no weight; where that is not given, it is
    what makes every third rated text likeliest when the others are learnt from (held_out_evidence).
    Grades weigh alike in sum, up to a factor of most_weight against the commonest. Grades may be absent.
    rows: a mask of the rows to learn from, all where not given. A round takes a slice of the lists at a time, so that besides ids
    only the places of the features that take part are held.
    """
    least_z = held_out_evidence(ids, off, grade, grades, rate, ridge, most_weight) if least_z is None else least_z
    rows = np.ones(len(grade), bool) if rows is None else rows
    have = np.bincount(grade[rows], minlength=grades)
    present = presence(ids, off, np.where(rows, grade, -1), grades)
    kept = np.flatnonzero((evidence(present, have) >= least_z) & present.any(axis=0))
    del present
    at, off = _narrowed(ids, off, rows, kept)
    grade = grade[rows]
    weight = np.minimum(have.max() / np.maximum(have, 1), most_weight)[grade]
    weight = weight / weight.sum()
    dhi, dlo, p = np.zeros(len(grade)), np.zeros(len(grade)), np.zeros(len(grade))
    w = np.zeros(len(kept))
    free = np.concatenate([[-1.0], np.zeros(grades - 2)])
    m, v = np.zeros(len(w) + len(free)), np.zeros(len(w) + len(free))
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        grad_w = np.zeros(len(w))
        for a, b in K.slices(off, SLICE):
            x, size, g = at[off[a] : off[b]].astype(np.intp), np.diff(off[a : b + 1]), grade[a:b]
            s = np.bincount(np.repeat(np.arange(b - a), size), weights=w[x], minlength=b - a)
            hi, lo = _sigmoid(edge[g + 1] - s), _sigmoid(edge[g] - s)
            p[a:b] = np.maximum(hi - lo, 1e-12)
            dhi[a:b], dlo[a:b] = hi * (1 - hi), lo * (1 - lo)
            np.add.at(grad_w, x, np.repeat(weight[a:b] * (dhi[a:b] - dlo[a:b]) / p[a:b], size))
        grad_w += ridge * w
        at_theta = np.zeros(grades + 1)
        np.add.at(at_theta, grade + 1, -weight * dhi / p)
        np.add.at(at_theta, grade, weight * dlo / p)
        tail = np.cumsum(at_theta[1:-1][::-1])[::-1]
        g = np.concatenate([grad_w, tail[:1], tail[1:] * np.exp(free[1:])])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[: len(w)]
        free = free - step[len(w) :]
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    return OrdinalModel(weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def _rows(ids: np.ndarray, off: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature lists of the picked rows."""
    return ids[np.repeat(pick, np.diff(off))], np.concatenate([[0], np.cumsum(np.diff(off)[pick])])


def held_out_evidence(ids: np.ndarray, off: np.ndarray, grade: np.ndarray, grades: int, rate: float, ridge: float, most_weight: float) -> float:
    """Of EVIDENCE, the one whose fit to two thirds of the rows gives the others the greatest mean log likelihood; of equals the largest."""
    test = np.arange(len(grade)) % 3 == 0
    if test.all():
        return EVIDENCE[0]
    rest = _rows(ids, off, test)

    def held_out(z: float) -> float:
        model = fit(ids, off, grade, grades, 150, rate, ridge, z, most_weight, ~test)
        p = model.probabilities(model.score(*rest))
        return round(float(np.log(np.maximum(p[np.arange(len(p)), grade[test]], 1e-9)).mean()), 9)

    return max(reversed(EVIDENCE), key=held_out)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor, 1 well written but toxic, 2 well written and harmless. Rows without a quality are left out; no toxicity mark counts as harmless."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") < 1, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most sample_rows rated documents, those of the smallest id hashes: the one bounded sample here.

    ratings: (doc_id, grade), one row per document; of several the lowest grade counts. Without rated documents every grade comes
    out alike and nothing is rejected.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = ratings.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rated = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = K.text_buffers(batch.column(1))
            for a, b in K.slices(off):
                ids, at = features(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "grade", "ids"])

    batches = rated.mapInArrow(K.tidy(extract), "doc_id long, grade int, ids array<int>").toArrow().to_batches()
    model = _fit_batches(batches)
    K.give_back()
    return model


def _fit_batches(batches: list[pa.RecordBatch]) -> OrdinalModel:
    """The fit to batches of (doc_id, grade, ids) in order of doc_id. The list is emptied: a batch goes once its features are in place."""
    if not sum(b.num_rows for b in batches):
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, -40.0))
    order = np.argsort(np.concatenate([b.column(0).to_numpy() for b in batches]), kind="stable")
    grade = np.concatenate([b.column(1).to_numpy() for b in batches])[order].astype(np.int64)
    off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in batches])[order])])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids, done = np.empty(off[-1], np.int32), len(order)
    while batches:
        lists = batches.pop().column(2)
        done, at, values = done - len(lists), lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, row in enumerate(place[done : done + len(lists)]):
            ids[off[row] : off[row + 1]] = values[at[i] : at[i + 1]]
        del lists, at, values
    K.give_back()
    return fit(ids, off, grade)


def selected(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that grade() selects, all columns as they are, whatever their names."""
    rows = plain(docs)
    return grade(rows, model, text_col=called(docs, text_col), least=least).filter("_selected").select(*rows.columns).toDF(*docs.columns)


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs, all columns as they are, with _grade (expected), _tail (probability of the top grade) and _selected.

    A null or empty text has shape features only. Every row comes back; columns of these three names in the
    input are replaced.
    """
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("_grade", "_tail", "_selected")]
    base = docs.select(*names)
    schema = T.StructType([*base.schema.fields, T.StructField("_grade", T.DoubleType()), T.StructField("_tail", T.DoubleType()), T.StructField("_selected", T.BooleanType())])
    column = names.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = K.text_buffers(batch.column(column))
            for a, b in K.slices(off):
                part = batch.slice(a, b - a)
                p = table.value.probabilities(table.value.score(*features(part.column(column))))
                tail = p[:, -1]
                more = [pa.array(p @ np.arange(p.shape[1])), pa.array(tail), pa.array(tail >= least)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema.names)

    return base.mapInArrow(K.tidy(scan), schema)
