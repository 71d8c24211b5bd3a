"""Ranked lexical search: trees of maxima over document ranges, one a term, searched best first for every query text."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm import kernels as K
from panelforge.llm.storage import ROW, numbered, small_batches, stored

#: A shard is a range of documents with its postings: no more documents and hardly more postings than these.
SHARD_DOCS, SHARD_POSTINGS = 4096, 2_000_000
#: Children of a tree node.
FAN = 32
#: Query texts are taken in blocks of about so many bytes; what a block broadcasts is bounded by them.
BLOCK_BYTES = 4 << 20
#: Texts are cut into words piece by piece.
PIECE = 1 << 20
#: A-Z lower-cased; what is neither a letter, a digit nor outside ASCII becomes a blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a list for each piece of it."""
    raw, at = raw.translate(FOLDED), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE) if at + PIECE < len(raw) else len(raw)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


@dataclass(frozen=True)
class Queries:
    """Query texts as vocabulary numbers: item i has terms[at[i]:at[i+1]], each once, times[...] often."""

    vocabulary: dict[bytes, int]
    at: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        at, terms, times = [0], [], []
        for text in texts:
            own = [vocabulary.setdefault(w, len(vocabulary)) for words in terms_of((text or "").encode()) for w in words]
            t, n = np.unique(np.array(own, np.int64), return_counts=True)
            terms.append(t)
            times.append(n)
            at.append(at[-1] + len(t))
        return Queries(vocabulary, np.array(at), np.concatenate([np.zeros(0, np.int64), *terms]), np.concatenate([np.zeros(0, np.int64), *times]))


@dataclass(frozen=True)
class Stats:
    """Documents with a term, terms of all, and each vocabulary term's weight."""

    docs: int
    length: int
    weights: np.ndarray

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents of n terms, in whole numbers of any size."""
        known, back = np.unique(n, return_inverse=True)
        return np.array([25 + 75 * int(x) * self.docs // self.length for x in known], np.int64)[back]


SHARD = "shard long, ids array<long>, n_docs long, n_terms long, lens binary, terms binary, starts binary, place binary, tf binary"


def _sharded(vocabulary: Callable[[], dict[bytes, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) -> shards: the documents with terms, and the postings of the vocabulary by term and document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, nth, held, first = vocabulary(), 0, 0, TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        lens: list[int] = []
        terms: list[np.ndarray] = []
        tf: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            size = [len(t) for t in terms]
            term, count, place = np.concatenate(terms), np.concatenate(tf), np.repeat(np.arange(len(ids)), size)
            order = np.argsort(term, kind="stable")
            kinds, starts = np.unique(term[order], return_index=True)
            n = np.array(lens, np.int64)
            raw = [n.tobytes(), kinds.astype(np.int32).tobytes(), np.append(starts, len(term)).astype(np.int64).tobytes(), place[order].astype(np.int32).tobytes(), count[order].astype(np.int64).tobytes()]
            columns = [pa.array([first | nth]), pa.array([ids], pa.list_(pa.int64())), pa.array([len(ids)]), pa.array([int(n.sum())]), *(pa.array([x], pa.binary()) for x in raw)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "ids", "n_docs", "n_terms", "lens", "terms", "starts", "place", "tf"])

        for batch in batches:
            data, off = K.text_buffers(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                n, found = 0, []
                for words in terms_of(data[a:b].tobytes()):
                    n += len(words)
                    found += [t for t in map(known.get, words) if t is not None]
                if not n:
                    continue
                t, c = np.unique(np.array(found, np.int64), return_counts=True)
                ids.append(doc)
                lens.append(n)
                terms.append(t)
                tf.append(c)
                held += len(t)
                if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                    yield shard()
                    nth, held = nth + 1, 0
                    ids, lens, terms, tf = [], [], [], []
        if ids:
            yield shard()

    return scan


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(terms, starts) -> (term, df): how many of a task's documents hold each term."""
    total: dict[int, int] = {}
    for batch in batches:
        for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for t, n in zip(np.frombuffer(terms, np.int32).tolist(), np.diff(np.frombuffer(starts, np.int64)).tolist(), strict=True):
                total[t] = total.get(t, 0) + n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "df"])


class Trees:
    """One tree of maxima for each term over a shard's documents, all in the same arrays.

    Level 0 holds postings: documents and what the term adds to their scores. A node of level l + 1 covers FAN
    neighbouring nodes of level l and holds their maximum; its children lie side by side from start on. Nodes are kept
    only where a term occurs. The last level has one node a term.
    """

    def __init__(self, row: dict, stats: Stats) -> None:
        self.ids = row["ids"]
        terms, starts = np.frombuffer(row["terms"], np.int32).astype(np.int64), np.frombuffer(row["starts"], np.int64)
        place, tf = np.frombuffer(row["place"], np.int32).astype(np.int64), np.frombuffer(row["tf"], np.int64)
        m = stats.lengths(np.frombuffer(row["lens"], np.int64))
        own = np.repeat(terms, np.diff(starts))
        value = stats.weights[own] * (1_000_000_000 * tf // (1000 * tf + 8 * m[place]))
        keep = value > 0
        own, block, value = own[keep], place[keep], value[keep]
        self.levels = [(block, value, np.zeros(0, np.int64))]
        width = len(self.ids)
        while len(self.levels) == 1 or width > 1:
            up = block // FAN
            head = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (up[1:] != up[:-1])])) if len(own) else np.zeros(0, np.int64)
            value = np.maximum.reduceat(value, head) if len(head) else value
            self.levels.append((up[head], value, np.append(head, len(own))))
            own, block, width = own[head], up[head], -(-width // FAN)
        self.terms = own

    def roots(self, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query term's root (-1: none) and what it adds to its item's bound; each item's bound."""
        root = np.minimum(np.searchsorted(self.terms, q.terms), max(len(self.terms) - 1, 0))
        there = self.terms[root] == q.terms if len(self.terms) else np.zeros(len(q.terms), bool)
        most = np.where(there, self.levels[-1][1][root] * q.times if len(self.terms) else 0, 0)
        total = np.concatenate([[0], np.cumsum(most)])
        return np.where(there, root, -1), most, total[q.at[1:]] - total[q.at[:-1]]

    def best(self, root: np.ndarray, times: np.ndarray, bound: int, least: int, k: int) -> list[tuple[int, int | None]]:
        """(score, doc_id) of the k best documents with score `least` or more, by branch and bound from these roots.

        The open node of highest bound is opened first, together with the next of its level, twice as many each time. A
        node is left alone only if its bound is below the k-th score found: one of equal bound may hold a smaller id.
        """
        top: list[tuple[int, bool, int]] = []  # (score, no id, id), best first
        floor, width, nth = max(least, 1), 1, 0
        level = len(self.levels) - 1
        heap = [(-bound, nth, level, root, times)]
        while heap and -heap[0][0] >= floor:
            opened = [heapq.heappop(heap)]
            level = opened[0][2]
            while heap and len(opened) < width and heap[0][2] == level and -heap[0][0] >= floor:
                opened.append(heapq.heappop(heap))
            width *= 2
            node, often = (np.concatenate([x[i] for x in opened]) for i in (3, 4))
            start = self.levels[level][2]
            size = start[node + 1] - start[node]
            child = np.repeat(start[node] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            often = np.repeat(often, size)
            block, value, _ = self.levels[level - 1]
            order = np.argsort(block[child], kind="stable")
            child, often = child[order], often[order]
            at = block[child]
            head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            total = np.add.reduceat(value[child] * often, head)
            good = np.flatnonzero(total >= floor)
            if level > 1:
                ends = np.append(head[1:], len(child))
                for i in good.tolist():
                    nth += 1
                    heapq.heappush(heap, (-int(total[i]), nth, level - 1, child[head[i] : ends[i]], often[head[i] : ends[i]]))
            elif len(good):
                if len(good) > 4 * k:
                    good = good[total[good] >= np.partition(total[good], -k)[-k]]
                ids = [self.ids[i] for i in at[head[good]].tolist()]
                top += [(s, i is None, i or 0) for s, i in zip(total[good].tolist(), ids, strict=True)]
                top = sorted(top, key=lambda x: (-x[0], x[1:]))[:k]
                floor = max(floor, top[-1][0]) if len(top) == k else floor
        return [(s, None if none else i) for s, none, i in top]


FOUND = "item int, doc_id long, score long"


def _bounds(q: Callable[[], Queries], stats: Callable[[], Stats]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shards -> (item, shard, bound) where an item may score at all."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, bound = Trees(row, stats()).roots(q())
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), row["shard"])), pa.array(bound[some])], ["item", "shard", "bound"])

    return scan


def _searched(q: Callable[[], Queries], stats: Callable[[], Stats], wanted: Callable[[], tuple[np.ndarray, np.ndarray, bool]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shards -> each item's best in them. wanted: every item's best shard, least score, and whether that shard or all others are searched."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, least, inside = wanted()
        for batch in batches:
            for row in batch.to_pylist():
                trees = Trees(row, stats())
                root, _, bound = trees.roots(q())
                items, ids, scores = [], [], []
                for i in np.flatnonzero((bound >= np.maximum(least, 1)) & ((first == row["shard"]) == inside)).tolist():
                    mine = slice(q().at[i], q().at[i + 1])
                    there = root[mine] >= 0
                    for score, doc in trees.best(root[mine][there], q().times[mine][there], int(bound[i]), int(least[i]), k):
                        items.append(i)
                        ids.append(doc)
                        scores.append(score)
                if items:
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return scan


def _best(found: DataFrame, k: int) -> DataFrame:
    """rank added; of each item the k best. Tasks keep k rows an item before any moves."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame:
    """(item, rank, doc_id, score) of a block of query texts, numbered as in the list."""
    spark = docs.sparkSession
    queries = spark.sparkContext.broadcast(Queries.of(texts))
    q = lambda: queries.value
    shards = stored(docs.mapInArrow(K.tidy(_sharded(lambda: queries.value.vocabulary)), SHARD), "shards")
    total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    counts = shards.select("terms", "starts").mapInArrow(K.tidy(_document_counts), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    weights = np.zeros(len(queries.value.vocabulary), np.int64)
    for t, df in zip(counts.column("term").to_pylist(), counts.column("df").to_pylist(), strict=True):
        weights[t] = math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df + 1)))
    known = spark.sparkContext.broadcast(Stats(total[0] or 0, total[1] or 0, weights))
    stats = lambda: known.value
    bounds = shards.mapInArrow(K.tidy(_bounds(q, stats)), "item int, shard long, bound long")
    leading = bounds.groupBy("item").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("shard")).toArrow()
    first, least = np.full(len(texts), -1, np.int64), np.zeros(len(texts), np.int64)
    first[leading.column("item").to_numpy()] = leading.column("shard").to_numpy()
    near = spark.sparkContext.broadcast((first, least, True))
    ahead = leading.select(["shard"])
    some = shards.join(F.broadcast(spark.createDataFrame(ahead.group_by("shard").aggregate([]))), "shard", "left_semi") if ahead.num_rows else shards.limit(0)
    seed = stored(_best(some.mapInArrow(K.tidy(_searched(q, stats, lambda: near.value, k)), FOUND), k), "leading")
    last = seed.filter(F.col("rank") == k).select("item", "score").toArrow()
    least = least.copy()
    least[last.column("item").to_numpy()] = last.column("score").to_numpy()
    far = spark.sparkContext.broadcast((first, least, False))
    rest = shards.mapInArrow(K.tidy(_searched(q, stats, lambda: far.value, k)), FOUND)
    return _best(seed.drop("rank").unionByName(rest), k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by doc_id, null last.

    Terms are runs of digits, letters a-z and non-ASCII characters after lower-casing A-Z. N documents have a term, L is
    the number of all their terms, n that of one document's; df documents hold a term, tf is its count in one. A term
    weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 25 + 75 n N div L, its score the sum of
    w (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included.

    Documents become shards where they lie. A first pass bounds every item in every shard by the roots of its terms'
    trees; the shard of highest bound is searched first, and its k-th score is the least that the others must reach.
    Every row of docs and of items counts for itself, repeated ids too. Null and empty texts have no terms: such documents
    are not counted and such items return nothing. Empty tables give no rows; other columns are not read. Items are
    taken in blocks of block_bytes of text, each a pass over the documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = stored(numbered(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))), "items")
    size = named.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = named.withColumn("block", F.pmod(F.xxhash64(ROW), F.lit(blocks)))
    done = []
    for b in range(blocks):
        mine = dealt.filter(F.col("block") == b).select(ROW, "text").toArrow()
        if mine.num_rows:
            places = spark.createDataFrame(pa.table({ROW: mine.column(ROW), "item": pa.array(range(mine.num_rows), pa.int32())}))
            found = _block(base, mine.column("text").to_pylist(), k)
            done.append(found.join(F.broadcast(places), "item").select(ROW, "rank", "doc_id", "score"))
    if not done:
        return named.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(stored(more, "found"))
    return out.join(named.select(ROW, "item_id"), ROW).select("item_id", "rank", "doc_id", "score")
