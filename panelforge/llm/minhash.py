"""Near-duplicate groups: tensored MinHash tables for candidates, full shingle sets for the links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import kernels as K
from panelforge.llm.groups import bounded_groups, components, dealt, whole_groups
from panelforge.llm.skew import lookup
from panelforge.llm.storage import ROW, called, numbered, plain, small_batches, stored, without_rows

#: Two collections of SIDE half-keys, each of ROWS minhashes. Every pair of half-keys, one from each, is a
#: table: SIDE**2 tables from 2 * SIDE * ROWS minhashes. A pair of similarity s meets in no table with
#: probability of about 2 * (1 - s**ROWS)**SIDE: 7e-5 at 0.85.
SIDE, ROWS = 8, 2
#: Of the 32 two-bit pieces of a sketch: most that may differ for two documents to be candidates (at 0.85
#: 3.6 are expected, more than 13 have a chance of 1e-6), and most for one not to open a group of its own.
LOOSE, TIGHT = 13, 8
#: Documents and shingles of a family of candidates that one task compares; in larger families candidates are verified edge
#: by edge, and what may be linked beyond that meets by rare shingles.
FAMILY_DOCS, FAMILY_SHINGLES = 4096, 4_000_000
#: Rows of one bucket that a task holds at once; a larger bucket is taken in portions.
HELD_ROWS = 1_000_000

_SEEDS = K.mix(np.arange(2 * SIDE * ROWS * 2, dtype=np.uint64), 77)
_XOR, _MUL = _SEEDS[::2], _SEEDS[1::2] | K.U(1)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words is one shingle; no words: none."""
    data, off = K.text_buffers(texts)
    _, _, h, at = K.words(data, off, K.BLANK_WORD, lower=True)
    g = K.mix(K.grams(h, size), 3)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            out.append(K.mix(K.grams(h[a:b], b - a), 100 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(shingles: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-keys (n, 2 * SIDE) and sketches of non-empty sets laid end to end."""
    mins = np.stack([np.minimum.reduceat((shingles ^ x) * m, off[:-1]) for x, m in zip(_XOR, _MUL, strict=True)], axis=1)
    low = K.mix(mins, 9) & K.U(3)
    sketch = np.bitwise_or.reduce(low << (np.arange(low.shape[1], dtype=np.uint64) * K.U(2)), axis=1)
    halves = mins.reshape(len(mins), 2 * SIDE, ROWS)
    key = K.mix(halves[:, :, 0], 21)
    for r in range(1, ROWS):
        key = K.mix(key ^ halves[:, :, r], 21 + r)
    return key, sketch


#: d1, d2: 128 bits of the SHA-256 of the lower-cased text, by which copies are one class.
SCANNED = "doc_id long, n_shingles long, d1 long, d2 long, halves array<long>, sketch long"


def scanned(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """For each document the digest of its text, and the size, half-keys and sketch of its shingle set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, all_off = K.text_buffers(batch.column(1))
            for a, b in K.slices(all_off):
                sets = shingle_sets(batch.column(1).slice(a, b - a), size)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                data, off = K.text_buffers(batch.column(1).slice(a, b - a))
                low, at = K.LOWER[data].tobytes(), off.tolist()
                d = np.frombuffer(b"".join(hashlib.sha256(low[x:y]).digest()[:16] for x, y in zip(at[:-1], at[1:], strict=True)), np.uint64).reshape(-1, 2)
                halves, sketch = np.zeros((len(sets), 2 * SIDE), np.uint64), np.zeros(len(sets), np.uint64)
                if len(some):
                    flat, off = np.concatenate(sets), np.concatenate([[0], np.cumsum(n[some])])
                    halves[some], sketch[some] = _signature(flat, off)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * 2 * SIDE, pa.int32()), pa.array(K.signed(halves.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(K.signed(d[:, 0].copy())), pa.array(K.signed(d[:, 1].copy())), lists, pa.array(K.signed(sketch))], ["doc_id", "n_shingles", "d1", "d2", "halves", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(K.tidy(scan), SCANNED)


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, sketch): SIDE**2 rows for each class of equal sets."""
    side = np.arange(SIDE, dtype=np.uint64)
    for batch in batches:
        halves = batch.column(1)
        h = np.asarray(halves.flatten()).view(np.uint64).reshape(-1, 2 * SIDE)
        for at in range(0, len(h), 4000):
            part = h[at : at + 4000]
            left, right = K.mix(part[:, :SIDE] + side, 41), K.mix(part[:, SIDE:] + side, 42)
            key = K.mix(left[:, :, None] ^ right[:, None, :], 43).reshape(len(part), -1)
            n = key.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(key.ravel())), pa.array(np.repeat(batch.column(0).to_numpy()[at : at + 4000], n)), pa.array(np.repeat(batch.column(2).to_numpy()[at : at + 4000], n))], ["key", "doc", "sketch"])


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return np.bitwise_count((x | x >> K.U(1)) & K.U(0x5555555555555555))


class Bucket:
    """Ties a bucket's members through leaders, so that each part of the bucket is a tree of edges, never all pairs.

    A member that differs from all leaders by more than TIGHT becomes one. Members within LOOSE of a leader
    are in its part, and parts that share a member are one. Two documents over the threshold end in the same
    part: one of them is tight to a leader, and the other is then within LOOSE of that leader. Members may
    come in any number of portions; only the leaders are remembered between them.
    """

    def __init__(self) -> None:
        self.docs: list[int] = []
        self.sketches: list[np.uint64] = []

    def tie(self, doc: np.ndarray, sketch: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Edges as (documents, other) of this portion."""
        edges: list[tuple[np.ndarray, int]] = []
        part = np.full(len(doc), -1)  # the leader, by number, that stands for a member's part
        free = np.ones(len(doc), bool)
        k = 0
        while k < len(self.docs) or free.any():
            if k == len(self.docs):
                j = int(np.argmax(free))
                free[j] = False
                self.docs.append(int(doc[j]))
                self.sketches.append(sketch[j])
            lead = self.docs[k]
            d = _differ(sketch, self.sketches[k])
            near = d <= LOOSE
            joined = np.unique(part[near & (part >= 0)])
            others = np.concatenate([doc[near & (part < 0)], np.array([self.docs[i] for i in joined], np.int64)])
            edges.append((others[others != lead], lead))
            part[near | np.isin(part, joined)] = k
            free &= d > TIGHT
            k += 1
        return edges


def _pairs(edges: list[tuple[np.ndarray, int | np.ndarray]]) -> pa.RecordBatch | None:
    a = np.concatenate([x for x, _ in edges]) if edges else np.zeros(0, np.int64)
    if not len(a):
        return None
    b = np.concatenate([np.broadcast_to(y, len(x)) for x, y in edges])
    pairs = np.unique(np.stack([a, b], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that join the members of each bucket; rows are sorted by key and document, so the first leads.

    Buckets whose members are all like the first, nearly all of them, are done without a loop.
    """
    large = Bucket()
    for table, kind in bounded_groups(batches, "key", HELD_ROWS):
        if kind == "end":
            large = Bucket()
            continue
        key, doc, sketch = (table.column(c).to_numpy() for c in ("key", "doc", "sketch"))
        sketch = sketch.view(np.uint64)
        if kind == "part":
            out = _pairs(large.tie(doc, sketch))
            if out is not None:
                yield out
            continue
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        lead = np.repeat(start, size)
        diff = _differ(sketch, sketch[lead])
        mixed = np.add.reduceat(diff > TIGHT, start) > 1
        plain = (diff <= LOOSE) & (doc != doc[lead]) & ~np.repeat(mixed, size)
        edges: list[tuple[np.ndarray, int | np.ndarray]] = [(doc[plain], doc[lead[plain]])]
        for g in np.flatnonzero(mixed).tolist():
            s, e = int(start[g]), int(start[g] + size[g])
            edges += Bucket().tie(doc[s:e], sketch[s:e])
        out = _pairs(edges)
        if out is not None:
            yield out


def linked(docs: np.ndarray, sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links 100 * |A & B| >= percent * |A | B| among these documents, each as (doc, other).

    known: labels of documents that are joined already where equal. Two linked sets share one of each one's rarest
    shingles (of n, the n - ceil(percent * n / 100) + 1 that fewest documents here have), so one document at a time meets
    those that hold one of its rarest; pairs that no link found before joins are compared on the full sets.
    """
    n = len(docs)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    owner, value = owner[order], flat[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(value)]]))
    posting = np.empty(len(flat), np.int64)
    posting[order] = np.repeat(np.arange(len(first)), count)
    at = np.concatenate([[0], np.cumsum(size)])
    label = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    out = []
    for i in range(n - 1):
        if (label == label[0]).all():
            break
        todo = label != label[i]
        todo[: i + 1] = False
        todo &= (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (size > 0)
        if not todo.any() or not size[i]:
            continue
        p = posting[at[i] : at[i + 1]]
        rare = p[np.argsort(count[p], kind="stable")][: size[i] + percent * size[i] // -100 + 1]
        meet = _holders(rare[count[rare] > 1], first, count, owner)
        todo &= np.bincount(meet, minlength=n) > 0
        some = np.flatnonzero(todo)
        if not len(some):
            continue
        if len(some) < 20:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in some.tolist()])
        else:
            common = np.bincount(_holders(p, first, count, owner), minlength=n)[some]
        for j in some[100 * common >= percent * (size[some] + size[i] - common)].tolist():
            if label[j] != label[i]:
                out.append((int(docs[i]), int(docs[j])))
                label[label == label[j]] = label[i]
    return out


def _holders(postings: np.ndarray, first: np.ndarray, count: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The documents of each of these postings, one after the other."""
    c = count[postings]
    return owner[np.repeat(first[postings] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())] if len(postings) else owner[:0]


def _set_rows(size: int):
    """(node, root, text) -> (node, root, set)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = K.text_buffers(batch.column(2))
            for a, b in K.slices(off):
                sets = shingle_sets(batch.column(2).slice(a, b - a), size)
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(K.signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["node", "root", "set"])

    return scan


def compared(texts: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) within each group of members (node, root, known, n_shingles): groups over FAMILY_DOCS are cut in blocks,
    which meet in pairs."""
    total = members.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"))
    most = lambda c, limit: F.when(F.col(c) > limit, F.ceil(2 * F.col(c) / limit)).otherwise(1)
    total = total.withColumn("blocks", F.greatest(most("docs", FAMILY_DOCS), most("shingles", FAMILY_SHINGLES)).cast("int"))
    mine = lookup(members.select("node", "root", "known"), total.select("root", "blocks", "docs"), ["root"], "docs").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = texts.join(mine.hint("merge"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    jobs = rows.withColumn("other", other).select("node", "known", "text", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("job"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "job"):
            table = table.combine_chunks()
            job, node, known = (table.column(c).to_numpy() for c in ("job", "node", "known"))
            start = np.concatenate([np.flatnonzero(np.concatenate([[True], job[1:] != job[:-1]])), [len(job)]])
            found: list[tuple[int, int]] = []
            for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                found += linked(node[s:e], shingle_sets(table.column("text").slice(s, e - s), shingle), percent, known[s:e])
            if found:
                a, b = np.array(found, np.int64).T.copy()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt(jobs, "job", "node").mapInArrow(K.tidy(verify), "a long, b long")


def large_families(texts: DataFrame, nodes: DataFrame, edges: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) in families too large to be compared by one task each: their nodes (node, root) and candidate edges.

    First each candidate edge is verified on the full sets; what is linked so is one component. A link that is left over joins
    two components, and its documents share one of each one's rarest shingles in the family. So documents meet by those, only
    where they are of several components (families of one component are done): pages of one template, each with its own content, meet nowhere, and copies of
    one text are one component by then. Lists of the same documents are compared once.
    """
    sets = stored(texts.join(nodes.hint("merge"), "node").select("node", "root", "text").mapInArrow(K.tidy(_set_rows(shingle)), "node long, root long, set array<long>"), "large-sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"{c}_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    ends = edges.join(side("a"), "a").join(side("b"), "b")
    links = stored(ends.withColumn("both", shared).filter(100 * F.col("both") >= percent * (F.size("a_set") + F.size("b_set") - F.col("both"))).select("a", "b"), "large-links")
    label = components(links).withColumnRenamed("root", "known")
    joined = stored(sets.select("node", "root").join(label, "node", "left").withColumn("known", F.coalesce("known", "node")), "large-labels")
    several = joined.groupBy("root").agg(F.min("known").alias("low"), F.max("known").alias("high"), F.count(F.lit(1)).alias("docs")).filter("low <> high").select("root", "docs")
    open_ = lookup(sets, several, ["root"], "docs")
    item = open_.select("node", "root", F.size("set").cast("long").alias("n_shingles"), F.explode("set").alias("h"))
    held = stored(item.groupBy("root", "h").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "large-shingles")
    least = (F.col("n_shingles") - F.ceil(percent * F.col("n_shingles") / 100) + 1).cast("int")
    rare = lookup(item, held, ["root", "h"], "held", "left").groupBy("node", "root", "n_shingles").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "h"))).alias("all"))
    rare = rare.select("node", "root", "n_shingles", F.explode(F.slice("all", 1, least)).alias("x")).filter("x.held > 1").select("node", "n_shingles", F.xxhash64("root", "x.h").alias("list"))
    rare = stored(rare.join(joined.select("node", "known"), "node"), "large-rare")
    lists = rare.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("known").alias("low"), F.max("known").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    chosen = lists.filter("low <> high").groupBy("n", "x", "s").agg(F.min("list").alias("list")).select("list", "n")
    members = lookup(rare, stored(chosen, "large-lists"), ["list"], "n").select("node", F.col("list").alias("root"), "known", "n_shingles")
    return links.unionByName(compared(texts, stored(members, "large-members"), shingle, percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of non-blanks after lower-casing A-Z; a document's set is its distinct `shingle`-word
    shingles, its whole word sequence if it has fewer words, and empty without words (null included), which
    is linked with nothing. Documents are linked when 100 * intersection >= percent * union on full sets;
    component_id is the smallest doc_id reachable over links. Rows that repeat an id are one node. Rows with
    a null id are linked with nothing: their component_id is null and they are kept. An empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = stored(scanned(docs, id_col, text_col, shingle), "sets")
    same = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "halves", "sketch", "n_shingles")).alias("c"), F.count(F.lit(1)).alias("copies"))
    classes = stored(same.select("d1", "d2", "copies", "c.*"), "classes")
    buckets = classes.select("doc_id", "halves", "sketch").mapInArrow(K.tidy(_table_rows), "key long, doc long, sketch long")
    edges = stored(dealt(buckets, "key", "doc").mapInArrow(K.tidy(_candidates), "a long, b long").distinct(), "candidates")
    family = components(edges)
    sized = family.join(classes.select(F.col("doc_id").alias("node"), "n_shingles").distinct(), "node").withColumn("known", F.col("node"))
    sized = stored(sized, "families")
    total = sized.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"))
    large = stored(total.filter((F.col("docs") > FAMILY_DOCS) | (F.col("shingles") > FAMILY_SHINGLES)), "large")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    if large.limit(1).count():
        mine = lookup(sized, large.select("root", "docs"), ["root"], "docs", "left")
        far = stored(mine.filter("docs IS NOT NULL").select("node", "root"), "large-nodes")
        inside = edges.join(far.select(F.col("node").alias("a")), "a", "left_semi")
        found = compared(texts, mine.filter("docs IS NULL").drop("docs"), shingle, percent).unionByName(large_families(texts, far, inside, shingle, percent))
    else:
        found = compared(texts, sized, shingle, percent)
    links = components(found)
    placed = classes.join(links, classes.doc_id == links.node, "left").select("d1", "d2", "copies", F.coalesce("root", "doc_id").alias("component_id"))
    some = lookup(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "d1", "d2"), placed, ["d1", "d2"], "copies")
    none = rows.filter("n_shingles = 0 OR doc_id IS NULL")
    out = some.select("doc_id", "n_shingles", "component_id").unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row for each group of near_duplicates, all columns as they are: that of the smallest id, a null one last.

    Rows are judged by their texts alone, whatever their ids; columns may have any names.
    """
    rows = numbered(plain(docs))
    found = near_duplicates(rows, ROW, called(docs, text_col), shingle, percent).select(F.col("doc_id").alias(ROW), "component_id")
    named = stored(found.join(rows.select(ROW, F.col(called(docs, id_col)).alias("id")), ROW), "groups")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", ROW)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = lookup(named, stored(first.select("component_id", F.col(f"first.{ROW}").alias("stays"), "n"), "firsts"), ["component_id"], "n")
    return without_rows(rows, gone.filter(F.col(ROW) != F.col("stays")).select(ROW)).toDF(*docs.columns)
