"""Model operators: NumPy kernels over one series or replicate a group, as Arrow-based grouped functions."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.order import checkpointed


#: Rows and bytes of a block at most, as dealt by hashes; a task of a silhouette holds two.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 1 << 25


def free_parameters(k: Column, d: Column, family: Column) -> Column:
    """Free parameters of a k-component mixture in d dimensions: full, tied, diag or spherical covariance."""
    half = F.floor(d * (d + 1) / 2)
    cov = F.when(family == "full", k * half).when(family == "tied", half).when(family == "diag", k * d).otherwise(k)
    return (k * d + cov + k - 1).cast("long")


def cusum(x: np.ndarray, slack: float, limit: float, rest: int) -> list[int]:
    """Places where the two-sided cumulative sum of standardised x passes limit; it restarts there, `rest` places on at least."""
    spread = x.std()
    z = (x - x.mean()) / spread if spread > 0 else np.zeros(len(x))
    up = down = 0.0
    out: list[int] = []
    for i, v in enumerate(z):
        up, down = max(0.0, up + v - slack), max(0.0, down - v - slack)
        if max(up, down) > limit and (not out or i - out[-1] >= rest):
            out.append(i)
            up = down = 0.0
    return out


def segments(x: np.ndarray, penalty: float, least: int = 2) -> list[int]:
    """Change points by pruned exact segmentation under a Gaussian-kernel cost (median bandwidth); ends excluded."""
    n = len(x)
    if n < 2 * least:
        return []
    d = (x[:, None] - x[None, :]) ** 2
    scale = np.median(d[d > 0]) if (d > 0).any() else 1.0
    gram = np.exp(-d / scale)
    corner = np.zeros((n + 1, n + 1))
    corner[1:, 1:] = gram.cumsum(0).cumsum(1)
    cost = lambda a, b: (b - a) - (corner[b, b] - corner[a, b] - corner[b, a] + corner[a, a]) / (b - a)
    best, back, alive = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for end in range(least, n + 1):
        tried = [(best[a] + cost(a, end) + penalty, a) for a in alive if end - a >= least]
        if not tried:
            continue
        best[end], back[end] = min(tried)
        alive = [a for a in alive if end - a < least or best[a] + cost(a, end) <= best[end]] + [end]
    out, at = [], n
    while back[at] > 0:
        at = int(back[at])
        out.append(at)
    return sorted(out)


def mixture(x: np.ndarray, k: int, family: str, seed: int, rounds: int = 200, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """(labels, means, log-likelihood, converged) of a Gaussian mixture by expectation-maximisation.

    Starts from k distant points chosen by seeded k-means++; covariance family full, tied, diag or spherical.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    means = x[[rng.integers(n)]]
    while len(means) < k:
        far = ((x[:, None] - means[None]) ** 2).sum(2).min(1)
        means = np.vstack([means, x[rng.choice(n, p=far / far.sum()) if far.sum() > 0 else rng.integers(n)]])
    resp = np.eye(k)[((x[:, None] - means[None]) ** 2).sum(2).argmin(1)]
    before = -np.inf
    for _ in range(rounds):
        size = resp.sum(0) + 1e-10
        means = resp.T @ x / size[:, None]
        covs = np.stack([(resp[:, j, None] * (x - means[j])).T @ (x - means[j]) / size[j] for j in range(k)])
        if family == "tied":
            covs[:] = (covs * size[:, None, None]).sum(0) / size.sum()
        elif family == "diag":
            covs = np.stack([np.diag(np.diag(c)) for c in covs])
        elif family == "spherical":
            covs = np.stack([np.eye(d) * np.trace(c) / d for c in covs])
        covs = covs + floor * np.eye(d)
        dens = np.empty((n, k))
        for j in range(k):
            low = np.linalg.cholesky(covs[j])
            z = np.linalg.solve(low, (x - means[j]).T)
            dens[:, j] = np.log(size[j] / n) - 0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi)
        top = dens.max(1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(dens - top).sum(1))
        resp = np.exp(dens - each[:, None])
        now = float(each.sum())
        if abs(now - before) < 1e-4 * n:
            return resp.argmax(1), means, now, True
        before = now
    return resp.argmax(1), means, before, False


def _kept(points: DataFrame) -> DataFrame:
    """points stored once for many passes, in the shared folder."""
    return checkpointed(points)


def _pass(points: DataFrame, each: Callable[[np.ndarray, np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """each(keys, x) of every batch of points (key, x), merged within partitions, then by sixteenths, then in all."""

    def fold(found: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = reduce(merge, found, None)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(each(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)) for b in batches if b.num_rows)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (np.asarray(v) for b in batches for v in b.column("v").to_pylist())

    parts = points.select("key", "x").mapInArrow(scan, "v array<double>")
    if points.rdd.getNumPartitions() > 64:
        parts = parts.withColumn("part", F.spark_partition_id()).repartition(16, "part").select("v").mapInArrow(lambda batches: fold(rows(batches)), "v array<double>")
    return reduce(merge, sorted((np.asarray(r["v"]) for r in parts.collect()), key=tuple))


def _add(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    return b if a is None else a + b


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from keys and salt alone."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(times)
    return ((z >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def _starts(points: DataFrame, ks: list[int], salts: list[int], d: int) -> list[np.ndarray]:
    """For each job its k first centres by k-means++ over all rows.

    A row is drawn with a probability in proportion to its squared distance from the centres so far: the
    least of -log(u) / distance wins, u being hashed from the row's key, so one pass draws for all jobs.
    """
    centres: list[np.ndarray] = [np.empty((0, d)) for _ in ks]
    for step in range(max(ks)):
        now = [j for j, k in enumerate(ks) if k > step]

        def each(keys: np.ndarray, x: np.ndarray, now: list[int] = now, step: int = step) -> np.ndarray:
            out = []
            for j in now:
                far = _squares(x, centres[j]).min(1) if step else np.ones(len(x))
                race = np.where(far > 0, -np.log(_uniform(keys, salts[j] * 64 + step)) / np.where(far > 0, far, 1), np.inf)
                at = int(race.argmin())
                out.append(np.concatenate([[race[at]], x[at]]))
            return np.stack(out)

        def least(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
            if a is None:
                return b
            a, b = a.reshape(-1, d + 1), b.reshape(-1, d + 1)
            return np.where(b[:, :1] < a[:, :1], b, a)

        for j, row in zip(now, _pass(points, each, least).reshape(-1, d + 1), strict=True):
            centres[j] = np.vstack([centres[j], row[1:]])
    return centres


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def mixture_fits(points: DataFrame, d: int, jobs: list[tuple[int, int]], family: str, rounds: int = 200, floor: float = 1e-6) -> tuple[int, list[tuple[np.ndarray, float, bool]]]:
    """(rows, one (means, log-likelihood, converged) for each job (k, seed)): the fits of `mixture`, over all rows of points (key, x).

    A round is one pass for all jobs not yet settled; what reaches the driver are the sums of each component. Starts are drawn
    from rows; rounds take each distinct point once, weighed by its rows.
    """
    weighed = _kept(points.groupBy("x").agg(F.count(F.lit(1)).alias("key")))
    centre = _pass(points, lambda _, x: np.concatenate([[len(x)], x.sum(0)]), _add)
    n, mid = int(centre[0]), centre[1:] / centre[0]
    state: list[tuple] = [(c - mid, None, None) for c in _starts(points, [k for k, _ in jobs], [s * 64 + k for k, s in jobs], d)]
    before, done = [-np.inf] * len(jobs), {}
    for turn in range(rounds + 1):
        now = [j for j in range(len(jobs)) if j not in done]
        if not now:
            break

        def each(w: np.ndarray, x: np.ndarray, now: list[int] = now) -> np.ndarray:
            x, out = x - mid, []
            for j in now:
                means, covs, share = state[j]
                if covs is None:
                    resp, like = np.eye(len(means))[_squares(x, means).argmin(1)], 0.0
                else:
                    dens = np.empty((len(x), len(means)))
                    for i, m in enumerate(means):
                        low = np.linalg.cholesky(covs[i])
                        dens[:, i] = np.log(share[i]) - 0.5 * (np.linalg.solve(low, (x - m).T) ** 2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi)
                    top = dens.max(1, keepdims=True)
                    total = top[:, 0] + np.log(np.exp(dens - top).sum(1))
                    resp, like = np.exp(dens - total[:, None]), float(w @ total)
                resp = resp * w[:, None]  # by the rows of each point, at the start too
                out += [[like], resp.sum(0), (resp.T @ x).ravel(), np.einsum("ni,na,nb->iab", resp, x, x, optimize=True).ravel()]
            return np.concatenate(out)

        got, at = _pass(weighed, each, _add), 0
        for j in now:
            k = jobs[j][0]
            like, size, first, second = np.split(got[at : at + 1 + k * (1 + d + d * d)], [1, 1 + k, 1 + k + k * d])
            at += 1 + k * (1 + d + d * d)
            if turn and (abs(like[0] - before[j]) < 1e-4 * n or turn == rounds):
                done[j] = (state[j][0] + mid, float(like[0]), abs(like[0] - before[j]) < 1e-4 * n)
                continue
            before[j] = like[0] if turn else -np.inf
            size = size + 1e-10
            means = first.reshape(k, d) / size[:, None]
            covs = second.reshape(k, d, d) / size[:, None, None] - means[:, :, None] * means[:, None, :]
            if family == "tied":
                covs = np.repeat(((covs * size[:, None, None]).sum(0) / size.sum())[None], k, 0)
            elif family == "diag":
                covs = covs * np.eye(d)
            elif family == "spherical":
                covs = np.stack([np.eye(d) * np.trace(c) / d for c in covs])
            state[j] = (means, covs + floor * np.eye(d), size / n)
    return n, [done[j] for j in range(len(jobs))]


def mixture_sweep(points: DataFrame, key: str, features: list[str], ks: list[int], seeds: list[int], family: str = "diag") -> DataFrame:
    """(k, seed, bic, aic, converged, chosen, modal) of a mixture over all rows of points; key is a number of its own for each row.

    chosen: of its seed's converged fits the one of least BIC, the smaller k on ties. modal: the k that most seeds choose.
    """
    jobs, d = [(k, s) for k in ks for s in seeds], len(features)
    n, fits = mixture_fits(_kept(points.select(F.col(key).cast("long").alias("key"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))), d, jobs, family)
    half = {"full": lambda k, d: k * d * (d + 1) // 2, "tied": lambda k, d: d * (d + 1) // 2, "diag": lambda k, d: k * d, "spherical": lambda k, d: k}[family]
    free = [k * d + half(k, d) + k - 1 for k, _ in jobs]
    rows = [(k, s, float(f * np.log(n) - 2 * like), float(2 * f - 2 * like), bool(ok)) for (k, s), f, (_, like, ok) in zip(jobs, free, fits, strict=True)]
    best = {s: min((r for r in rows if r[1] == s and r[4]), key=lambda r: (r[2], r[0]), default=None) for s in seeds}
    votes = Counter(r[0] for r in best.values() if r is not None)
    modal = min(votes, key=lambda k: (-votes[k], k), default=None)
    told = [(*r, best[r[1]] is not None and best[r[1]][0] == r[0], r[0] == modal) for r in rows]
    return points.sparkSession.createDataFrame(told, "k int, seed int, bic double, aic double, converged boolean, chosen boolean, modal boolean")


def kmeans_fits(points: DataFrame, d: int, ks: list[int], seed: int, starts: int = 10, rounds: int = 100) -> dict[int, tuple[np.ndarray, float]]:
    """(centres, inertia) for each k, the best of several seeded starts, over all rows of points (key, x).

    A round is one pass for all k and starts not yet settled; what reaches the driver are the sums of each cluster.
    """
    jobs = [(k, s) for k in ks for s in range(starts)]
    centres = _starts(points, [k for k, _ in jobs], [(seed * 64 + s) * 64 + k for k, s in jobs], d)
    inertia, settled = [np.inf] * len(jobs), [False] * len(jobs)
    for turn in range(rounds + 1):
        now = [j for j in range(len(jobs)) if not settled[j] or turn == rounds]
        if not now:
            break

        def each(_: np.ndarray, x: np.ndarray, now: list[int] = now) -> np.ndarray:
            out, squares, at = [], _squares(x, np.vstack([centres[j] for j in now])), 0
            for j in now:
                part = squares[:, at : at + jobs[j][0]]
                at += jobs[j][0]
                own = np.eye(jobs[j][0])[part.argmin(1)]
                out += [[part.min(1).sum()], own.sum(0), (own.T @ x).ravel()]
            return np.concatenate(out)

        got, at = _pass(points, each, _add), 0
        for j in now:
            k = jobs[j][0]
            cost, size, total = np.split(got[at : at + 1 + k * (1 + d)], [1, 1 + k])
            at += 1 + k * (1 + d)
            new = np.where(size[:, None] > 0, total.reshape(k, d) / np.maximum(size, 1)[:, None], centres[j])
            inertia[j], settled[j] = float(cost[0]), bool(np.allclose(new, centres[j]))
            if turn < rounds and not settled[j]:
                centres[j] = new
    best = {k: min((j for j in range(len(jobs)) if jobs[j][0] == k), key=lambda j: (inertia[j], j)) for k in ks}
    return {k: (centres[j], inertia[j]) for k, j in best.items()}


def _distances(p: np.ndarray, q: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The distance of each row of p to each of q, written into room (two such tables): from differences in few places, in
    many by a product about their midst."""
    total, far = (r[: len(p), : len(q)] for r in room)
    if p.shape[1] > 8:
        mid = q.mean(0)
        p, q = p - mid, q - mid
        np.matmul(p, -2 * q.T, out=total)
        total += (p**2).sum(1)[:, None]
        total += (q**2).sum(1)
        np.maximum(total, 0, out=total)
    else:
        total[:] = 0
        for a, b in zip(p.T, np.ascontiguousarray(q.T), strict=True):
            np.subtract(a[:, None], b, out=far)
            np.multiply(far, far, out=far)
            total += far
    return np.sqrt(total, out=total)


def silhouettes(points: DataFrame, fits: dict[int, np.ndarray], block: int = BLOCK_ROWS, judged: int = 256) -> dict[int, float | None]:
    """The mean Euclidean silhouette of the clusters about each fit's centres, over all rows of points (key, x).

    Every row is held against every row; rows of one place are judged once and weighed by their number. Places are dealt to
    blocks (about `block` places and BLOCK_BYTES at most), and any two blocks meet once, in a task that holds these two and
    adds up their distances both ways, `judged` rows of each at a time. Distances grow with the square of the distinct
    places; what a task holds does not. A row without a place, or with a null in it, is in no cluster and counts 0; no rows
    have no mean.
    """
    ks, n, spark = sorted(fits), points.count(), points.sparkSession
    width, d = sum(ks), len(fits[ks[0]][0])
    placed = points.filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    places = _kept(placed.groupBy("x").agg(F.count(F.lit(1)).alias("key")))
    m = places.count()
    if m == 0:
        return {k: 0.0 if n else None for k in ks}
    most = max(1, min(block, BLOCK_BYTES // (8 * (d + 2 * width))))
    # a few pairs of blocks for each core, where there are places enough
    cuts = max(-(-m // most), min(-(-m // 4096), math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism))))

    def nearest(x: np.ndarray) -> np.ndarray:
        return np.stack([np.stack([((x - c) ** 2).sum(1) for c in fits[k]], axis=1).argmin(1) for k in ks], axis=1)

    def members(own: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.concatenate([np.eye(k)[own[:, i]] for i, k in enumerate(ks)], axis=1) * weight[:, None]

    sizes = _pass(places, lambda weight, x: members(nearest(x), weight).sum(0), _add)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
        held = np.column_stack([rows.column("key").to_numpy(), x]).tobytes()
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([key[1].as_py()], pa.int32()), "held": pa.array([held], pa.binary())})

    pieces = -(-m // (cuts * max(1, min(1024, (1 << 20) // (8 * (d + 1))))))
    z = F.pmod(F.xxhash64("x"), F.lit(cuts * pieces))
    dealt = places.select("x", "key", (z % cuts).cast("int").alias("b"), F.floor(z / cuts).cast("int").alias("piece"))
    packed = _kept(dealt.groupBy("b", "piece").applyInArrow(pack, "b int, piece int, held binary"))
    later, sooner = F.sequence("b", F.lit(cuts - 1)), F.sequence(F.lit(0), F.col("b"))
    tasks = 2 * cuts * (cuts + 1)  # four for each pair, so that hashes bring few pairs together
    left = packed.select(F.col("b").alias("i"), F.explode(later).alias("j"), "piece", "held").repartition(tasks, "i", "j")
    right = packed.select(F.explode(sooner).alias("i"), F.col("b").alias("j"), "piece", "held").repartition(tasks, "i", "j")
    names = ["id", *[f"s{c}" for c in range(width)], *[f"own{k}" for k in ks], "weight"]
    kinds = pa.schema([(c, pa.float64() if c[0] == "s" else pa.int64()) for c in names])

    def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        held = b"".join(rows.sort_by("piece").column("held").to_pylist())
        whole = np.frombuffer(held).reshape(-1, d + 1)
        return whole[:, 0], np.ascontiguousarray(whole[:, 1:])

    def summed(b: int, sums: np.ndarray, own: np.ndarray | None = None, weight: np.ndarray | None = None) -> pa.Table:
        told = [None] * (len(ks) + 1) if own is None else [*own.T, weight.astype(np.int64)]
        rows = zip([(b << 32) + np.arange(len(sums)), *sums.T, *told], kinds.types, strict=True)
        return pa.table([pa.nulls(len(sums), t) if c is None else pa.array(c, t) for c, t in rows], schema=kinds)

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = (v.as_py() for v in key)
        if not a.num_rows or not b.num_rows:
            return kinds.empty_table()
        (w, p), (v, q) = unpacked(a), unpacked(b)
        own = nearest(p)
        mine, others = members(own, w), members(nearest(q), v)
        here, there, room = np.zeros((len(p), width)), np.zeros((len(q), width)), np.empty((2, judged, judged))
        for s in range(0, len(p), judged):
            for t in range(s if i == j else 0, len(q), judged):
                far = _distances(p[s : s + judged], q[t : t + judged], room)
                if i == j and s == t:
                    np.fill_diagonal(far, 0)
                else:
                    there[t : t + judged] += (mine[s : s + judged].T @ far).T
                here[s : s + judged] += far @ others[t : t + judged]
        if i == j:
            return summed(i, here + there, own, w)
        return pa.concat_tables([summed(i, here), summed(j, there)])

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'long'}" for f in kinds))
    totals = met.groupBy("id").agg(*[(F.sum if c[0] == "s" else F.max)(c).alias(c) for c in names[1:]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out, at, weight = np.arange(b.num_rows), [], 0, b.column("weight").to_numpy()
            total = np.stack([b.column(f"s{c}").to_numpy() for c in range(width)], axis=1)
            for k in ks:
                own, size, part = b.column(f"own{k}").to_numpy(), sizes[at : at + k], total[:, at : at + k]
                at += k
                a = part[row, own] / np.maximum(size[own] - 1, 1)
                other = np.where(size > 0, part / np.maximum(size, 1), np.inf)
                other[row, own] = np.inf
                near = other.min(1)
                s = np.where((size[own] > 1) & (near != np.inf), (near - a) / np.maximum(np.maximum(a, near), 1e-300), 0.0)
                out.append(float(weight @ s))
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in out], [f"k{k}" for k in ks])

    total = totals.mapInArrow(score, ", ".join(f"k{k} double" for k in ks)).agg(*[F.sum(f"k{k}").alias(f"k{k}") for k in ks]).first()
    return {k: total[f"k{k}"] / n for k in ks}


def kmeans_sweep(points: DataFrame, key: str, vector: str, ks: list[int], seed: int, starts: int = 10) -> DataFrame:
    """(k, silhouette, inertia) of k-means over all rows of points and all places of vector; key is a number of its own for each row."""
    spark, kept = points.sparkSession, _kept(points.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x")))
    first = kept.first()
    fits = kmeans_fits(kept, len(first["x"]), ks, seed, starts) if first else {}
    shape = silhouettes(kept, {k: c for k, (c, _) in fits.items()}) if first else {}
    return spark.createDataFrame([(k, float(shape[k]), float(fits[k][1])) for k in fits], "k int, silhouette double, inertia double")


def isolation_scores(x: np.ndarray, at: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0) -> np.ndarray:
    """Anomaly scores (0 to 1) of rows `at` in a forest of random splits grown on x."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    tail = lambda n: 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0
    total = np.zeros(len(at))

    def walk(rows: np.ndarray, who: np.ndarray, depth: int, most: int) -> None:
        wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth >= most or len(wide) == 0:
            total[who] += depth + tail(len(rows))
            return
        c = rng.choice(wide)
        cut = rng.uniform(rows[:, c].min(), rows[:, c].max())
        for side, there in ((rows[:, c] < cut, at[who, c] < cut), (rows[:, c] >= cut, at[who, c] >= cut)):
            if there.any():
                walk(rows[side], who[there], depth + 1, most)

    for _ in range(trees):
        walk(x[rng.choice(len(x), size, replace=False)], np.arange(len(at)), 0, int(np.ceil(np.log2(max(size, 2)))))
    return 2.0 ** (-total / trees / tail(size)) if size > 1 else np.zeros(len(at))


def per_series(df: DataFrame, keys: list[str], order: str, value: str, places: Callable[[np.ndarray], list[int]]) -> DataFrame:
    """(keys, order) of the rows that `places` picks from each series; a series is held by one worker at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.iloc[places(pdf[value].to_numpy(float))][[*keys, order]]

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*keys, order)))


def bootstrap_sums(df: DataFrame, group: str, value: Column, replicates: int, seed: int) -> DataFrame:
    """(replicate, total, n): sums over groups drawn with replacement, by Poisson weights from a hash of (group, replicate).

    Groups are summed first, so the expansion is groups x replicates, whatever the rows. The draws are the
    same on every engine run and for every partitioning.
    """
    sums = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    wide = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = F.pmod(F.xxhash64(F.col(group), F.col("replicate"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    steps = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.061313240195240384, 0.015328310048810096, 0.003065662009762019, 0.0005109436682936699])
    weight = sum(((u >= float(c)).cast("int") for c in steps), F.lit(0))
    return wide.withColumn("w", weight).groupBy("replicate").agg(F.sum(F.col("w") * F.col("s")).alias("total"), F.sum(F.col("w") * F.col("c")).alias("n"))


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 10, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centres, inertia) of the best of several seeded starts."""
    best = None
    for start in range(starts):
        rng = np.random.default_rng((seed, start))
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.stack([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        inertia = float(((x - c[label]) ** 2).sum())
        if best is None or inertia < best[2]:
            best = (label, c, inertia)
    return best


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance; a member alone in its cluster counts 0."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = np.unique(label)
    if len(groups) < 2:
        return 0.0
    total = np.stack([d[:, label == g].sum(1) for g in groups], axis=1)
    size = np.array([(label == g).sum() for g in groups])
    own = np.searchsorted(groups, label)
    at = np.arange(len(x))
    a = total[at, own] / np.maximum(size[own] - 1, 1)
    other = total / size
    other[at, own] = np.inf
    b = other.min(1)
    s = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def aligned(reference: np.ndarray, other: np.ndarray) -> list[int]:
    """The order of other's components that lies nearest the reference's, the first in dictionary order on ties."""
    from itertools import permutations

    cost = ((reference[:, None] - other[None]) ** 2).sum(2)
    return list(min(permutations(range(len(other))), key=lambda p: (round(float(sum(cost[i, j] for i, j in enumerate(p))), 12), p)))


def full_covariances(components: DataFrame, name: str, weight: str, matrix: list[list[str]]) -> DataFrame:
    """(family, component, i, j, value): each component's covariance as a full matrix under the four families.

    full: as given. tied: the mean of all by weight. diag: nought off the diagonal. spherical: the mean of the diagonal on it.
    """
    d = len(matrix)
    cells = [(i, j) for i in range(d) for j in range(d)]
    total = components.agg(F.sum(weight).alias("_w"), *[F.sum(F.col(weight) * F.col(matrix[i][j])).alias(f"_t{i}_{j}") for i, j in cells])
    both = components.join(F.broadcast(total))
    mean = sum((F.col(matrix[i][i]) for i in range(1, d)), F.col(matrix[0][0])) / d
    value = {
        "full": lambda i, j: F.col(matrix[i][j]),
        "tied": lambda i, j: F.col(f"_t{i}_{j}") / F.col("_w"),
        "diag": lambda i, j: F.col(matrix[i][j]) if i == j else F.lit(0.0),
        "spherical": lambda i, j: mean if i == j else F.lit(0.0),
    }
    rows = [F.struct(F.lit(f).alias("family"), F.lit(i).alias("i"), F.lit(j).alias("j"), v(i, j).alias("value")) for f, v in value.items() for i, j in cells]
    return both.select(F.col(name).alias("component"), F.explode(F.array(*rows)).alias("x")).select("x.family", "component", "x.i", "x.j", "x.value")
