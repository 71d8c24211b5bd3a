"""Mixture refits over folds, calendar blocks, strata and null samples: one weighted expectation-maximisation for all at once.

A replicate is a weighting of the rows. Weights follow from a row's units (its group, day or stratum, as whole numbers) and
the replicate's number, so replicates are never written out: a round is one pass over the rows for every fit that is not yet
settled, and sums of each component are what reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.models import _add, _pass, _uniform, aligned
from panelforge.operators.order import checkpointed, running
from panelforge.operators.resample import replicated, uniform

#: Weights of rows with these units (one row each, one column a unit) in a replicate.
Weigh = Callable[[np.ndarray, int], np.ndarray]

#: Fixed values of the surveyed protocol: rows that a refit needs, limits of divergence, agreement and failures.
LEAST_ROWS, MOST_JS, LEAST_ARI, MOST_FAILURES = 50, 0.35, 0.6, 0.10
#: Groups, strata or days of the calendar at most: each is a number on the driver.
MOST_UNITS = 100_000


def everything(units: np.ndarray, _: int) -> np.ndarray:
    return np.ones(len(units))


def only(units: np.ndarray, replicate: int) -> np.ndarray:
    return (units[:, 0] == replicate).astype(float)


def all_but(units: np.ndarray, replicate: int) -> np.ndarray:
    return (units[:, 0] != replicate).astype(float)


def axis_only(units: np.ndarray, replicate: int) -> np.ndarray:
    """replicate: 1000 times the axis, plus the stratum."""
    return (units[:, replicate // 1000] == replicate % 1000).astype(float)


@dataclass(frozen=True)
class Blocks:
    """Weights of a calendar-block resample: how many of a replicate's blocks cover a day. Blocks start on days that have
    rows and are `length` calendar days long, whatever days are missing in them."""

    days: np.ndarray
    length: int
    seed: int

    def starts(self, replicate: int) -> np.ndarray:
        n = -(-len(self.days) // self.length)
        u = _uniform(np.arange(n), self.seed * 1_000_003 + replicate + 1)
        return np.sort(self.days[(u * len(self.days)).astype(int)])

    def __call__(self, units: np.ndarray, replicate: int) -> np.ndarray:
        at = self.starts(replicate)
        return (np.searchsorted(at, units[:, 0], "right") - np.searchsorted(at, units[:, 0] - self.length, "right")).astype(float)


@dataclass(frozen=True)
class Fit:
    replicate: int
    k: int
    seed: int
    n: float
    mid: np.ndarray
    spread: np.ndarray
    share: np.ndarray | None = None
    means: np.ndarray | None = None
    covs: np.ndarray | None = None
    like: float = -np.inf
    converged: bool = False

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mid) / self.spread

    def densities(self, z: np.ndarray) -> np.ndarray:
        """Log of share times density, of rows in the fit's own scale."""
        out = np.empty((len(z), self.k))
        for i, m in enumerate(self.means):
            low = np.linalg.cholesky(self.covs[i])
            out[:, i] = np.log(self.share[i]) - 0.5 * (np.linalg.solve(low, (z - m).T) ** 2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * z.shape[1] * np.log(2 * np.pi)
        return out

    def labels(self, x: np.ndarray) -> np.ndarray:
        return self.densities(self.scaled(x)).argmax(1)

    def raw_means(self) -> np.ndarray:
        return self.means * self.spread + self.mid

    def bic(self, family: str) -> float:
        d, k = len(self.mid), self.k
        half = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[family]
        return float((k * d + half + k - 1) * np.log(max(self.n, 1)) - 2 * self.like)


def points(df: DataFrame, key: str, units: list[str], features: list[str]) -> DataFrame:
    """(key, x) with the units before the features in x, kept for many passes. Rows with a feature that is missing or not finite are left out."""
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in features]
    rows = df.filter(" AND ".join(f"`{u}` IS NOT NULL" for u in units) if units else "true")
    for ok in finite:
        rows = rows.filter(ok)
    return checkpointed(rows.select(F.col(key).cast("long").alias("key"), F.array(*[F.col(c).cast("double") for c in [*units, *features]]).alias("x")))


def _split(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :m].astype(np.int64), x[:, m:]


def refitted(data: DataFrame, m: int, d: int, jobs: list[tuple[int, int, int]], weigh: Weigh, family: str = "full", rounds: int = 500, tolerance: float = 1e-3, floor: float = 1e-6, starts: dict[tuple[int, int, int], np.ndarray] | None = None) -> list[Fit]:
    """A mixture for each job (replicate, k, seed) over the weighted rows of data (see points; m units, d features).

    Features are standardised by the replicate's own weighted mean and spread. Starts are drawn by k-means++ with hashes of
    row keys (or given, in that scale). A fit converges when its mean log-likelihood gains less than tolerance in a round.
    """
    reps = sorted({r for r, _, _ in jobs})

    def moments(_: np.ndarray, x: np.ndarray) -> np.ndarray:
        units, x = _split(x, m)
        out = []
        for r in reps:
            w = weigh(units, r)
            out.append(np.concatenate([[w.sum()], w @ x, w @ x**2]))
        return np.stack(out)

    scale: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    got = _pass(data, moments, _add)
    for r, row in zip(reps, (np.zeros((len(reps), 1 + 2 * d)) if got is None else got.reshape(len(reps), -1)), strict=True):
        n, mid = row[0], row[1 : 1 + d] / max(row[0], 1)
        spread = np.sqrt(np.maximum(row[1 + d :] / max(n, 1) - mid**2, 0))
        scale[r] = (n, mid, np.where(spread > 1e-12, spread, 1.0))
    fits = [Fit(r, k, s, *scale[r]) for r, k, s in jobs]
    live = [j for j, f in enumerate(fits) if f.n >= max(2, f.k)]
    centres = {j: np.empty((0, d)) for j in live}
    if starts is not None:
        centres = {j: starts[jobs[j]] for j in live}
    for step in range(max((fits[j].k for j in live), default=0) if starts is None else 0):
        now = [j for j in live if fits[j].k > step]

        def drawn(keys: np.ndarray, x: np.ndarray, now: list[int] = now, step: int = step) -> np.ndarray:
            units, x = _split(x, m)
            out, last = np.full((len(now), d + 1), np.inf), None
            for i, j in enumerate(now):
                f = fits[j]
                if last is None or last[0] != f.replicate:
                    w = weigh(units, f.replicate)
                    sel = np.flatnonzero(w)
                    last = (f.replicate, w[sel], sel, f.scaled(x[sel]))
                _, w, sel, z = last
                if not len(sel):
                    continue
                far = w if not step else w * ((z[:, None] - centres[j][None]) ** 2).sum(2).min(1)
                race = np.where(far > 0, -np.log(_uniform(keys[sel], (f.seed * 64 + f.k) * 64 + step)) / np.where(far > 0, far, 1), np.inf)
                at = int(race.argmin())
                out[i] = np.concatenate([[race[at]], z[at]])
            return out

        def least(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
            if a is None:
                return b
            a, b = a.reshape(-1, d + 1), b.reshape(-1, d + 1)
            return np.where(b[:, :1] < a[:, :1], b, a)

        for j, row in zip(now, _pass(data, drawn, least).reshape(-1, d + 1), strict=True):
            # all distances nil: the component starts where the first does
            centres[j] = np.vstack([centres[j], row[1:] if np.isfinite(row).all() else centres[j][:1]])
    for j in live:
        fits[j] = replace(fits[j], means=centres[j])
    width = lambda k: 1 + k * (1 + d + d * d)
    for turn in range(rounds + 1):
        if not live:
            break

        def sums(_: np.ndarray, x: np.ndarray) -> np.ndarray:
            units, x = _split(x, m)
            out, last = [], None
            for j in live:
                f = fits[j]
                if last is None or last[0] != f.replicate:
                    w = weigh(units, f.replicate)
                    sel = np.flatnonzero(w)
                    last = (f.replicate, w[sel], f.scaled(x[sel]))
                _, w, z = last
                if f.covs is None:
                    resp, like = np.eye(f.k)[((z[:, None] - f.means[None]) ** 2).sum(2).argmin(1)], 0.0
                else:
                    dens = f.densities(z)
                    top = dens.max(1, keepdims=True) if len(z) else np.zeros((0, 1))
                    total = top[:, 0] + np.log(np.exp(dens - top).sum(1))
                    resp, like = np.exp(dens - total[:, None]), float(w @ total)
                resp = resp * w[:, None]
                out += [[like], resp.sum(0), (resp.T @ z).ravel(), np.einsum("nk,na,nb->kab", resp, z, z, optimize=True).ravel()]
            return np.concatenate(out)

        got, at, still = _pass(data, sums, _add), 0, []
        for j in live:
            f = fits[j]
            like, size, first, second = np.split(got[at : at + width(f.k)], [1, 1 + f.k, 1 + f.k + f.k * d])
            at += width(f.k)
            gain = float(like[0]) - f.like
            if turn and (not np.isfinite(like[0]) or abs(gain) < tolerance * f.n or turn == rounds):
                ok = bool(np.isfinite(like[0]) and abs(gain) < tolerance * f.n)
                fits[j] = replace(f, like=float(like[0]), converged=ok)
                continue
            size = size + 1e-10
            means = first.reshape(f.k, d) / size[:, None]
            covs = second.reshape(f.k, d, d) / size[:, None, None] - means[:, :, None] * means[:, None, :]
            if family == "tied":
                covs = np.repeat(((covs * size[:, None, None]).sum(0) / size.sum())[None], f.k, 0)
            elif family == "diag":
                covs = covs * np.eye(d)
            elif family == "spherical":
                covs = np.stack([np.eye(d) * np.trace(c) / d for c in covs])
            covs = covs + floor * np.eye(d)
            # a component without rows keeps a wide shape of its own instead of a singular one
            low = np.linalg.eigvalsh(covs)[:, 0] < floor / 2
            covs[low] = np.eye(d)
            fits[j] = replace(f, share=size / size.sum(), means=means, covs=covs, like=float(like[0]) if turn else -np.inf)
            still.append(j)
        live = still
    return fits


def reference(data: DataFrame, m: int, d: int, ks: list[int], seeds: list[int], family: str = "full") -> Fit:
    """The fit of all rows that others are held against: the number of components that most seeds choose by BIC (the smaller on
    ties, in both), of its fits that of least BIC."""
    fits = [f for f in refitted(data, m, d, [(0, k, s) for s in seeds for k in ks], everything, family) if f.converged]
    if not fits:
        raise ValueError("no fit of all rows converged")
    chosen = Counter(min((f for f in fits if f.seed == s), key=lambda f: (f.bic(family), f.k)).k for s in sorted({f.seed for f in fits}))
    modal = min(chosen, key=lambda k: (-chosen[k], k))
    return min((f for f in fits if f.k == modal), key=lambda f: (f.bic(family), f.seed))


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence to base 2."""
    p, q = p / p.sum(), q / q.sum()
    mid = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / mid[a > 0])).sum())
    return (part(p) + part(q)) / 2


def agreement(table: np.ndarray) -> float:
    """Adjusted Rand index of two labellings from their contingency table."""
    pairs = lambda x: float((x * (x - 1) / 2).sum())
    both, a, b, all_ = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(table.sum()[None])
    expected = a * b / all_ if all_ else 0.0
    most = (a + b) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


@dataclass(frozen=True)
class Compared:
    """A fit held against the reference: contingency tables (reference label, aligned label) over the rows it was fitted on,
    by weight, and over the rest, and the mean of the largest posterior."""

    fit: Fit
    order: list[int]
    inside: np.ndarray
    outside: np.ndarray
    posterior: float


def compared(data: DataFrame, m: int, ref: Fit, fits: list[Fit], weigh: Weigh) -> list[Compared]:
    """Every converged fit with as many components as ref, held against it in one pass."""
    orders = [aligned(ref.means, (f.raw_means() - ref.mid) / ref.spread) for f in fits]

    def tables(_: np.ndarray, x: np.ndarray) -> np.ndarray:
        units, x = _split(x, m)
        own, out = ref.labels(x), []
        for f, order in zip(fits, orders, strict=True):
            w = weigh(units, f.replicate)
            dens = f.densities(f.scaled(x))
            label = np.argsort(order)[dens.argmax(1)]
            place = own * ref.k + label
            sure = 1 / np.exp(dens - dens.max(1, keepdims=True)).sum(1) if len(x) else np.zeros(0)
            out += [np.bincount(place, w, ref.k**2), np.bincount(place, (w == 0).astype(float), ref.k**2), [float(w @ sure)]]
        return np.concatenate(out)

    if not fits:
        return []
    rows = _pass(data, tables, _add).reshape(len(fits), -1)
    shaped = lambda v: v.reshape(ref.k, ref.k)
    return [Compared(f, o, shaped(r[: ref.k**2]), shaped(r[ref.k**2 : -1]), float(r[-1] / max(f.n, 1))) for f, o, r in zip(fits, orders, rows, strict=True)]


def numbers(df: DataFrame, column: str) -> list:
    """The distinct values of a declared grouping, in order; an error if they are too many to be one."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_UNITS + 1).collect()
    if len(rows) > MOST_UNITS:
        raise ValueError(f"{column} has more than {MOST_UNITS} values")
    return sorted(r[0] for r in rows)


FOLDS = "fold string, status string, js double, ari double, ari_left_out double, js_left_out double, n_fit long, n_left_out long, failures int"


def _folds(data: DataFrame, m: int, d: int, ref: Fit, named: dict[int, str], seeds: list[int], weigh: Weigh, family: str, left_out: bool) -> list[tuple]:
    """The worst divergence and agreement of every fold over its seeds, with what becomes of it."""
    fits = refitted(data, m, d, [(r, ref.k, s) for r in sorted(named) for s in seeds], weigh, family)
    held = compared(data, m, ref, [f for f in fits if f.converged], weigh)
    whole = (held[0].inside + held[0].outside).sum(1) if held else np.ones(ref.k)  # rows of all data by the reference's labels
    out = []
    for r, name in sorted(named.items()):
        mine, own = [f for f in fits if f.replicate == r], [c for c in held if c.fit.replicate == r]
        n, lost = int(mine[0].n), sum(not f.converged for f in mine)
        rest = int(own[0].outside.sum()) if own else 0
        if n < LEAST_ROWS or (left_out and own and not rest):
            out.append((name, "SKIPPED", None, None, None, None, n, rest, lost))
            continue
        if not own or (lost and not left_out):
            out.append((name, "NONCONVERGED", None, None, None, None, n, rest, lost))
            continue
        js = max(divergence(whole, c.inside.sum(0)) for c in own)
        ari = min(agreement(c.inside) for c in own)
        outer = min(agreement(c.outside) for c in own) if rest else None
        outer_js = max(divergence(c.outside.sum(0), c.inside.sum(0)) for c in own) if rest else None
        good = outer is not None and outer >= LEAST_ARI if left_out else js < MOST_JS
        out.append((name, "PASS" if good else "FAIL", js, ari, outer, outer_js, n, rest, lost))
    return out


def group_refits(df: DataFrame, key: str, group: str, features: list[str], ks: list[int], seeds: list[int], left_out: bool, family: str = "full") -> DataFrame:
    """One row for each group: the mixture refitted without it (left_out) or on it alone, held against the fit of all rows.

    Every seed counts: js (occupancy of the rows fitted against that of all rows by the reference) is the largest, ari (labels
    of the rows fitted against the reference's) the least. Left out: PASS if the refit labels the group's rows like the
    reference (ari_left_out LEAST_ARI or more). Alone: PASS if js is under MOST_JS, NONCONVERGED if a seed fails. Fewer than
    LEAST_ROWS rows: SKIPPED. The groups' names, a declared few, pass through the driver.
    """
    spark, names = df.sparkSession, numbers(df, group)
    place = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{group} {dict(df.dtypes)[group]}, _unit long")
    data, d = points(df.join(F.broadcast(place), group), key, ["_unit"], features), len(features)
    ref = reference(data, 1, d, ks, seeds, family)
    rows = _folds(data, 1, d, ref, {i: str(n) for i, n in enumerate(names)}, seeds, all_but if left_out else only, family, left_out)
    return spark.createDataFrame(rows, FOLDS)


def axis_refits(df: DataFrame, key: str, axes: list[str], features: list[str], ks: list[int], seeds: list[int], family: str = "full") -> DataFrame:
    """group_refits of each stratum alone along several axes (at most 1000 strata each) at once: axis, fold, status, ..."""
    spark, named, joined, units = df.sparkSession, {}, df, []
    for a, axis in enumerate(axes):
        names = numbers(df, axis)
        if len(names) > 1000:
            raise ValueError(f"{axis} has more than 1000 strata")
        named |= {a * 1000 + i: f"{axis}={n}" for i, n in enumerate(names)}
        place = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{axis} {dict(df.dtypes)[axis]}, _unit{a} long")
        joined, units = joined.join(F.broadcast(place), axis), [*units, f"_unit{a}"]
    data, d = points(joined, key, units, features), len(features)
    ref = reference(data, len(axes), d, ks, seeds, family)
    rows = _folds(data, len(axes), d, ref, named, seeds, axis_only, family, False)
    found = spark.createDataFrame(rows, FOLDS)
    return found.select(F.split_part("fold", F.lit("="), F.lit(1)).alias("axis"), F.split_part("fold", F.lit("="), F.lit(2)).alias("stratum"), *[c for c in found.columns if c not in ("fold", "ari_left_out", "js_left_out", "n_left_out")])


def block_refits(df: DataFrame, key: str, day: str, features: list[str], ks: list[int], seeds: list[int], replicates: int, length: int, family: str = "full") -> DataFrame:
    """(parameter, low, high, succeeded, failures, status): 95 % intervals of a mixture's parameters over calendar-block resamples.

    A replicate draws as many blocks of `length` days as the days with rows call for, each from a day that has rows; blocks
    that reach over missing days hold fewer rows. Means are in the features' own units, components aligned to the fit of
    all rows. More than MOST_FAILURES of the replicates without convergence: FAIL. day: a date column.
    """
    spark, d = df.sparkSession, len(features)
    numbered = df.withColumn("_day", F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")))
    data = points(numbered, key, ["_day"], features)
    ref = reference(data, 1, d, ks, seeds, family)
    weigh = Blocks(np.array(numbers(numbered, "_day"), np.int64), length, seeds[0])
    fits = refitted(data, 1, d, [(r, ref.k, seeds[r % len(seeds)]) for r in range(replicates)], weigh, family)
    held = compared(data, 1, ref, [f for f in fits if f.converged], weigh)
    lost = replicates - len(held)
    status = "PASS" if held and lost <= MOST_FAILURES * replicates else "FAIL"
    rows = []
    if held:
        found = {f"weight{i}": [c.fit.share[c.order[i]] for c in held] for i in range(ref.k)}
        found |= {f"mean{i}_{x}": [c.fit.raw_means()[c.order[i], j] for c in held] for i in range(ref.k) for j, x in enumerate(features)}
        found |= {f"occupancy{i}": [c.inside.sum(0)[i] / c.inside.sum() for c in held] for i in range(ref.k)}
        found |= {"posterior": [c.posterior for c in held], "ari": [agreement(c.inside) for c in held]}
        rows = [(name, float(np.percentile(v, 2.5)), float(np.percentile(v, 97.5)), len(held), lost, status) for name, v in found.items()]
    return spark.createDataFrame(rows, "parameter string, low double, high double, succeeded int, failures int, status string")


def matched_null(df: DataFrame, key: str, strata: list[str], features: list[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, key, strata, features): each feature drawn anew, on its own, from the values of the row's stratum.

    What joins features goes, a stratum's margins stay. Values are numbered within strata over range partitions and draws are
    joined by number, so no task holds a stratum. A stratum without a value gives null; missing values are never drawn.
    """
    rows = replicated(df.select(key, *strata), replicates)
    for j, c in enumerate(features):
        pool = running(df.filter(F.col(c).isNotNull()).select(*strata, key, c).withColumn("_one", F.lit(1).cast("long")), strata, [c, key], "_one", "_nth").select(*strata, "_nth", c)
        size = pool.groupBy(*strata).agg(F.max("_nth").alias("_size"))
        drawn = rows.join(size, strata, "left").withColumn("_nth", F.floor(uniform(F.lit(seed), F.lit(j), "replicate", key) * F.col("_size")) + 1).drop("_size")
        rows = drawn.join(pool, [*strata, "_nth"], "left").drop("_nth")
    return rows.select("replicate", key, *strata, *features)


def separations(data: DataFrame, m: int, fits: list[Fit], weigh: Weigh) -> list[float | None]:
    """For each fit the mean over its rows of (b - a) / max(a, b), a and b being the distances to the nearest and second
    nearest component mean in the fit's scale: a silhouette about means, one pass for all. None with one component or label."""

    def sums(_: np.ndarray, x: np.ndarray) -> np.ndarray:
        units, x = _split(x, m)
        out = []
        for f in fits:
            w = weigh(units, f.replicate)
            sel = np.flatnonzero(w)
            z = f.scaled(x[sel])
            if f.k < 2 or not len(sel):
                out.append(np.zeros(2 + f.k))
                continue
            label = f.densities(z).argmax(1)
            far = np.sqrt(((z[:, None] - f.means[None]) ** 2).sum(2))
            a = far[np.arange(len(z)), label]
            far[np.arange(len(z)), label] = np.inf
            b = far.min(1)
            s = (b - a) / np.maximum(np.maximum(a, b), 1e-300)
            out.append(np.concatenate([[float(w[sel] @ s), w[sel].sum()], np.bincount(label, w[sel], f.k)]))
        return np.concatenate(out)

    got, at, out = _pass(data, sums, _add), 0, []
    for f in fits:
        row = got[at : at + 2 + f.k]
        at += 2 + f.k
        out.append(float(row[0] / row[1]) if f.k > 1 and (row[2:] > 0).sum() > 1 else None)
    return out


def null_envelope(df: DataFrame, key: str, strata: list[str], features: list[str], ks: list[int], seeds: list[int], replicates: int, alpha: float = 0.05, family: str = "full") -> DataFrame:
    """One row: the separation of the fit of all rows, the share p of matched nulls that reach it, and whether p < alpha.

    Every null goes through the same choice of components by BIC, with a seed in turn. A null that does not converge, or whose
    separation is undefined, fails the whole: then p is null and the status FAIL.
    """
    spark, d = df.sparkSession, len(features)
    data = points(df, key, [], features)
    ref = reference(data, 0, d, ks, seeds, family)
    observed = separations(data, 0, [ref], everything)[0]
    made = points(matched_null(df, key, strata, features, replicates, seeds[0]), key, ["replicate"], features)
    fits = refitted(made, 1, d, [(r, k, seeds[r % len(seeds)]) for r in range(replicates) for k in ks], only, family)
    best = [min((f for f in fits if f.replicate == r and f.converged), key=lambda f: (f.bic(family), f.k), default=None) for r in range(replicates)]
    found = separations(made, 1, [f for f in best if f is not None], only) if any(best) else []
    good = [s for s in found if s is not None]
    lost = replicates - len(good)
    p = None if lost or observed is None else float(np.mean([s >= observed for s in good]))
    row = (ref.k, observed, replicates, lost, p, min(good, default=None), max(good, default=None), "PASS" if p is not None and p < alpha else "FAIL")
    return spark.createDataFrame([row], "k int, observed double, replicates int, failures int, p double, null_min double, null_max double, status string")


def labelled(df: DataFrame, key: str, units: list[str], features: list[str], fit: Fit) -> DataFrame:
    """(key, label): the component of every row that has all features, by a fit."""
    m, data = len(units), points(df, key, units, features)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)[:, m:]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fit.labels(x).astype(np.int32)) if len(x) else pa.array([], pa.int32())], ["key", "label"])

    return data.mapInArrow(scan, "key long, label int")


def least_bic(df: DataFrame, key: str, features: list[str], ks: list[int], seed: int, family: str = "diag") -> tuple[list[Fit], Fit]:
    """A fit of all rows for each number of components, and the one of least BIC, the smaller number on ties."""
    fits = refitted(points(df, key, [], features), 0, len(features), [(0, k, seed) for k in ks], everything, family)
    good = [f for f in fits if f.converged]
    if not good:
        raise ValueError("no fit converged")
    return fits, min(good, key=lambda f: (f.bic(family), f.k))
