"""Whether clusters come back: k-means of many resamples at once, matched to the clusters of all rows by contingency counts."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.models import _add, _pass, _squares, _uniform
from panelforge.operators.order import checkpointed, quantiles, running
from panelforge.operators.resample import replicated, uniform

#: Fixed values of the surveyed design: mean overlap of a stable cluster, share of resamples that choose the same number.
LEAST_JACCARD, LEAST_SHARE = 0.75, 0.80


def subsamples(df: DataFrame, key: str, stratum: str, resamples: int, fraction: float, seed: int) -> DataFrame:
    """(key, replicate): of each stratum the rows of least hash, as many as fraction of it, rounded up. Rows are numbered over range partitions."""
    wide = replicated(df.select(key, stratum), resamples).withColumn("_u", uniform(F.lit(seed), "replicate", key)).withColumn("_one", F.lit(1).cast("long"))
    nth = running(wide, ["replicate", stratum], ["_u", key], "_one", "_nth")
    size = df.groupBy(stratum).agg(F.ceil(F.count(F.lit(1)) * fraction - 1e-9).alias("_size"))
    return nth.join(size, stratum).filter(F.col("_nth") <= F.col("_size")).select(key, "replicate")


def _scales(rows: DataFrame, members: DataFrame, key: str, features: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and interquartile range (1 where nought) of each feature in each replicate; the last are those of all rows."""
    mid, spread = np.zeros((n + 1, len(features))), np.ones((n + 1, len(features)))
    every = members.unionByName(rows.select(key, F.lit(n).alias("replicate")))
    for j, c in enumerate(features):
        for r in quantiles(every.join(rows.select(key, c), key), ["replicate"], c, [0.25, 0.5, 0.75]).collect():
            mid[r["replicate"], j] = r["q"][1]
            spread[r["replicate"], j] = r["q"][2] - r["q"][0] if r["q"][2] > r["q"][0] else 1.0
    return mid, spread


class Scales:
    """How rows x, which begin with a flag for each replicate, look in one: its rows, scaled its way. The last replicate has all rows."""

    def __init__(self, n: int, mid: np.ndarray, spread: np.ndarray) -> None:
        self.n, self.mid, self.spread, self.d = n, mid, spread, mid.shape[1]

    def rows(self, x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        sel = np.flatnonzero(x[:, r]) if r < self.n else np.arange(len(x))
        return sel, (x[sel, self.n :] - self.mid[r]) / self.spread[r]


class Resampled:
    """Points (key, x) with the scales of their replicates."""

    def __init__(self, data: DataFrame, scales: Scales) -> None:
        self.data, self.scales, self.n, self.d = data, scales, scales.n, scales.d

    def starts(self, jobs: list[tuple[int, int, int]], seed: int) -> list[np.ndarray]:
        """The first centres of each job (replicate, k, start) by k-means++: one pass draws the next centre of all."""
        centres = [np.empty((0, self.d)) for _ in jobs]
        me = self.scales
        for step in range(max(k for _, k, _ in jobs)):
            now = [j for j, (_, k, _) in enumerate(jobs) if k > step]

            def drawn(keys: np.ndarray, x: np.ndarray, now: list[int] = now, step: int = step) -> np.ndarray:
                out, last = np.full((len(now), me.d + 1), np.inf), None
                for i, j in enumerate(now):
                    r, k, s = jobs[j]
                    if last is None or last[0] != r:
                        sel, z = me.rows(x, r)
                        last = (r, sel, z)
                    _, sel, z = last
                    if not len(sel):
                        continue
                    far = _squares(z, centres[j]).min(1) if step else np.ones(len(z))
                    race = np.where(far > 0, -np.log(_uniform(keys[sel], ((seed * 1009 + r) * 64 + s * 8 + k) * 64 + step)) / np.where(far > 0, far, 1), np.inf)
                    at = int(race.argmin())
                    out[i] = np.concatenate([[race[at]], z[at]])
                return out

            def least(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
                if a is None:
                    return b
                a, b = a.reshape(-1, me.d + 1), b.reshape(-1, me.d + 1)
                return np.where(b[:, :1] < a[:, :1], b, a)

            for j, row in zip(now, _pass(self.data, drawn, least).reshape(-1, self.d + 1), strict=True):
                centres[j] = np.vstack([centres[j], row[1:] if np.isfinite(row).all() else centres[j][:1]])
        return centres

    def fits(self, ks: list[int], starts: int, seed: int, rounds: int = 100) -> dict[tuple[int, int], np.ndarray]:
        """The centres of least inertia for each (replicate, k) among the starts, all moved together, a round a pass."""
        jobs = [(r, k, s) for r in range(self.n + 1) for k in ks for s in range(starts)]
        centres, inertia, live, me = self.starts(jobs, seed), [np.inf] * len(jobs), list(range(len(jobs))), self.scales
        for turn in range(rounds + 1):
            if not live:
                break

            def sums(_: np.ndarray, x: np.ndarray) -> np.ndarray:
                out, at = [], 0
                while at < len(live):
                    r = jobs[live[at]][0]
                    mine = [j for j in live[at : at + len(ks) * starts] if jobs[j][0] == r]
                    at += len(mine)
                    _, z = me.rows(x, r)
                    square, left = _squares(z, np.vstack([centres[j] for j in mine])), 0
                    for j in mine:
                        part = square[:, left : left + jobs[j][1]]
                        left += jobs[j][1]
                        own = np.eye(jobs[j][1])[part.argmin(1)]
                        out += [[part.min(1).sum()], own.sum(0), (own.T @ z).ravel()]
                return np.concatenate(out)

            got, at, still = _pass(self.data, sums, _add), 0, []
            for j in live:
                k = jobs[j][1]
                cost, size, total = np.split(got[at : at + 1 + k * (1 + self.d)], [1, 1 + k])
                at += 1 + k * (1 + self.d)
                new = np.where(size[:, None] > 0, total.reshape(k, self.d) / np.maximum(size, 1)[:, None], centres[j])
                inertia[j] = float(cost[0])
                if turn < rounds and not np.allclose(new, centres[j]):
                    centres[j] = new
                    still.append(j)
            live = still
        best: dict[tuple[int, int], int] = {}
        for j, (r, k, _) in enumerate(jobs):
            if (r, k) not in best or inertia[j] < inertia[best[r, k]]:
                best[r, k] = j
        return {rk: centres[j] for rk, j in best.items()}

    def chosen(self, fits: dict[tuple[int, int], np.ndarray]) -> dict[int, tuple[int, float]]:
        """For each replicate the k of largest separation (the smaller on ties) and that: the mean over rows of (b - a) / max(a, b),
        a and b being the distances to the nearest and the second nearest centre."""
        order, me = sorted(fits), self.scales

        def sums(_: np.ndarray, x: np.ndarray) -> np.ndarray:
            out = []
            for r, k in order:
                far = np.sqrt(np.sort(_squares(me.rows(x, r)[1], fits[r, k]), axis=1))
                out += [float(((far[:, 1] - far[:, 0]) / np.maximum(far[:, 1], 1e-300)).sum()), len(far)]
            return np.array(out)

        got = _pass(self.data, sums, _add).reshape(-1, 2)
        score = {rk: s / max(n, 1) for rk, (s, n) in zip(order, got, strict=True)}
        return {r: max(((k, score[r, k]) for q, k in order if q == r), key=lambda x: (x[1], -x[0])) for r in range(self.n + 1)}

    def tables(self, full: np.ndarray, samples: list[np.ndarray]) -> list[np.ndarray]:
        """Of each resample its rows by cluster of all rows and by its own cluster."""
        me = self.scales

        def sums(_: np.ndarray, x: np.ndarray) -> np.ndarray:
            whole = _squares(me.rows(x, me.n)[1], full).argmin(1)
            out = []
            for r, c in enumerate(samples):
                sel, z = me.rows(x, r)
                out.append(np.bincount(whole[sel] * len(c) + _squares(z, c).argmin(1), minlength=len(full) * len(c)) if len(sel) else np.zeros(len(full) * len(c)))
            return np.concatenate(out).astype(float)

        got, at, out = _pass(self.data, sums, _add), 0, []
        for c in samples:
            out.append(got[at : at + len(full) * len(c)].reshape(len(full), len(c)))
            at += len(full) * len(c)
        return out


def best_matches(table: np.ndarray) -> np.ndarray:
    """For each row of a contingency table the largest Jaccard overlap with any column; 0 for an empty row."""
    union = table.sum(1)[:, None] + table.sum(0)[None] - table
    return np.where(table.sum(1) > 0, (table / np.maximum(union, 1)).max(1), 0.0)


def cluster_stability(df: DataFrame, key: str, stratum: str, features: list[str], ks: list[int], resamples: int, fraction: float, seed: int, starts: int = 10) -> DataFrame:
    """One row for each cluster of all rows: members, mean, least and largest best-match overlap over the resamples, with the
    number of clusters, the share of resamples that choose it, the separation, and whether all three criteria hold.

    Rows without all features are left out; features are scaled by median and interquartile range, in each resample by its
    own. Members of clusters never leave the executors: overlaps come from counts. What reaches the driver are centres and counts.
    """
    rows = df.select(key, stratum, *features).filter(" AND ".join(f"`{c}` IS NOT NULL AND abs(`{c}`) < double('infinity')" for c in features))
    members = checkpointed(subsamples(rows, key, stratum, resamples, fraction, seed))
    mid, spread = _scales(rows, members, key, features, resamples)
    flags = members.groupBy(key).agg(F.collect_set("replicate").alias("_in"))
    vector = F.concat(F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda r: F.array_contains("_in", r).cast("double")), F.array(*[F.col(c).cast("double") for c in features]))
    held = rows.join(flags, key, "left").withColumn("_in", F.coalesce("_in", F.array().cast("array<int>")))
    data = Resampled(checkpointed(held.select(F.col(key).cast("long").alias("key"), vector.alias("x"))), Scales(resamples, mid, spread))
    fits = data.fits(ks, starts, seed)
    chosen = data.chosen(fits)
    k, separation = chosen[resamples]
    full = fits[resamples, k]
    tables = data.tables(full, [fits[r, chosen[r][0]] for r in range(resamples)])
    overlap = np.array([best_matches(t) for t in tables])
    share = Counter(chosen[r][0] for r in range(resamples))[k] / resamples
    scales = data.scales
    counts = _pass(data.data, lambda _, x: np.bincount(_squares(scales.rows(x, scales.n)[1], full).argmin(1), minlength=k).astype(float), _add)
    mean = overlap.mean(0)
    stable = bool(separation > 0 and share >= LEAST_SHARE and (mean >= LEAST_JACCARD).all())
    told = [(c, int(counts[c]), float(mean[c]), float(overlap[:, c].min()), float(overlap[:, c].max()), k, share, float(separation), stable) for c in range(k)]
    return df.sparkSession.createDataFrame(told, "cluster int, members long, mean_jaccard double, least_jaccard double, largest_jaccard double, k int, k_share double, separation double, stable boolean")
