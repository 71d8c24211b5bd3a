"""Forecast cases, opportunities, controls and their nulls: filters, counts in scope, degradation, shifts, held-out groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import stats as S


def unambiguous(cases: DataFrame, state: str = "state") -> DataFrame:
    return cases.filter(F.col(state) != "CENSORED")


def eligible(cases: DataFrame, ids: DataFrame | None, key: str, state: str = "state") -> DataFrame:
    """Unambiguous cases, of the verified ids only where such a set is bound (key is their one column)."""
    sure = unambiguous(cases, state)
    return sure if ids is None else sure.join(ids.select(key).distinct(), key, "left_semi")


def aligned(truth: DataFrame, probs: DataFrame, key: str) -> DataFrame:
    """One row: n_truth, n_prob, n_both, aligned (every truth has its probability and the other way round)."""
    both = truth.select(key, F.lit(1).alias("a")).join(probs.select(key, F.lit(1).alias("b")), key, "full")
    n = both.agg(F.count("a").alias("n_truth"), F.count("b").alias("n_prob"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_both"))
    return n.withColumn("aligned", (F.col("n_truth") == F.col("n_both")) & (F.col("n_prob") == F.col("n_both")))


def scoped_count(subset: DataFrame, cases: DataFrame, opportunities: DataFrame, group: str, key: str, scope: str) -> DataFrame:
    """(group, n): opportunities in the scopes of a group's cases that the group is linked to, or that no case is."""
    linked = subset.select(group, scope, key).distinct()
    never = opportunities.join(cases.select(key).distinct(), key, "left_anti").select(scope, key)
    free = subset.select(group, scope).distinct().join(never, scope).select(group, scope, key)
    known = linked.join(opportunities.select(scope, key), [scope, key], "left_semi")
    return known.unionByName(free).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def core_metrics(cases: DataFrame, keys: list[str], truth: str, prob: str, threshold: float) -> DataFrame:
    """(keys, n, brier, auprc, event_recall, false_alarms): false alarms a case."""
    flag, y = F.col(prob) >= threshold, F.col(truth) == 1
    base = cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(prob) - F.col(truth)) ** 2).alias("brier"),
        (F.count(F.when(flag & y, 1)) / F.nullif(F.count(F.when(y, 1)), F.lit(0))).alias("event_recall"),
        (F.count(F.when(flag & ~y, 1)) / F.count(F.lit(1))).alias("false_alarms"),
    )
    area = S.precision_recall(cases, keys, truth, prob).groupBy(*keys).agg(F.sum("step").alias("auprc"))
    return base.join(area, keys)


def degraded(cases: DataFrame, scenarios: list[tuple[str, str]], feed: str, prob: str) -> DataFrame:
    """cases once for each (scenario, feed that fails): what rests on the failing feed falls back to probability 0."""
    wide = cases.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("fails")) for n, f in scenarios])))
    return wide.withColumn("scenario", F.col("_s.scenario")).withColumn(prob, F.when(F.col(feed) == F.col("_s.fails"), 0.0).otherwise(F.col(prob))).drop("_s")


def shift_null(events: DataFrame, labels: DataFrame, unit: str, day: str, label: str, offsets: list[int]) -> DataFrame:
    """One row: observed mean label on event days, n offsets with any label, how many reach it, p = (ge + 1) / (n + 1).

    Offset 0 is the observation. An offset none of whose shifted days has a label is censored, not counted. Events meet
    labels by an equi-join on unit and shifted day.
    """
    moved = events.select(unit, F.explode(F.array(*[F.lit(o) for o in [0, *offsets]])).alias("offset"), F.col(day).alias("_d")).select(unit, "offset", F.date_add("_d", F.col("offset")).alias(day))
    means = moved.join(labels.select(unit, day, label), [unit, day]).groupBy("offset").agg(F.avg(label).alias("m"))
    observed = means.filter("offset = 0").select(F.col("m").alias("observed"))
    joined = means.filter("offset <> 0").join(F.broadcast(observed))
    out = joined.groupBy("observed").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("m") >= F.col("observed"), 1)).alias("ge"))
    return out.withColumn("p", (F.col("ge") + 1) / (F.col("n") + 1))


def leave_one_group_out(rows: DataFrame, group: str, is_event: str, value: str) -> DataFrame:
    """(group, n_events, n_controls, win_rate, verdict): each group's events scored by all other groups' mean and spread.

    The statistics without a group are the totals less its own sums, so no group is paired with another. A win is an event
    whose score is over its group's mean control score; at least 2 events and controls are needed for a verdict.
    """
    x = F.col(value)
    own = rows.groupBy(group).agg(F.count(value).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    everything = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    rest = own.join(F.broadcast(everything)).select(group, (F.col("tn") - F.col("n")).alias("rn"), (F.col("ts") - F.col("s")).alias("rs"), (F.col("tq") - F.col("q")).alias("rq"))
    mean = F.col("rs") / F.col("rn")
    scale = rest.select(group, mean.alias("m"), F.sqrt(F.greatest(F.col("rq") / F.col("rn") - mean * mean, F.lit(0.0))).alias("sd")).filter("sd > 0")
    scored = rows.join(F.broadcast(scale), group).withColumn("z", (x - F.col("m")) / F.col("sd"))
    usual = scored.filter(~F.col(is_event)).groupBy(group).agg(F.avg("z").alias("c"), F.count(F.lit(1)).alias("n_controls"))
    wins = scored.filter(is_event).join(F.broadcast(usual), group).groupBy(group, "n_controls").agg(F.count(F.lit(1)).alias("n_events"), F.avg((F.col("z") > F.col("c")).cast("int")).alias("win_rate"))
    enough = (F.col("n_events") >= 2) & (F.col("n_controls") >= 2)
    return wins.withColumn("verdict", F.when(~enough, "INDETERMINATE").when(F.col("win_rate") > 0.5, "PASS").otherwise("NULL"))


def js_divergence(p: Column, q: Column) -> Column:
    """A cell's part of the Jensen-Shannon divergence (natural logarithm) of two distributions."""
    m = (p + q) / 2
    part = lambda a: F.when(a > 0, a * F.ln(a / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def occupancy_shift(rows: DataFrame, group: str, cell: str) -> DataFrame:
    """(group, js): how far a group's shares of the cells are from everyone's."""
    c = rows.groupBy(group, cell).agg(F.count(F.lit(1)).alias("n"))
    cells = c.groupBy(cell).agg(F.sum("n").alias("an"))
    total = cells.agg(F.sum("an").alias("t"))
    size = c.groupBy(group).agg(F.sum("n").alias("g"))
    grid = size.join(F.broadcast(cells.join(F.broadcast(total))))  # cells are few: classes of a labelling
    full = grid.join(c, [group, cell], "left").withColumn("p", F.coalesce("n", F.lit(0)) / F.col("g")).withColumn("q", F.col("an") / F.col("t"))
    return full.groupBy(group).agg(F.sum(js_divergence(F.col("p"), F.col("q"))).alias("js"))


def transition_counts(rows: DataFrame, unit: str, at: str, state: str) -> DataFrame:
    """(from_state, to_state, n) of neighbouring rows of a unit on consecutive days."""
    after = rows.select(unit, F.date_sub(at, 1).alias(at), F.col(state).alias("to_state"))
    return rows.join(after, [unit, at]).groupBy(F.col(state).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))
