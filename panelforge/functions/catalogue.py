"""Rules on catalogue records, forecast cases and review documents, as Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions import scalars as X

# Fixed values of catalogue tables.
NOT_GIVEN = ("NA", "")
COARSE_PRECISION = ("month", "season", "year", "unresolved")
COARSE_HORIZONS = (0, 30)
DOMAIN_STATUS = ("MATCHES_RANKED_ARRAY_CANONICAL", "HISTORICAL_ORPHAN_UNKNOWN_DOMAIN", "MISSING")
OBSERVED = ("AVAILABLE", "FULL")
ERA_BOUNDARY_YEAR = 2013


def finite(x: Column) -> Column:
    """x, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def impact_locations(points: Column, lat: Column, lon: Column) -> Column:
    """The explicit coordinates of a record within the globe's ranges; a lone pair counts where no list is given."""
    lone = F.when(lat.isNotNull() & lon.isNotNull(), F.array(F.struct(lat.alias("lat"), lon.alias("lon")))).otherwise(F.array().cast("array<struct<lat: double, lon: double>>"))
    return F.filter(F.when(F.size(points) > 0, points).otherwise(lone), lambda p: finite(p["lat"]).between(-90, 90) & finite(p["lon"]).between(-180, 180))


def given(text: Column) -> Column:
    """Null where a catalogue cell says nothing."""
    return F.when(~text.isin(*NOT_GIVEN), text)


def timing_interval(year_exact: Column, year_approx: Column, month: Column, day: Column) -> dict[str, Column]:
    """start, end (dates, the end exclusive), precision, and the reason if there is none.

    A day is an interval of one day; a month one of its length, an "interval" up to 30 days; a year one of a year.
    """
    written = F.coalesce(given(year_exact), given(year_approx))
    year = F.when(written.rlike(r"^\s*[+-]?\d{1,4}\s*$"), F.trim(written).try_cast("int"))
    m, d = given(month), given(day)
    at = lambda mm, dd: F.try_make_timestamp(year, mm, dd, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    precise = m.isNotNull() & d.isNotNull()
    start = F.when(precise, at(m.try_cast("int"), d.try_cast("int"))).when(m.isNotNull(), at(m.try_cast("int"), F.lit(1))).otherwise(at(F.lit(1), F.lit(1)))
    end = F.when(precise, F.date_add(start, 1)).when(m.isNotNull(), F.add_months(start, 1)).otherwise(F.add_months(start, 12))
    precision = F.when(precise, "day").when(m.isNotNull(), F.when(F.datediff(end, start) <= 30, "interval").otherwise("month")).otherwise("year")
    reason = F.when(written.isNull(), "unresolved_timing").when(year.isNull(), "unparseable_year").when(start.isNull(), "unparseable_date")
    return {"start": start, "end": end, "precision": F.when(start.isNotNull(), precision), "reason": reason}


def lookback_days(horizon: Column) -> Column:
    """Days of a horizon like "3d"; an error for anything else."""
    days = F.regexp_extract(horizon, r"^(\d+)d$", 1)
    return F.when(F.coalesce(days, F.lit("")) != "", days.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a day horizon: "), F.coalesce(horizon, F.lit("null")))).cast("int"))


def horizon_admissible(precision: Column, width_days: Column, lookback: Column) -> Column:
    """Coarse events take horizons 0 and 30 only, intervals those that hold them, precise events all."""
    return F.when(precision.isin(*COARSE_PRECISION), lookback.isin(*COARSE_HORIZONS)).when(precision == "interval", F.coalesce(width_days, F.lit(0)) <= lookback).otherwise(F.lit(True))


def domain_status(declared: Column, canonical: Column) -> Column:
    same, orphan, missing = DOMAIN_STATUS
    return F.when(declared.isNull(), missing).when(declared == canonical, same).otherwise(orphan)


def observability_reasons(volume: Column, least: Column, coverage: Column, available: Column, needed: Sequence[str], day: Column) -> Column:
    """Sorted reasons why an event was not observable; none if its volume, coverage and features all were.

    available: map of a feature to the date it is there from. day: the event's earliest date.
    """
    unknown, late = "FEATURE_AVAILABILITY_UNKNOWN:", "FEATURE_NOT_AVAILABLE_AS_OF_EVENT:"
    reasons = [
        F.when(least.isNotNull() & ~F.coalesce(finite(volume) >= least, F.lit(False)), "BELOW_MIN_DETECTABLE_SIZE"),
        F.when(~F.coalesce(coverage, F.lit("UNKNOWN")).isin(*OBSERVED), F.concat(F.lit("OBSERVATION_NOT_ADEQUATE:"), F.coalesce(coverage, F.lit("UNKNOWN")))),
        F.when(day.isNull(), "EVENT_DATE_UNRESOLVED"),
    ]
    for f in needed:
        since = F.try_element_at(available, F.lit(f))
        reasons.append(F.when(since.isNull(), unknown + f).when(since > day, late + f))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))


def case_problems(opportunity: Column, source: Column, cutoff: Column, issue: Column) -> Column:
    """What a forecast case lacks: its opportunity, its outcome source, a strict UTC cutoff no later than the issue."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    at, made = X.strict_utc(cutoff), X.strict_utc(issue)
    return F.array_compact(F.array(F.when(blank(opportunity), "opportunity"), F.when(blank(source), "source"), F.when(at.isNull(), "cutoff").when(at > made, "postdates")))


def edge_channels(one_to_one: Column, iou: Column, from_part: Column, to_part: Column, iou_min: float, from_min: float, contained: float, ratio_max: float) -> dict[str, Column]:
    """Whether an overlap passes strictly, or by containment of one in the other at similar areas; and the areas' ratio."""
    both = finite(from_part).isNotNull() & finite(to_part).isNotNull() & (from_part > 0) & (to_part > 0)
    ratio = F.when(both, F.greatest(from_part / to_part, to_part / from_part))
    yes = lambda c: F.coalesce(one_to_one & c, F.lit(False))
    return {"strict": yes((iou >= iou_min) & (from_part >= from_min)), "containment": yes((F.greatest(from_part, to_part) >= contained) & (ratio <= ratio_max)), "ratio": ratio}


def implied_area(shared: Column, part: Column) -> Column:
    return F.when(part > 0, shared / part)


def triple_gate(mean: Column, low: Column, p: Column) -> Column:
    return F.when(F.coalesce((mean > 0) & (low > 0) & (p < 0.05), F.lit(False)), "PASS").otherwise("NULL")


def support_fraction(scenes: Column, hits: Column) -> Column:
    """hits / scenes; null where the two are no count of a part and its whole."""
    return F.when((scenes > 0) & (hits >= 0) & (hits <= scenes), hits / scenes.cast("double"))


def first_named(*texts: Column) -> Column:
    """The first text that is not empty; UNSPECIFIED if there is none."""
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit("UNSPECIFIED"))


def finite_or_token(x: Column) -> Column:
    """A number as text with 6 decimals, NaN and infinities by name."""
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").otherwise(F.format_string("%.6f", x))


def reordered(values: Column, order: Column) -> Column:
    """values[order[0]], values[order[1]], ...; places count from 0."""
    return F.transform(order, lambda i: F.try_element_at(values, i.cast("int") + 1))


def cell_pair(text: Column) -> Column:
    """[lat, lon] of "[lat, lon]" or {"lat": .., "lon": ..}; null for anything else."""
    pair = F.from_json(text, "array<double>")
    return F.coalesce(F.when(F.size(pair) == 2, pair), F.filter(F.array(F.get_json_object(text, "$.lat").try_cast("double"), F.get_json_object(text, "$.lon").try_cast("double")), lambda x: x.isNotNull()))


def observed_season(start: Column, end: Column) -> Column:
    """Season of an interval's midpoint; null where an end is."""
    middle = F.timestamp_seconds((F.unix_seconds(start) + F.unix_seconds(end)) / 2)
    return F.when(start.isNotNull() & end.isNotNull(), X.season(middle))


def target_state(bounds_ok: Column, foreign_or_invalid: Column, certain_hit: Column, possible_hit: Column, adequate: Column) -> Column:
    """POSITIVE, NEGATIVE or CENSORED of a window: a doubtful label censors it before anything else is asked."""
    return F.when(~F.coalesce(bounds_ok, F.lit(False)) | F.coalesce(foreign_or_invalid, F.lit(False)), "CENSORED").when(F.coalesce(certain_hit, F.lit(False)), "POSITIVE").when(F.coalesce(possible_hit, F.lit(False)) | ~F.coalesce(adequate, F.lit(False)), "CENSORED").otherwise("NEGATIVE")
