"""Scalar rules as Column functions: dates, identifiers, classes, physical derivations, rule lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kelvin_to_celsius(t: Column) -> Column:
    return t - 273.15


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    return F.atan2(v, u)


def relative_humidity(t: Column, dew: Column) -> Column:
    """Percent, by the Magnus form, between 0 and 100; both temperatures in degrees Celsius."""
    gamma = lambda x: 17.625 * x / (243.04 + x)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.exp(gamma(dew) - gamma(t))))


def positive_part(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def freezing_height(elevation: Column, t: Column) -> Column:
    return elevation + t / 0.0065


def season(day: Column) -> Column:
    m = F.month(day)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def is_winter(day: Column) -> Column:
    return (F.month(day) >= 11) | (F.month(day) <= 4)


def year_block(year: Column, size: int = 5) -> Column:
    first = (F.floor(year / size) * size).cast("int")
    return F.concat(first.cast("string"), F.lit("-"), (first + size - 1).cast("string"))


def strict_utc(text: Column) -> Column:
    """A timestamp of text like 2020-01-02T03:04:05Z or +00:00; null for anything else."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)$")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"(Z|\+00:00)$", ""), "T", " ")))


def bound_date(text: Column) -> Column:
    """A date of ISO text, or of d/m/y text if d is over 12 and so cannot be a month; null otherwise."""
    part = lambda i: F.try_to_number(F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i), F.lit("9999")).cast("int")
    slashed = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$") & (part(1) > 12), F.try_make_timestamp(part(3), part(2), part(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text).cast("date")).otherwise(slashed)


def precision_class(seconds: Column) -> Column:
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "unresolved").when(seconds <= 3600, "exact_hour").when(seconds <= 86400, "day").when(seconds <= 7 * 86400, "week").when(seconds <= 31 * 86400, "month").otherwise("coarse")


# Texts that stand for nothing.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "unknown", "no information", "no_information", "not available", "unnamed", "unnamed glacier", "unidentified", "not identified", "no name")


def meaningful(text: Column) -> Column:
    """Trimmed text, empty if it is a placeholder or null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(t).isin(*PLACEHOLDERS), "").otherwise(t)


def slug(text: Column, most: int = 48) -> Column:
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_")
    return F.left(F.regexp_replace(flat, "^_+|_+$", ""), F.lit(most))


def stable_id(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined.cast("binary"), 256), 1, 12))


def split_list(text: Column, mark: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), mark), lambda x: F.trim(x)), lambda x: x != "")


def volume_bounds(low: Column, high: Column, total: Column, factor: float) -> tuple[Column, Column]:
    """Smaller and larger bound, each falling back on the other and then the total, times a unit factor."""
    a, b = F.coalesce(low, high, total), F.coalesce(high, low, total)
    return F.least(a, b) * factor, F.greatest(a, b) * factor


def decimals(x: Column) -> Column:
    return F.length(F.regexp_extract(x.cast("string"), r"\.(\d*?)0*$", 1))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def geometric_mean(*values: Column) -> Column:
    """Of the positive finite values; null if there is none."""
    ok = [v.isNotNull() & (v > 0) & (v < float("inf")) for v in values]
    total = sum((F.when(o, F.ln(v)).otherwise(0.0) for o, v in zip(ok, values, strict=True)), F.lit(0.0))
    n = sum((o.cast("int") for o in ok), F.lit(0))
    return F.when(n > 0, F.exp(total / n))


def problems(*rules: tuple[Column, str]) -> Column:
    """The messages of the rules whose condition holds, in order; a null condition counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(msg)) for cond, msg in rules]))


def cell_id(x: Column, y: Column, size: float, origin: tuple[float, float]) -> Column:
    col, row = F.floor((x - origin[0]) / size), F.floor((y - origin[1]) / size)
    return F.format_string("r%05dc%05d", row.cast("int"), col.cast("int"))
