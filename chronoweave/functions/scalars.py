"""Column functions: missing values, flags, clock maps, formats, identifiers."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS, YES_WORDS = ("true",), ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")


def finite(x: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def below(x: Column, limit: float) -> Column:
    """The value, or null above a limit."""
    return F.when(x <= limit, x)


def confident(x: Column, label: Column, accepted=("high", "medium")) -> Column:
    """The value where it is positive and its label is accepted."""
    return F.when((finite(x) > 0) & label.isin(*accepted), x)


def text(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit(""))


def flag(x: Column) -> Column:
    """Three-valued: yes words, no words, else null."""
    word = F.lower(F.trim(x))
    return F.when(word.isin(*YES_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def truthy(x: Column, words=YES_WORDS) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin(*words), F.lit(False))


def number(x: Column) -> Column:
    return finite(x.try_cast("double"))


def number_status(x: Column) -> Column:
    """Why a required number isn't one: missing, not a number or not finite; ready where it is."""
    v = x.try_cast("double")
    return F.when(F.coalesce(F.trim(x.cast("string")), F.lit("")) == "", "missing").when(v.isNull(), "not a number").when(finite(v).isNull(), "not finite").otherwise("ready")


def required(x: Column, label: str) -> Column:
    """The number; a value that isn't a finite number ends the query with an error that names it."""
    return F.when(number(x).isNotNull(), number(x)).otherwise(F.raise_error(F.concat(F.lit(f"{label} has no finite number: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("double"))


def accepted_features(prefix: str, features: list[str], accepted: Column) -> list[Column]:
    """Columns <prefix>_<feature>, null where the detection isn't accepted."""
    return [F.when(accepted, F.col(f)).alias(f"{prefix}_{f}") for f in features]


def identity_text(project: Column, pid: Column, visit: Column, segment: Column) -> Column:
    """project/pid/visit, and the segment where it isn't the main one; empty parts are left out."""
    bare = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.concat_ws("/", bare(project), bare(pid), bare(visit), F.when(F.coalesce(bare(segment), F.lit("main")) != "main", bare(segment)))


def same_name(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def mapped(intercept: Column, scale: Column, t: Column) -> Column:
    return intercept + scale * t


def unmapped(intercept: Column, scale: Column, t: Column) -> Column:
    return F.try_divide(t - intercept, scale)


def composed(outer: tuple[Column, Column], inner: tuple[Column, Column]) -> tuple[Column, Column]:
    """Intercept and scale of outer(inner(t))."""
    return outer[0] + outer[1] * inner[0], outer[1] * inner[1]


def offset_at(intercept: Column, scale: Column, t: Column) -> Column:
    return intercept + (scale - 1) * t


def drift_ppm(scale: Column) -> Column:
    return (scale - 1) * 1e6


def both(kind, a: Column, b: Column) -> Column:
    """greatest or least of two values, null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), kind(a, b))


def bracket(last_old: Column, first_new: Column, origin: Column, num: Column, den: Column) -> tuple[Column, Column]:
    """Midpoint and half-width in seconds of a transition between two frame ticks; integers until the last step."""
    seconds = num.cast("double") / den.cast("double")
    return (last_old + first_new - 2 * origin).cast("double") / 2 * seconds, (first_new - last_old).cast("double") / 2 * seconds


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def aspect_ratio(points: list[tuple[Column, Column]]) -> Column:
    """Openness of an eye from six points: mean of the two heights over the width; null without a width."""
    width = distance(points[0], points[3])
    return F.when(width > 0, (distance(points[1], points[5]) + distance(points[2], points[4])) / (2 * width))


def percent(x: Column) -> Column:
    """One decimal; what is above nothing but below a tenth reads as that."""
    return F.when((x > 0) & (x < 0.1), F.lit("<0.1%")).when(x.isNotNull(), F.format_string("%.1f%%", x))


def clock_text(seconds: Column) -> Column:
    """mm:ss.mmm"""
    ms = F.floor(seconds * 1000 + 0.5).cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000).cast("long"), F.floor((ms % 60000) / 1000).cast("long"), ms % 1000)


def reasons(*parts: Column) -> Column:
    """Non-null reasons in order, each once."""
    return F.concat_ws("; ", F.array_distinct(F.array_compact(F.array(*parts))))


def cascade(*steps: tuple[Column, str], otherwise: str) -> Column:
    first, *rest = steps
    return reduce(lambda out, s: out.when(*s), rest, F.when(*first)).otherwise(otherwise)


def graded(x: Column, limits: list[tuple[float, str]], otherwise: str) -> Column:
    """The first grade whose limit the value does not pass."""
    return cascade(*[(x <= limit, grade) for limit, grade in limits], otherwise=otherwise)


def identity_replaced(name: Column, pid: Column, visit: Column, new: Column) -> Column:
    """pid_visit, then pid, then visit, wherever no letter or digit adjoins, whatever the case."""
    bounded = lambda x: F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), x, F.lit("(?![A-Za-z0-9])"))
    out = F.regexp_replace(name, bounded(F.concat_ws("_", pid, visit)), new)
    return F.regexp_replace(F.regexp_replace(out, bounded(pid), new), bounded(visit), F.lit("V0"))


def shifted_decimal(x: Column, delta: Column) -> Column:
    """A decimal text moved by whole seconds, with the digits it had after the point."""
    places = F.length(F.regexp_extract(x, r"\.(\d*)$", 1))
    moved = x.cast("decimal(28,9)") + delta.cast("decimal(18,0)")
    parts = F.split(moved.cast("string"), r"\.")
    return F.when(places > 0, F.concat(parts[0], F.lit("."), F.substring(parts[1], F.lit(1), places))).otherwise(parts[0])


def to_pixels(share: Column, size: Column) -> Column:
    """A share of a frame in pixels, halves to even."""
    return F.bround(share * size).cast("long")


def decibel(x: Column, baseline: Column) -> Column:
    return F.when((x > 0) & (baseline > 0), 10 * F.log10(x / baseline))


def fifteen_digits(x: Column) -> Column:
    """A number as text with at most 15 significant digits, as C's %.15g has it: correctly rounded, no trailing zeros, an
    exponent where it is below -4 or above 14. Null for null, empty for what isn't finite. Java rounds the shortest
    decimal text a second time, so the digits come from Python, a column at a time."""

    def told(v: pd.Series) -> pd.Series:
        return v.map(lambda f: "" if f != f or f in (float("inf"), float("-inf")) else format(f, ".15g"))

    return F.when(x.isNotNull(), F.pandas_udf(told, "string")(F.coalesce(x.cast("double"), F.lit(0.0))))
