"""Column functions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.schema import MISSING


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(x: Column) -> Column:
    """``x`` as a finite double, null where it is none."""
    return finite(x.try_cast("double"))


def epoch(x: Column) -> Column:
    """Seconds since 1970 of a timestamp or timestamp text, null where it is none."""
    return F.unix_micros(x.try_cast("timestamp")) / 1e6


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero or null denominator."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def log1p_floor(x: Column) -> Column:
    """ln(1 + max(x, 0)), null for null."""
    return F.log1p(F.when(x < 0, 0.0).otherwise(x))


def at_least(x: Column, low: float) -> Column:
    """max(x, low), null for null (``greatest`` would skip the null)."""
    return F.when(x < low, F.lit(low)).otherwise(x)


def row_min(*x: Column) -> Column:
    return F.least(*x) if len(x) > 1 else x[0]


def row_max(*x: Column) -> Column:
    return F.greatest(*x) if len(x) > 1 else x[0]


def row_sum(*x: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in x])


def composite(*x: Column) -> Column:
    """Key parts joined by the unit separator, a null as a name of its own."""
    return F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit(MISSING)) for c in x])


def identifier_number(x: Column) -> Column:
    """The first run of digits of an identifier, null if it has none."""
    return F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).try_cast("double")


def host_count(hosts: Column) -> Column:
    """Hosts named in a ``{a,b,c}`` list; null for a null or empty list."""
    bare = F.regexp_replace(hosts, r"^[{}]+|[{}]+$", "")
    return F.when(F.length(hosts) > 0, (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).cast("double"))


def timelimit_bucket(limit: Column) -> Column:
    """ln(1 + limit) to one decimal (half to even) as text, ``na`` for null."""
    return F.when(limit.isNull(), "na").otherwise(F.format_string("%.1f", F.bround(log1p_floor(limit), 1)))


def is_positive(exitcode: Column, outcomes: tuple[str, ...]) -> Column:
    """1 for a failing outcome in any case, else 0; null is 0."""
    return F.coalesce(F.upper(exitcode).isin(*outcomes), F.lit(False)).cast("int")
