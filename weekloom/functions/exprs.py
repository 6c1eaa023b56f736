"""Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clamp that keeps null and NaN (greatest and least would skip them)."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x)))


def momentum(now: Column, before: Column) -> Column:
    """Relative change of a signed value, within -1 and 1."""
    return clip((now - before) / (F.abs(before) + EPS), -1, 1)


def heat(now: Column, before: Column) -> Column:
    """Relative change of a count, within -1 and 1."""
    return clip(((now - before) / (before + 1)).cast("double"), -1, 1)


def week_start(d: Column) -> Column:
    """Monday of a date or timestamp, as a date."""
    return F.date_trunc("week", d).cast("date")


def period_start(d: Column, freq: str) -> Column:
    if freq not in ("week", "day"):
        raise ValueError(f"freq is week or day, not {freq}")
    return F.date_trunc(freq, d).cast("date")


def date_key(d: Column) -> Column:
    """YYYYMMDD as an int."""
    return F.date_format(d, "yyyyMMdd").cast("int")


def from_date_key(k: Column) -> Column:
    return F.to_date(k.cast("string"), "yyyyMMdd")


def direction(m: Column, threshold: float = 0.1) -> Column:
    return F.when(m > threshold, 1).when(m < -threshold, -1).otherwise(0)


def status(r: Column) -> Column:
    """PROFIT above zero, else LOSS."""
    return F.when(r > 0, "PROFIT").otherwise("LOSS")


def softmax(z: Column) -> Column:
    """Of an array, shifted by its maximum."""
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(z: Column) -> Column:
    """Position (from 0) of the first maximum."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def confidence(z: Column) -> Column:
    """Softmax probability of the maximum."""
    return F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(z)))


def label_at(labels: Column, position: Column) -> Column:
    """The label at a position, the last one if the position is beyond it."""
    return F.element_at(labels, F.least(position, F.size(labels) - 1) + 1)


def round_half_even(x: Column, places: int = 4) -> Column:
    return F.bround(x, places)


def strict_map(x: Column, values: dict, strict: bool = True) -> Column:
    """Mapped value; an unknown one raises, or is null if not ``strict``. Null stays null."""
    known = reduce(lambda acc, kv: acc.when(x == kv[0], F.lit(kv[1])), values.items(), F.when(x.isNull(), F.lit(None)))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown value: "), x.cast("string")))) if strict else known


def strict_double(x: Column) -> Column:
    """A number's text as a double; other text raises, null stays null. NaN and infinities are numbers."""
    return F.when(x.isNull(), None).otherwise(F.coalesce(x.try_cast("double"), F.raise_error(F.concat(F.lit("not a number: "), x.cast("string"))).cast("double")))


def strict_timestamp(x: Column, pattern: str | None = None) -> Column:
    """Text as a timestamp without zone, in ISO form or by a pattern; other text raises, null stays null."""
    found = x.try_cast("timestamp_ntz") if pattern is None else F.try_to_timestamp(x, F.lit(pattern)).cast("timestamp_ntz")
    return F.when(x.isNull(), None).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("not a time: "), x)).cast("timestamp_ntz")))


def percent(x: Column, places: int = 2) -> Column:
    """A share as text, such as 12.34%."""
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f%%", x * 100))


def z_safe(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def iterations(n: Column, base: int) -> Column:
    """Fewer training rounds for larger classes."""
    return F.when(n > 1500, F.greatest(F.lit(5), F.lit(base // 3))).when(n > 800, F.greatest(F.lit(5), F.lit(base // 2))).otherwise(F.lit(base))
