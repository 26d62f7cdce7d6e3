"""Column helpers with the panel's missing-value semantics (missing = NULL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """A column name for SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def flag(condition: Column) -> Column:
    """A comparison with a missing side is false."""
    return F.coalesce(condition, F.lit(False))


def differs(left: Column, right: Column) -> Column:
    """``left != right`` where a missing side (even both) counts as different."""
    return ~flag(left == right)


def as_double(condition: Column) -> Column:
    return flag(condition).cast("double")


def as_flag(condition: Column) -> Column:
    return flag(condition).cast("tinyint")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL where the denominator is exactly 0 or missing."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def ratio_tiny(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL where the denominator is within 1e-12 of 0."""
    d = col(denominator).cast("double")
    return F.when(F.abs(d) > TINY, col(numerator).cast("double") / d)


def ratio_present(numerator: Column | str, denominator: Column | str) -> Column:
    """Ratio kept only where the denominator is present and not 0."""
    d = col(denominator).cast("double")
    return F.when(d.isNotNull() & (d != 0), col(numerator).cast("double") / d)


def log_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """ln(n/d), NULL unless both are positive."""
    n, d = col(numerator), col(denominator)
    return F.when((n > 0) & (d > 0), F.log(n / d))


def to_number(c: Column | str) -> Column:
    return col(c).try_cast("double")


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps NULL (``greatest``/``least`` alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def first_text(*candidates: Column | str) -> Column:
    """First candidate that is not blank after trimming."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in candidates])


def snake_case(c: Column | str) -> Column:
    """CamelCase to snake_case."""
    return F.lower(F.regexp_replace(col(c), "(?<=[a-z0-9])([A-Z])", "_$1"))


def piecewise_linear(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation through sorted knots, clamped at both ends.

    The knots sit in one literal array each; the segment is found by a binary-search-free
    count of knots below x, so the expression stays small for any number of knots.
    """
    if not xs:
        return F.when(x.isNotNull(), F.lit(0.0))
    kx = F.array(*[F.lit(float(v)) for v in xs])
    ky = F.array(*[F.lit(float(v)) for v in ys])
    below = F.size(F.filter(kx, lambda v: v <= x))
    at = F.least(F.greatest(below, F.lit(1)), F.lit(max(len(xs) - 1, 1)))
    x0, y0 = F.element_at(kx, at), F.element_at(ky, at)
    if len(xs) == 1:
        return F.when(x.isNotNull(), F.lit(float(ys[0])))
    x1, y1 = F.element_at(kx, at + 1), F.element_at(ky, at + 1)
    inner = y0 + (y1 - y0) * F.try_divide(x - x0, x1 - x0)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).when(x >= xs[-1], F.lit(float(ys[-1]))).when(
        x.isNotNull(), F.coalesce(inner, y0))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
