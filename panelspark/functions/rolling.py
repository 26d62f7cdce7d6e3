"""Row-count windows inside one ticker, with a minimum count of non-missing values.

All functions return a Column over the same partition and order, so one ``select`` of any
number of them costs one sort per ticker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.contract import DATE, TICKER
from panelspark.functions.scalar import col, ratio


# A spec is a handful of calls to the JVM and the families ask for the same few a thousand times, so specs are kept per JVM.
@lru_cache(maxsize=256)
def _ticker_window(by: tuple[str, ...], order: tuple[str, ...], gateway) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


@lru_cache(maxsize=1024)
def _last_rows(n: int, end: int, gateway) -> WindowSpec:
    return ticker_window().rowsBetween(end - n + 1, end)


def ticker_window(by: tuple[str, ...] = (TICKER,), order: tuple[str, ...] = (DATE,)) -> WindowSpec:
    return _ticker_window(by, order, SparkContext._gateway)


def last_rows(n: int, end: int = 0) -> WindowSpec:
    """Frame of ``n`` rows that ends ``end`` rows from the current one (0 = current row)."""
    return _last_rows(n, end, SparkContext._gateway)


def lag(c: Column | str, k: int = 1) -> Column:
    return F.lag(col(c), k).over(ticker_window())


def lead(c: Column | str, k: int = 1) -> Column:
    return F.lead(col(c), k).over(ticker_window())


def diff(c: Column | str, k: int = 1) -> Column:
    return col(c) - lag(c, k)


def pct_change(c: Column | str, k: int = 1) -> Column:
    return ratio(c, lag(c, k)) - 1.0


def rolling(aggregate: Callable[[Column], Column], c: Column | str, n: int,
            min_periods: int | None = None, end: int = 0) -> Column:
    w = last_rows(n, end)
    return F.when(F.count(col(c)).over(w) >= (n if min_periods is None else min_periods),
                  aggregate(col(c)).over(w))


def mean(c, n, min_periods=None, end=0):
    return rolling(F.avg, c, n, min_periods, end)


def total(c, n, min_periods=None, end=0):
    return rolling(F.sum, c, n, min_periods, end)


def low(c, n, min_periods=None, end=0):
    return rolling(F.min, c, n, min_periods, end)


def high(c, n, min_periods=None, end=0):
    return rolling(F.max, c, n, min_periods, end)


def std(c, n, min_periods=None, end=0):
    """Sample standard deviation."""
    return rolling(F.stddev_samp, c, n, min_periods, end)


def var(c, n, min_periods=None, end=0):
    return rolling(F.var_samp, c, n, min_periods, end)


def std_pop(c, n, min_periods=None, end=0):
    return rolling(F.stddev_pop, c, n, min_periods, end)


def once(parts: dict[str, Column], formula: Callable[..., Column]) -> Column:
    """``formula`` over window results that are each computed once.  A window expression that a formula
    names several times would otherwise be evaluated over the whole frame for every mention."""
    row = F.array(F.struct(*[c.alias(name) for name, c in parts.items()]))
    return F.transform(row, lambda x: formula(**{name: x[name] for name in parts}))[0]


def _middle(values: Column, least: int) -> Column:
    size = F.size(values)
    low, high = (F.get(values, F.floor((size - k) / 2).cast("int")) for k in (1, 0))
    return F.when(size >= least, F.when(low == high, low).otherwise(0.5 * low + 0.5 * high))


def median(c, n, min_periods=None, end=0):
    """Exact median.  The frame is collected and sorted once a row, which is several times cheaper there
    than an exact percentile and its map of counts; the number of values comes with it."""
    least = n if min_periods is None else min_periods
    values = F.sort_array(F.collect_list(col(c).cast("double")).over(last_rows(n, end)))
    return once({"values": values}, lambda values: _middle(values, least))


TINY_VARIANCE = 1e-14


def power_sums(c: Column | str, n: int, powers: int) -> list[Column]:
    """Sums of x, x^2, ... over the frame.  A sliding frame is re-read for every row, and plain sums
    are several times cheaper there than the built-in higher moments."""
    w = last_rows(n)
    x = col(c)
    out, power = [], x
    for _ in range(powers):
        out.append(F.sum(power).over(w))
        power = power * x
    return out


def skew_from_sums(n: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """Bias-corrected skewness of n values; 0 when they do not vary."""
    mean = s1 / n
    m2 = s2 / n - mean * mean
    m3 = s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    g1 = F.when(m2 > TINY_VARIANCE, F.try_divide(m3, F.pow(m2, 1.5))).otherwise(0.0)
    return g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))


def kurt_from_sums(n: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> Column:
    """Bias-corrected excess kurtosis of n values; -3 when they do not vary."""
    mean = s1 / n
    m2 = s2 / n - mean * mean
    m4 = s4 / n - 4 * mean * s3 / n + 6 * mean * mean * s2 / n - 3 * mean * mean * mean * mean
    g2 = F.try_divide(m4, m2 * m2) - 3
    corrected = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)
    return F.when(m2 > TINY_VARIANCE, corrected).otherwise(-3.0)


def corr_from_sums(n: Column, sa: Column, sb: Column, sab: Column, saa: Column, sbb: Column) -> Column:
    """Correlation of n complete pairs; NULL when a side does not vary."""
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    moving = (va > TINY_VARIANCE * n) & (vb > TINY_VARIANCE * n)
    return F.when(moving, F.try_divide(sab - sa * sb / n, F.sqrt(va) * F.sqrt(vb)))


def std_from_sums(n: int, s1: Column, s2: Column, same: Column) -> Column:
    """Sample deviation of a full window of n values; exactly 0 when all are equal."""
    variance = F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1)
    return F.when(same >= n, F.lit(0.0)).otherwise(F.sqrt(variance))


def _nested(sizes: tuple[int, ...]) -> list[tuple[int, int]]:
    """Each frame size with a smaller one to build it from: as many whole smaller frames as fit and
    single rows for the rest, at most eight terms; 0 where the frame is read as it is."""
    out = []
    for i, n in enumerate(sorted(set(sizes))):
        terms = {m: n // m + n % m for m, _ in out[:i]}
        best = min(terms, key=terms.get, default=0)
        out.append((n, best if best and terms[best] <= 8 else 0))
    return out


def with_frame_sums(df: DataFrame, columns: list[str], sizes: tuple[int, ...], row: str, prefix: str,
                    same: tuple[str, ...] = ()) -> DataFrame:
    """Add, for many columns and frame sizes at once:

    * ``{prefix}{c}_{n}``   sum over the last n rows, a missing value counts as 0,
    * ``{prefix}{c}_known`` length of the run of non-missing values that ends here,
    * ``{prefix}{c}_same``  length of the run of equal values that ends here (for ``same``).

    The run lengths replace one count per column and frame: a window is complete when its run is at
    least n.  They use growing frames, which cost one update per row whatever n is.  A long frame is
    the sum of shorter ones that end earlier (252 rows are two of 126, and so on down), so only the
    shortest is read again for every row; nothing is subtracted.  ``row`` is the row number inside
    the ticker.
    """
    at = F.col(row)
    growing = ticker_window().rowsBetween(Window.unboundedPreceding, 0)
    changed = {f"{prefix}{c}_new": F.when(~F.col(c).eqNullSafe(lag(c)), at) for c in same}
    filled = {f"{prefix}{c}_filled": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    df = df.withColumns(changed | filled)
    out = {f"{prefix}{c}_known": at - F.coalesce(F.max(F.when(F.col(c).isNull(), at)).over(growing), F.lit(0)) for c in columns}
    out |= {f"{prefix}{c}_same": at - F.coalesce(F.max(f"{prefix}{c}_new").over(growing), F.lit(1)) + 1 for c in same}
    plan = _nested(sizes)
    out |= {f"{prefix}{c}_{n}": F.sum(f"{prefix}{c}_filled").over(last_rows(n)) for c in columns for n, m in plan if not m}
    df = df.withColumns(out)

    def before(name: str, k: int) -> Column:
        return F.lag(name, k, 0.0).over(ticker_window()) if k else F.col(name)
    for n, m in plan:
        if m:
            df = df.withColumns({f"{prefix}{c}_{n}": sum(
                [before(f"{prefix}{c}_{m}", k) for k in range(m, n - m + 1, m)] + [before(f"{prefix}{c}_filled", k) for k in range(n - n % m, n)],
                F.col(f"{prefix}{c}_{m}")) for c in columns})
    return df.drop(*changed, *filled)


def _from_sums(c, n, powers, formula):
    parts = {"k": F.count(col(c)).over(last_rows(n)).cast("double")}
    parts |= {f"s{i}": s for i, s in enumerate(power_sums(c, n, powers), 1)}
    return once(parts, lambda k, **sums: F.when((k >= n) & (k >= powers), formula(k, *sums.values())))


def skew(c, n):
    """Bias-corrected skewness.  Built on power sums: centre a series first when its mean is far
    from 0 compared with its spread (returns are fine as they are)."""
    return _from_sums(c, n, 3, skew_from_sums)


def kurt(c, n):
    """Bias-corrected excess kurtosis; see ``skew`` on centring."""
    return _from_sums(c, n, 4, kurt_from_sums)


def _paired(a, b):
    both = col(a).isNotNull() & col(b).isNotNull()
    return F.when(both, col(a)), F.when(both, col(b))


def corr(a, b, n):
    """Correlation over complete pairs; NULL when fewer than n pairs or a side is constant."""
    w = last_rows(n)
    x, y = _paired(a, b)
    spread = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
    return F.when(F.count(x).over(w) >= n, F.try_divide(F.covar_pop(x, y).over(w), spread))


def cov(a, b, n):
    w = last_rows(n)
    x, y = _paired(a, b)
    return F.when(F.count(x).over(w) >= n, F.covar_samp(x, y).over(w))


def zscore(c, n):
    return ratio(col(c) - mean(c, n), std(c, n))


def days_since(condition: Column, row_number: Column) -> Column:
    """Rows since the last true row: 0 on it, NULL before the first."""
    w = ticker_window().rowsBetween(Window.unboundedPreceding, 0)
    return (row_number - F.last(F.when(condition, row_number), True).over(w)).cast("double")


def forward_fill(c: Column | str, limit: int | None = None) -> Column:
    """Last known value, at most ``limit`` rows old (None: any age)."""
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(col(c), True).over(ticker_window().rowsBetween(start, 0))
