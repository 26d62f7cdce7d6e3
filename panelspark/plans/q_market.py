"""Registered queries: market-relative, cross-section, calendar, high-level, lags, indicators."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import functions as F

from panelspark.contract import DATE, TICKER
from panelspark.functions import crosssection as X
from panelspark.operators import calendars as C
from panelspark.operators import indicators as TA
from panelspark.operators import market as M
from panelspark.operators import quant as Q
from panelspark.plans.q_features import RETS
from panelspark.plans.registry import BARS, D, PANEL, WINDOWS, div, out, query, r, roll, roll2
from panelspark.plans.testbars import bars, panel
from panelspark.session import cut_lineage, fits_one_task, table

MARKET = RETS + """,
agg AS (SELECT date, coalesce(sum(ret), 0) AS rsum, count(ret) AS rcnt, sum(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS pos,
  coalesce(sum(dv), 0) AS dvs, stddev_samp(ret) AS sd FROM rets GROUP BY date),
mkt AS (SELECT rets.*, (rsum - ret) / nullif(rcnt - 1, 0) AS m, (pos - CASE WHEN ret > 0 THEN 1 ELSE 0 END) / nullif(rcnt - 1, 0) AS ps,
  sd, dv / nullif(dvs, 0) AS share FROM rets JOIN agg USING (date))"""


@query("r073_daily_market_aggregates", f"""WITH {MARKET} SELECT CAST(date AS VARCHAR) AS date, {r('rsum', 'market_return_sum')},
  rcnt AS market_return_count, pos AS market_positive_count, {r('dvs', 'market_dollar_volume_sum', 3)},
  {r('sd', 'market_return_std')} FROM agg""")
def _(spark, d):
    df = M.daily_market_aggregates(Q.returns(bars(spark, d)))
    return out(df, {"market_return_sum": 6, "market_dollar_volume_sum": 3, "market_return_std": 6},
               keep=("date", "market_return_count", "market_positive_count"))


@query("r066_date_aggregate_back_join", f"""WITH {BARS}, a AS (SELECT date, avg(c) AS m, count(*) AS n FROM bars GROUP BY date)
  SELECT {D}, {r('c - m', 'close_less_mean')}, n FROM bars JOIN a USING (date)""")
def _(spark, d):
    df = X.with_group_stats(bars(spark, d), [DATE], {"m": F.avg("stock_close_price"), "n": F.count("*")})
    return out(df.withColumn("close_less_mean", F.col("stock_close_price") - F.col("m")), ["close_less_mean"],
               keep=("date", "ticker", "n"))


@query("r131_universe_ex_self", f"""WITH {MARKET} SELECT {D}, {r('m', 'quant_universe_return_1d_ex_self')},
  {r('ps', 'quant_universe_positive_share_1d_ex_self')}, {r('sd', 'quant_universe_dispersion_1d')},
  {r('share', 'quant_volume_share_of_universe')}, {r('ret - m', 'quant_excess_return_1d')} FROM mkt""")
def _(spark, d):
    return out(M.universe_relative(Q.returns(bars(spark, d))),
               [f"quant_{x}" for x in ("universe_return_1d_ex_self", "universe_positive_share_1d_ex_self",
                                       "universe_dispersion_1d", "volume_share_of_universe", "excess_return_1d")])


BETA = MARKET + ", bet AS (SELECT *, " + ", ".join(
    f"({roll2('covar_samp', 'ret', 'm', n)}) / nullif({roll('var_samp', 'm', n)}, 0) AS b{n}, "
    f"{roll2('corr', 'ret', 'm', n)} AS k{n}" for n in (21, 63)) + f" FROM mkt {WINDOWS})"


def _market(spark, d):
    return M.market_beta(M.universe_relative(Q.returns(bars(spark, d))))


@query("r132_market_beta", f"""WITH {BETA} SELECT {D}, {", ".join(
    r(f'b{n}', f'quant_beta_{n}d') + ', ' + r(f'k{n}', f'quant_correlation_to_universe_{n}d') for n in (21, 63))} FROM bet""")
def _(spark, d):
    return out(_market(spark, d), [f"quant_{x}_{n}d" for n in (21, 63) for x in ("beta", "correlation_to_universe")])


@query("r133_idiosyncratic_volatility", f"""WITH {BETA}, t AS (SELECT *, ret - b21 * m AS e21, ret - b63 * m AS e63 FROM bet)
  SELECT {D}, {", ".join(r(f"({roll('stddev_samp', f'e{n}', n)}) * {sqrt(252)}", f'quant_idiosyncratic_vol_{n}d', 5) for n in (21, 63))}
  FROM t {WINDOWS}""")
def _(spark, d):
    return out(M.idiosyncratic_volatility(_market(spark, d)), [f"quant_idiosyncratic_vol_{n}d" for n in (21, 63)], digits=5)


@query("r134_relative_strength", f"""WITH {MARKET}, t AS (SELECT *, CASE WHEN m > -1 THEN ln(1 + m) END AS ml FROM mkt)
  SELECT {D}, {", ".join(r(f"({roll('sum', 'lret', n)}) - ({roll('sum', 'ml', n)})", f'quant_relative_strength_{n}d') for n in (21, 63))}
  FROM t {WINDOWS}""")
def _(spark, d):
    return out(M.relative_strength(M.universe_relative(Q.returns(bars(spark, d)))),
               [f"quant_relative_strength_{n}d" for n in (21, 63)])


def rank_sql(x: str, by: str, n: str | None = None) -> str:
    """Average-tie percent rank of x inside ``by``, NULL for a missing x."""
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {by}) END")


# Base columns of the cross-section: two momentum windows, volatility, dollar volume, volume ratio.
CS = RETS + f""", base AS (SELECT date, ticker, lc - lag(lc, 21) OVER w AS momentum_21d, lc - lag(lc, 63) OVER w AS momentum_63d,
  ({roll('stddev_samp', 'ret', 21)}) * {sqrt(252)} AS realized_vol_21d, ln(1 + dv) AS log_dollar_volume FROM rets {WINDOWS})"""
CS_NAMES = ("momentum_21d", "momentum_63d", "realized_vol_21d", "log_dollar_volume")


def _cs_base(spark, d):
    df = Q.momentum(Q.returns(bars(spark, d)))
    df = df.withColumns({"quant_realized_vol_21d": Q.R.std(Q.RETURN, 21) * Q.ANNUAL, "quant_log_dollar_volume": F.log1p(Q.DOLLARS)})
    return df.select(DATE, TICKER, *[f"quant_{c}" for c in CS_NAMES])


def _z(x):
    return (f"greatest(-5, least(5, ({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0)))")


@query("r135_cross_sectional_features", f"""WITH {CS} SELECT {D}, {", ".join(
    r(rank_sql(x, 'date'), f'quant_cs_rank_{x}') + ', ' + r(f"CASE WHEN {x} IS NOT NULL AND stddev_samp({x}) OVER (PARTITION BY date) > 0 THEN {_z(x)} END", f'quant_cs_zscore_{x}')
    for x in CS_NAMES)} FROM base""")
def _(spark, d):
    df = M.add_cross_sectional_features(_cs_base(spark, d))
    return out(df, [f"quant_cs_{k}_{x}" for x in CS_NAMES for k in ("rank", "zscore")])


@query("r102_cross_sectional_percent_rank", f"""WITH {BARS} SELECT {D}, {r(rank_sql('v', 'date'), 'volume_rank')},
  {r(rank_sql('c', 'date'), 'close_rank')} FROM bars""")
def _(spark, d):
    # Volumes repeat a lot inside a date; this one runs the split plan that ranks aggregated values.
    df = X.with_group_ranks(bars(spark, d), [DATE], {"volume_rank": "stock_trading_volume", "close_rank": "stock_close_price"}, split=True)
    return out(df, ["volume_rank", "close_rank"])


@query("r103_cross_sectional_zscore", f"""WITH {BARS} SELECT {D}, {r(f"CASE WHEN stddev_samp(v) OVER (PARTITION BY date) > 0 THEN {_z('v')} END", 'volume_z')} FROM bars""")
def _(spark, d):
    return out(X.with_zscores(bars(spark, d), [DATE], {"volume_z": "stock_trading_volume"}, limit=5.0), ["volume_z"])


@query("r104_group_demean", f"""WITH {PANEL} SELECT {D}, {r("c - avg(c) OVER (PARTITION BY date, coalesce(sector, industry, '__missing_sector__'))", 'close_less_sector')} FROM panel""")
def _(spark, d):
    df = panel(spark, d).withColumn("_sector", M.sector_key())
    df = X.with_group_stats(df, [DATE, "_sector"], {"_m": F.avg("stock_close_price")})
    return out(df.withColumn("close_less_sector", F.col("stock_close_price") - F.col("_m")), ["close_less_sector"])


@query("r105_session_index", f"""WITH {BARS} SELECT {D}, dense_rank() OVER (ORDER BY date) - 1 AS session_index FROM bars""")
def _(spark, d):
    df = bars(spark, d)
    return out(df.join(F.broadcast(C.session_index(C.distinct_dates(df))), DATE), keep=("date", "ticker", "session_index"))


CYC = {"day_of_week": ("isodow(date) - 1", 7), "month_of_year": ("month(date)", 12), "day_of_month": ("day(date)", 31),
       "day_of_year": ("dayofyear(date)", 366)}


@query("r136_cyclical_encodings", f"""WITH {BARS} SELECT {D}, {", ".join(
    r(f'{f}({2 * pi}::DOUBLE * ({e}) / {p}.0::DOUBLE)', f'quant_{n}_{f}') for n, (e, p) in CYC.items() for f in ('sin', 'cos'))} FROM bars""")
def _(spark, d):
    return out(C.cyclical(bars(spark, d)), [f"quant_{n}_{f}" for n in CYC for f in ("sin", "cos")])


def _edges(unit):
    p = f"date_trunc('{unit}', date)"
    return (f"CASE WHEN {p} IS DISTINCT FROM lag({p}) OVER (ORDER BY date) THEN 1 ELSE 0 END AS quant_is_{unit}_start, "
            f"CASE WHEN {p} IS DISTINCT FROM lead({p}) OVER (ORDER BY date) THEN 1 ELSE 0 END AS quant_is_{unit}_end")


@query("r137_period_edges", f"""WITH {BARS}, e AS (SELECT date, {_edges('month')}, {_edges('quarter')} FROM (SELECT DISTINCT date FROM bars))
  SELECT {D}, quant_is_month_start, quant_is_month_end, quant_is_quarter_start, quant_is_quarter_end FROM bars JOIN e USING (date)""")
def _(spark, d):
    return out(C.add_calendar_features(bars(spark, d)),
               keep=("date", "ticker", *[f"quant_is_{u}_{s}" for u in ("month", "quarter") for s in ("start", "end")]))


def _bounds(spark, d):
    return table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))


# Independent holiday oracle: every weekday rule is found by filtering all days of the years.
SESSIONS_SQL = """b AS (SELECT CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders),
alldays AS (SELECT CAST(unnest(generate_series(date_trunc('year', s)::TIMESTAMP, (e + INTERVAL 366 DAY)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
k AS (SELECT date, year(date) AS y, month(date) AS m, day(date) AS dd, isodow(date) AS w FROM alldays),
yr AS (SELECT DISTINCT y, y % 19 AS a, y // 100 AS c, y % 100 AS f FROM k),
es1 AS (SELECT y, a, c, f, (19 * a + c - c // 4 - (c - (c + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM yr),
es2 AS (SELECT y, a, h, (32 + 2 * (c % 4) + 2 * (f // 4) - h - f % 4) % 7 AS l FROM es1),
es3 AS (SELECT y, h, l, (a + 11 * h + 22 * l) // 451 AS mm FROM es2),
gf AS (SELECT make_date(y, (h + l - 7 * mm + 114) // 31, (h + l - 7 * mm + 114) % 31 + 1) - 2 AS date FROM es3),
hol AS (
  SELECT date FROM gf
  UNION ALL SELECT date FROM k WHERE (m = 1 AND w = 1 AND dd BETWEEN 15 AND 21) OR (m = 2 AND w = 1 AND dd BETWEEN 15 AND 21)
    OR (m = 5 AND w = 1 AND dd > 24) OR (m = 9 AND w = 1 AND dd <= 7) OR (m = 11 AND w = 4 AND dd BETWEEN 22 AND 28)
  UNION ALL SELECT CASE w WHEN 6 THEN date - 1 WHEN 7 THEN date + 1 ELSE date END FROM k
    WHERE (m = 1 AND dd = 1) OR (m = 7 AND dd = 4) OR (m = 12 AND dd = 25) OR (m = 6 AND dd = 19 AND y >= 2022)),
sessions AS (SELECT date FROM k, b WHERE date BETWEEN s AND e AND w <= 5 AND date NOT IN (SELECT date FROM hol)
  AND date NOT IN (DATE '2004-06-11', DATE '2007-01-02', DATE '2012-10-29', DATE '2012-10-30', DATE '2018-12-05', DATE '2025-01-09'))"""


@query("r138_exchange_sessions", f"WITH {SESSIONS_SQL} SELECT CAST(date AS VARCHAR) AS date FROM sessions")
def _(spark, d):
    return out(C.exchange_sessions(_bounds(spark, d)), keep=("date",))


# Meeting days stand in for a supplied event table: days with the heaviest order count of each month.
MEETING_SQL = """perday AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1),
ev AS (SELECT date FROM (SELECT date, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY n DESC, date) AS k FROM perday) WHERE k = 1)"""


def _meetings(spark, d):
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias(DATE)).agg(F.count("*").alias("n"))
    month = F.trunc(DATE, "MM")
    return days.groupBy(month.alias("m")).agg(F.max_by(DATE, F.struct("n", -F.unix_date(DATE))).alias(DATE)).select(DATE)


@query("r139_event_calendar_features", f"""WITH {SESSIONS_SQL}, {MEETING_SQL}
  SELECT CAST(date AS VARCHAR) AS date, CASE WHEN date IN (SELECT date FROM ev) THEN 1 ELSE 0 END AS is_fomc_day,
  coalesce((SELECT min(ev.date) FROM ev WHERE ev.date >= s.date) - date, -1)::INT AS days_to_next_fomc,
  coalesce(date - (SELECT max(ev.date) FROM ev WHERE ev.date <= s.date), -1)::INT AS days_since_last_fomc,
  CASE WHEN yearweek(date) IN (SELECT yearweek(date) FROM ev) THEN 1 ELSE 0 END AS is_fomc_week FROM sessions s""")
def _(spark, d):
    df = C.event_distances(C.exchange_sessions(_bounds(spark, d)), _meetings(spark, d), "fomc")
    return out(df, keep=("date", "is_fomc_day", "days_to_next_fomc", "days_since_last_fomc", "is_fomc_week"))


QUAD_SQL = """qw AS (SELECT date FROM k, b WHERE m IN (3, 6, 9, 12) AND w = 5 AND dd BETWEEN 15 AND 21 AND date BETWEEN s AND e)"""


@query("r140_quad_witching", f"""WITH {SESSIONS_SQL}, {QUAD_SQL} SELECT CAST(date AS VARCHAR) AS date,
  CASE WHEN date IN (SELECT date FROM qw) THEN 1 ELSE 0 END AS is_quad_witching,
  coalesce((SELECT min(qw.date) FROM qw WHERE qw.date >= s.date) - date, -1)::INT AS days_to_next_quad_witching FROM sessions s""")
def _(spark, d):
    b = _bounds(spark, d)
    df = C.event_distances(C.exchange_sessions(b), C.quad_witching_days(b), "quad_witching")
    return out(df.withColumnRenamed("is_quad_witching_day", "is_quad_witching"),
               keep=("date", "is_quad_witching", "days_to_next_quad_witching"))


@query("r065_event_day_distances", f"""WITH {BARS}, {MEETING_SQL}, days AS (SELECT DISTINCT date FROM bars)
  SELECT CAST(date AS VARCHAR) AS date, coalesce((SELECT min(ev.date) FROM ev WHERE ev.date >= s.date) - date, -1)::INT AS days_to_next_event,
  coalesce(date - (SELECT max(ev.date) FROM ev WHERE ev.date <= s.date), -1)::INT AS days_since_last_event FROM days s""")
def _(spark, d):
    df = C.event_distances(C.distinct_dates(bars(spark, d)), _meetings(spark, d), "event")
    return out(df, keep=("date", "days_to_next_event", "days_since_last_event"))


# --- high-level family ---------------------------------------------------------------------------

# Wilder RSI by recursion over the ordered rows of each ticker.
RSI_SQL = BARS + """, st AS (SELECT date, ticker, row_number() OVER w AS rn, c, c - lag(c) OVER w AS dx FROM bars
  WINDOW w AS (PARTITION BY ticker ORDER BY date)),
rec AS (WITH RECURSIVE g(ticker, rn, ag, al) AS (
    SELECT ticker, rn, greatest(dx, 0), greatest(-dx, 0) FROM st WHERE rn = 2
    UNION ALL SELECT st.ticker, st.rn, g.ag * 13.0::DOUBLE / 14 + greatest(dx, 0) / 14, g.al * 13.0::DOUBLE / 14 + greatest(-dx, 0) / 14
    FROM g JOIN st ON st.ticker = g.ticker AND st.rn = g.rn + 1) SELECT * FROM g),
rsi AS (SELECT st.date, st.ticker, CASE WHEN rec.rn < 15 THEN NULL WHEN ag <= 1e-8 AND al <= 1e-8 THEN 50 WHEN al <= 1e-8 THEN 100
  WHEN ag <= 1e-8 THEN 0 ELSE 100 - 100 / (1 + ag / al) END AS rsi FROM st LEFT JOIN rec USING (ticker, rn))"""


@query("r150_wilder_rsi", f"WITH {RSI_SQL} SELECT {D}, {r('rsi', 'rsi_14')} FROM rsi")
def _(spark, d):
    return out(TA.rsi_14(bars(spark, d), "rsi_14"), ["rsi_14"])


PRIM = PANEL + f""", p0 AS (SELECT *, lag(c) OVER w AS pc, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM panel {WINDOWS}),
p1 AS (SELECT *, ln(o / pc) AS gap, ln(c / o) AS intr, ln(c / pc) AS clr,
  greatest(h - l, abs(h - pc), abs(l - pc)) / abs(c) AS tp FROM p0),
p2 AS (SELECT *, {roll('avg', 'tp', 21)} AS atr, {roll('stddev_samp', 'tp', 21)} AS tps,
  {", ".join(f"{roll('stddev_samp', x, n)} AS {x}{n}" for x, ns in (('gap', (21, 63)), ('intr', (21, 63)), ('clr', (5, 21, 63))) for n in ns)}
  FROM p1 {WINDOWS})"""


@query("r147_sector_relative", f"""WITH {PRIM}, {RSI_SQL.replace(BARS + ', ', '')}, q AS (SELECT p2.*, rsi, coalesce(sector, industry, '__missing_sector__') AS sk FROM p2 JOIN rsi USING (date, ticker))
  SELECT {D}, {", ".join(r(f'{x} - avg({x}) OVER (PARTITION BY date, sk)', f'sector_relative_{n}')
                         for x, n in (('gap', 'gap_return'), ('intr', 'intraday_return'), ('rsi', 'rsi')))},
  {r(rank_sql('rsi', 'date, sk'), 'sector_rsi_rank')}, {r(rank_sql('gap', 'date, sk'), 'sector_gap_rank')} FROM q""")
def _(spark, d):
    df = M.sector_features(TA.rsi_14(M.price_primitives(panel(spark, d))))
    return out(df, ["sector_relative_gap_return", "sector_relative_intraday_return", "sector_relative_rsi",
                    "sector_rsi_rank", "sector_gap_rank"])


@query("r148_open_structure", f"""WITH {PRIM} SELECT {D}, CASE WHEN o > ph THEN 1 ELSE 0 END AS open_above_prev_high_flag,
  CASE WHEN o < pl THEN 1 ELSE 0 END AS open_below_prev_low_flag, CASE WHEN o >= pl AND o <= ph THEN 1 ELSE 0 END AS open_in_prev_range_flag,
  {", ".join(r(f'CASE WHEN atr > 1e-12 THEN (o - {x}) / atr END', f'open_distance_to_prev_{n}_over_atr_21d', 4)
             for x, n in (('pc', 'close'), ('ph', 'high'), ('pl', 'low')))} FROM p2""")
def _(spark, d):
    return out(M.open_features(M.price_primitives(panel(spark, d))),
               [f"open_distance_to_prev_{x}_over_atr_21d" for x in ("close", "high", "low")], digits=4,
               keep=("date", "ticker", "open_above_prev_high_flag", "open_below_prev_low_flag", "open_in_prev_range_flag"))


def _tiny(n, dd):
    return f"CASE WHEN abs({dd}) > 1e-12 THEN ({n}) / {dd} END"


REGIME = {"quant_realized_vol_ratio_5d_21d": _tiny("clr5", "clr21"), "quant_realized_vol_ratio_21d_63d": _tiny("clr21", "clr63"),
          "quant_gap_vol_ratio_21d_63d": _tiny("gap21", "gap63"), "quant_intraday_vol_ratio_21d_63d": _tiny("intr21", "intr63"),
          "quant_true_range_zscore_21d": _tiny("tp - atr", "tps")}


@query("r149_volatility_regime", f"WITH {PRIM} SELECT {D}, {', '.join(r(v, k) for k, v in REGIME.items())} FROM p2")
def _(spark, d):
    return out(M.regime_features(M.price_primitives(panel(spark, d))), list(REGIME))


# Instrument specs from the part table: validity by size, symbol = part key as ticker.
SPECS_SQL = """specs AS (SELECT CAST(p_partkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS VARCHAR) AS symbol,
  CASE WHEN p_size % 5 = 0 THEN 'index_cfd' ELSE 'stock_cash' END AS instrument_group,
  CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  p_size * 1.0::DOUBLE AS spread_bps, p_retailprice / 1000 AS slippage_bps, -p_size / 10.0::DOUBLE AS long_swap_bps_daily,
  p_size / 20.0::DOUBLE AS short_swap_bps_daily,
  DATE '1995-01-01' + CAST(p_partkey % 1500 AS INT) AS effective_from,
  CASE WHEN p_size % 3 <> 0 THEN DATE '1995-01-01' + CAST(p_partkey % 1500 + p_size * 20 AS INT) END AS effective_to, p_partkey FROM part)"""


def specs(spark, d):
    """Instrument specs derived from part: one symbol has several validity intervals."""
    n = table(spark, d, "supplier").agg(F.max("s_suppkey") + 1)
    p = table(spark, d, "part").withColumn("_n", n.scalar())
    size, start = F.col("p_size"), (F.col("p_partkey") % 1500).cast("int")
    origin = F.lit("1995-01-01").cast("date")
    return p.select(
        (F.col("p_partkey") % F.col("_n")).cast("string").alias("symbol"),
        F.when(size % 5 == 0, "index_cfd").otherwise("stock_cash").alias("instrument_group"),
        F.when(size % 2 == 0, "EUR").otherwise("USD").alias("currency"),
        size.cast("double").alias("spread_bps"), (F.col("p_retailprice") / 1000).alias("slippage_bps"),
        (-size / 10.0).alias("long_swap_bps_daily"), (size / 20.0).alias("short_swap_bps_daily"),
        F.date_add(origin, start).alias("effective_from"),
        F.when(size % 3 != 0, F.date_add(origin, start + size * 20)).alias("effective_to"), "p_partkey")


DEFAULT_COSTS = {"spread_bps": 5.0, "slippage_bps": 1.5, "long_swap_bps_daily": -0.5, "short_swap_bps_daily": 0.25}
LOOKUP_SQL = """cand AS (SELECT b.date, b.ticker, s.*, row_number() OVER (PARTITION BY b.date, b.ticker
    ORDER BY effective_from DESC, coalesce(CAST(effective_to AS VARCHAR), '') DESC, spread_bps DESC, slippage_bps DESC) AS k
  FROM bars b JOIN specs s ON s.symbol = b.ticker AND effective_from <= b.date AND (effective_to IS NULL OR b.date <= effective_to)),
best AS (SELECT * FROM cand WHERE k = 1)"""


@query("r059_validity_lookup", f"""WITH {BARS}, {SPECS_SQL}, {LOOKUP_SQL} SELECT CAST(bars.date AS VARCHAR) AS date, bars.ticker AS ticker,
  {r('coalesce(best.spread_bps, 5.0)', 'spread_bps')} FROM bars LEFT JOIN best USING (date, ticker)""")
def _(spark, d):
    from panelspark.operators.joins import validity_lookup
    return out(validity_lookup(bars(spark, d), specs(spark, d), ["spread_bps"], DEFAULT_COSTS), ["spread_bps"])


@query("r146_broker_cost_features", f"""WITH {PRIM}, {SPECS_SQL}, {LOOKUP_SQL}, z AS (SELECT p2.date, p2.ticker, clr21, gap,
  coalesce(spread_bps, 5.0) AS sp, coalesce(long_swap_bps_daily, -0.5) AS ls, coalesce(short_swap_bps_daily, 0.25) AS ss
  FROM p2 LEFT JOIN best USING (date, ticker))
  SELECT {D}, {r('sp', 'xtb_spread_bps')}, {r('ls', 'xtb_long_swap_bps_daily')}, {r('ss', 'xtb_short_swap_bps_daily')}, {r('ss - ls', 'xtb_swap_asymmetry')},
  0.0::DOUBLE AS xtb_expected_intraday_cost_rate, 0.0::DOUBLE AS xtb_expected_overnight_cost_rate,
  {r(_tiny('sp / 10000', 'clr21'), 'xtb_spread_to_realized_vol_21d')}, {r(f"CASE WHEN abs(gap) > 1e-12 THEN sp / 10000 / abs(gap) END", 'xtb_spread_to_gap_abs')} FROM z""")
def _(spark, d):
    df = M.broker_cost_features(M.price_primitives(panel(spark, d)), specs(spark, d), DEFAULT_COSTS)
    return out(df, ["xtb_spread_bps", "xtb_long_swap_bps_daily", "xtb_short_swap_bps_daily", "xtb_swap_asymmetry",
                    "xtb_expected_intraday_cost_rate", "xtb_expected_overnight_cost_rate",
                    "xtb_spread_to_realized_vol_21d", "xtb_spread_to_gap_abs"])


# Announcements: orders of the customer with the ticker's number; status gives the session.
EARN_SQL = """earn AS (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS ad,
  CASE o_orderstatus WHEN 'F' THEN 'before_open' WHEN 'O' THEN 'after_close' ELSE 'unknown' END AS sess FROM orders)"""


def earnings(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias(TICKER), F.to_date("o_orderdate").alias("announcement_date"),
        F.when(status == "F", "before_open").when(status == "O", "after_close").otherwise("unknown").alias("announcement_session"))


EARN_IDX = EARN_SQL + """, sess AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)),
counts AS (SELECT ad, (SELECT count(*) FROM sess WHERE date <= ad) AS upto, (SELECT count(*) FROM sess WHERE date < ad) AS before
  FROM (SELECT DISTINCT ad FROM earn)),
ev AS (SELECT ticker, ad, sess, CASE WHEN sess = 'after_close' THEN upto ELSE before END AS i FROM earn JOIN counts USING (ad)
  WHERE sess <> 'unknown')"""

@query("r063_effective_sessions", f"""WITH {BARS}, {EARN_IDX} SELECT ticker, CAST(ad AS VARCHAR) AS announcement_date, sess AS announcement_session, i AS session_index
  FROM ev WHERE i < (SELECT count(*) FROM sess)""")
def _(spark, d):
    from panelspark.operators.joins import effective_sessions
    index = C.session_index(C.distinct_dates(bars(spark, d)))
    known = earnings(spark, d).where("announcement_session <> 'unknown'")
    return out(effective_sessions(known, index), keep=("ticker", "announcement_date", "announcement_session", "session_index"))


NEAR_SQL = """near AS (SELECT b.date, b.ticker, min(CASE WHEN ev.i >= s.i THEN ev.i - s.i END) AS nx, min(CASE WHEN ev.i <= s.i THEN s.i - ev.i END) AS pv
  FROM bars b JOIN sess s ON s.date = b.date LEFT JOIN (SELECT DISTINCT ticker, i FROM ev WHERE i < (SELECT count(*) FROM sess)) ev ON ev.ticker = b.ticker
  GROUP BY 1, 2)"""


@query("r062_nearest_event", f"""WITH {BARS}, {EARN_IDX}, {NEAR_SQL} SELECT {D}, nx::DOUBLE AS next_distance, pv::DOUBLE AS prev_distance FROM near""")
def _(spark, d):
    from panelspark.operators.joins import effective_sessions, event_neighbours
    df = bars(spark, d)
    index = C.session_index(C.distinct_dates(df))
    events = effective_sessions(earnings(spark, d).where("announcement_session <> 'unknown'"), index)
    return out(event_neighbours(df.join(F.broadcast(index), DATE), events), keep=("date", "ticker", "next_distance", "prev_distance"))


@query("r151_earnings_proximity", f"""WITH {BARS}, {EARN_IDX}, {NEAR_SQL}, z AS (SELECT date, ticker, coalesce(nx, 252)::DOUBLE AS n, coalesce(pv, 252)::DOUBLE AS p FROM near)
  SELECT {D}, n AS earnings_days_to_next, p AS earnings_days_since_last, CASE WHEN n <= 5 THEN 1 ELSE 0 END AS earnings_is_week,
  CASE WHEN n <= 1 THEN 0 WHEN n <= 5 THEN 1 WHEN n <= 10 THEN 2 ELSE 3 END AS earnings_proximity_bucket FROM z""")
def _(spark, d):
    return out(M.earnings_features(bars(spark, d), earnings(spark, d)),
               keep=("date", "ticker", "earnings_days_to_next", "earnings_days_since_last", "earnings_is_week", "earnings_proximity_bucket"))


EMA_SQL = """em AS (WITH RECURSIVE g(ticker, rn, e12, e26) AS (
    SELECT ticker, rn, c, c FROM st WHERE rn = 1
    UNION ALL SELECT st.ticker, st.rn, g.e12 * 11.0::DOUBLE / 13 + st.c * 2.0::DOUBLE / 13, g.e26 * 25.0::DOUBLE / 27 + st.c * 2.0::DOUBLE / 27
    FROM g JOIN st ON st.ticker = g.ticker AND st.rn = g.rn + 1) SELECT * FROM g),
ema AS (SELECT st.date, ticker, rn, CASE WHEN rn >= 12 THEN e12 END AS ef, CASE WHEN rn >= 26 THEN e26 END AS es FROM em JOIN st USING (ticker, rn))"""


@query("r152_interaction_flags", f"""WITH {PRIM}, {RSI_SQL.replace(BARS + ', ', '')}, {EMA_SQL}, {SPECS_SQL}, {LOOKUP_SQL}, {EARN_IDX}, {NEAR_SQL},
  q AS (SELECT p2.*, rsi, ef - es AS macd, coalesce(spread_bps, 5.0) / 10000 / CASE WHEN abs(gap) > 1e-12 THEN abs(gap) END AS rc,
    coalesce(nx, 252) AS dn, o / nullif(pc, 0) - 1 AS qgap, ln(c) - lag(ln(c), 21) OVER (PARTITION BY p2.ticker ORDER BY p2.date) AS mom,
    gap - avg(gap) OVER (PARTITION BY p2.date, sector) AS sg, intr - avg(intr) OVER (PARTITION BY p2.date, sector) AS si,
    {_tiny('clr5', 'clr21')} AS vr, {_tiny('o - pc', 'atr')} AS st FROM p2 JOIN rsi USING (date, ticker) JOIN ema USING (date, ticker)
    LEFT JOIN best USING (date, ticker) JOIN near USING (date, ticker))
  SELECT {D}, {", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS signal_{n}_flag" for n, c in (
      ('rsi_overbought_macd_positive', 'rsi > 70 AND macd > 0'), ('rsi_oversold_macd_negative', 'rsi < 30 AND macd < 0'),
      ('gap_up_breakout', 'o > ph AND qgap > 0'), ('gap_down_breakdown', 'o < pl AND qgap < 0'),
      ('sector_strength_confirmed', 'sg > 0 AND si > 0'), ('sector_weakness_confirmed', 'sg < 0 AND si < 0'),
      ('earnings_tension', 'dn <= 5 AND vr > 1'), ('open_stretch_high_cost', 'abs(st) > 1 AND rc > 0.25'),
      ('trend_follow_through', 'macd > 0 AND mom > 0 AND si > 0'),
      ('mean_reversion_exhaustion', 'rsi < 30 AND o >= pl AND o <= ph AND qgap < 0')))} FROM q""")
def _(spark, d):
    from panelspark.contract import KEY
    # Close-based volatility (no quant columns yet), then the flags' other inputs.
    df = M.price_primitives(panel(spark, d))
    df = M.open_features(M.regime_features(df))
    df = df.withColumns({"quant_gap_return": Q.ratio("stock_open_price", "__hl_prev_close") - 1.0,
                         "quant_momentum_21d": F.log("stock_close_price") - F.log(Q.R.lag("stock_close_price", 21))})
    df = M.broker_cost_features(df, specs(spark, d), DEFAULT_COSTS)
    # From the prices alone, and stored when large: the flags and the size of the sector groups both read it.
    ta = TA.recursive_indicators(panel(spark, d)).select(*KEY, "ta_momentum_rsi", "ta_trend_macd")
    ta = ta if fits_one_task(ta) else cut_lineage(ta, "recursive")
    df = M.sector_features(df.join(ta, list(KEY), "left"), rsi="ta_momentum_rsi")
    df = M.interaction_flags(M.earnings_features(df, earnings(spark, d)))
    return out(df, keep=("date", "ticker", *[c for c in df.columns if c.startswith("signal_")]))


@query("r153_lag_policy", f"""SELECT * FROM (VALUES ('stock_close_log_return', '1,5,21'), ('ta_momentum_rsi', '1,5,21'), ('ta_volume_obv', ''),
  ('quant_beta_21d', '1,5,21'), ('quant_adv_21d', ''), ('quant_days_in_sample', ''), ('deep_event_inside_day_flag', '1,5,21'),
  ('company_beta', '1,21'), ('macro_rate', '1,21'), ('calendar_days_since_last_fomc', '1,5'), ('calendar_is_fomc_day', ''),
  ('cross_asset_dax_log_return', '1,5,21'), ('date', ''), ('ticker', ''), ('quant_beta_21d_lag_5d', '')) t(feature, windows)
  WHERE (SELECT count(*) FROM lineitem) > 0""")
def _(spark, d):
    """The policy applied to the columns of a panel derived from the bars."""
    names = ("stock_close_log_return ta_momentum_rsi ta_volume_obv quant_beta_21d quant_adv_21d quant_days_in_sample "
             "deep_event_inside_day_flag company_beta macro_rate calendar_days_since_last_fomc calendar_is_fomc_day "
             "cross_asset_dax_log_return quant_beta_21d_lag_5d").split()
    df = bars(spark, d).select(DATE, TICKER, *[F.col("stock_close_price").alias(n) for n in names])
    policy = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(",".join(map(str, M.lag_windows(c)))))])
    present = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return (present.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("feature", "n"))
            .where("n > 0").select("feature", policy[F.col("feature")].alias("windows")))


@query("r154_lag_block", f"""WITH {RETS} SELECT {D}, {", ".join(
    r(f'CAST(lag({x}, {k}) OVER w AS FLOAT)', f'{n}_lag_{k}d', 4) for x, n in (('gap', 'quant_gap_return'), ('intr', 'quant_intraday_return'))
    for k in (1, 5, 21))} FROM rets2 {WINDOWS}""")
def _(spark, d):
    df = Q.bar_shape(bars(spark, d)).select(DATE, TICKER, "quant_gap_return", "quant_intraday_return")
    return out(M.add_feature_lags(df), [f"{n}_lag_{k}d" for n in ("quant_gap_return", "quant_intraday_return") for k in (1, 5, 21)], digits=4)


# --- indicators -------------------------------------------------------------------------------------

TA0 = BARS + f""", t0 AS (SELECT *, row_number() OVER w AS rn, lag(c) OVER w AS pc, lag(h) OVER w AS ph, lag(l) OVER w AS pl, (h + l + c) / 3 AS typ,
  first_value(c) OVER w AS c0 FROM bars {WINDOWS})"""
VOL_SQL = TA0 + f""", t1 AS (SELECT *, coalesce((2 * c - h - l) / nullif(h - l, 0), 0) * v AS mfv, CASE WHEN c < pc THEN -v ELSE v END AS sv,
  coalesce(v * (c / nullif(pc, 0) - 1), 0) AS vp, (h - ph + l - pl) * (h - l) / (2 * v) * 1e8 AS em, typ * v AS fl, lag(typ) OVER w AS pt FROM t0 {WINDOWS}),
t2 AS (SELECT *, CASE WHEN typ > pt THEN fl ELSE 0 END AS up, CASE WHEN typ < pt THEN fl ELSE 0 END AS dn FROM t1)"""


@query("r124_ta_volume", f"""WITH {VOL_SQL} SELECT {D}, {r('sum(mfv) OVER w', 'ta_volume_adi', 4)}, {r('sum(sv) OVER w', 'ta_volume_obv', 4)},
  {r(div(f"({roll('sum', 'mfv', 20)})", f"({roll('sum', 'v', 20)})"), 'ta_volume_cmf')}, {r('em / 1e8', 'ta_volume_em', 4)},
  {r(f"({roll('avg', 'em', 14)}) / 1e8", 'ta_volume_sma_em', 3)}, {r('sum(vp) OVER w', 'ta_volume_vpt', 4)},
  {r(div(f"({roll('sum', 'fl', 14)})", f"({roll('sum', 'v', 14)})"), 'ta_volume_vwap', 4)},
  {r(f"CASE WHEN ({roll('sum', 'dn', 14)}) = 0 THEN 100 ELSE 100 - 100 / (1 + ({roll('sum', 'up', 14)}) / ({roll('sum', 'dn', 14)})) END", 'ta_volume_mfi')}
  FROM t2 {WINDOWS}""")
def _(spark, d):
    df = TA.volume_indicators(bars(spark, d))
    df = df.withColumns({c: F.col(c) / 1e8 for c in ("ta_volume_em", "ta_volume_sma_em")})
    return out(df, {"ta_volume_adi": 4, "ta_volume_obv": 4, "ta_volume_cmf": 6, "ta_volume_em": 4, "ta_volume_sma_em": 3,
                    "ta_volume_vpt": 4, "ta_volume_vwap": 4, "ta_volume_mfi": 6})


VLT_SQL = TA0 + f""", t1 AS (SELECT *, {roll('avg', 'c', 20)} AS m, {roll('stddev_pop', 'c', 20)} AS s, {roll('min', 'l', 20)} AS dl, {roll('max', 'h', 20)} AS dh,
  {roll('avg', 'typ', 10)} AS kc, {roll('max', 'c', 14)} AS pk,
  CASE WHEN count(h) OVER w10 >= 10 THEN avg((4 * h - 2 * l + c) / 3) OVER w10 END AS kh,
  CASE WHEN count(h) OVER w10 >= 10 THEN avg((-2 * h + 4 * l + c) / 3) OVER w10 END AS kl FROM t0 {WINDOWS}),
t2 AS (SELECT *, pow(100 * (c / nullif(pk, 0) - 1), 2) AS dd, m + 2 * s AS bu, m - 2 * s AS bd FROM t1)"""
VLT = {"bbm": ("m", 4), "bbh": ("bu", 4), "bbl": ("bd", 4), "bbw": ("100 * (bu - bd) / nullif(m, 0)", 4),
       "bbp": ("(c - bd) / nullif(bu - bd, 0)", 6), "bbhi": ("CASE WHEN c > bu THEN 1 ELSE 0 END", 1),
       "bbli": ("CASE WHEN c < bd THEN 1 ELSE 0 END", 1), "kcc": ("kc", 4), "kch": ("kh", 4), "kcl": ("kl", 4),
       "kcw": ("100 * (kh - kl) / nullif(kc, 0)", 4), "kcp": ("(c - kl) / nullif(kh - kl, 0)", 6),
       "kchi": ("CASE WHEN c > kh THEN 1 ELSE 0 END", 1), "kcli": ("CASE WHEN c < kl THEN 1 ELSE 0 END", 1),
       "dcl": ("dl", 4), "dch": ("dh", 4), "dcm": ("(dl + dh) / 2", 4), "dcw": ("100 * (dh - dl) / nullif(m, 0)", 4),
       "dcp": ("(c - dl) / nullif(dh - dl, 0)", 6), "ui": (f"sqrt({roll('avg', 'dd', 14)})", 5)}


@query("r125_ta_volatility", f"WITH {VLT_SQL} SELECT {D}, {', '.join(r(e, f'ta_volatility_{n}', k) for n, (e, k) in VLT.items())} FROM t2 {WINDOWS}")
def _(spark, d):
    return out(TA.volatility_indicators(bars(spark, d)), {f"ta_volatility_{n}": k for n, (_e, k) in VLT.items()})


TRD_SQL = TA0 + f""", t1 AS (SELECT *, greatest(h - l, abs(h - pc), abs(l - pc)) AS tr, abs(h - pl) AS vp, abs(l - ph) AS vm,
  {", ".join(f"c / nullif(lag(c, {n}) OVER w, 0) - 1 AS r{n}" for n in (10, 15, 20, 30))},
  (({roll('max', 'h', 9)}) + ({roll('min', 'l', 9)})) / 2 AS cv, (({roll('max', 'h', 26)}) + ({roll('min', 'l', 26)})) / 2 AS bs,
  (({roll('max', 'h', 52)}) + ({roll('min', 'l', 52)})) / 2 AS sb, {roll('avg', 'typ', 20)} AS tm, list(typ) OVER w20 AS tl,
  arg_max(rn, struct_pack(a := h, b := rn)) OVER w26 AS hu, arg_min(rn, struct_pack(a := l, b := -rn)) OVER w26 AS lu FROM t0 {WINDOWS}),
t2 AS (SELECT *, 100 * (({roll('avg', 'r10', 10)}) + 2 * ({roll('avg', 'r15', 10)}) + 3 * ({roll('avg', 'r20', 10)}) + 4 * ({roll('avg', 'r30', 15)})) AS kst,
  (cv + bs) / 2 AS ia, CASE WHEN rn >= 20 THEN list_sum(list_transform(tl, lambda x: abs(x - tm))) / 20 END AS mad,
  CASE WHEN rn >= 26 THEN 100.0::DOUBLE * (25 - (rn - hu)) / 25 END AS au, CASE WHEN rn >= 26 THEN 100.0::DOUBLE * (25 - (rn - lu)) / 25 END AS ad
  FROM t1 {WINDOWS})"""
TRD = {"sma_fast": ("CASE WHEN rn >= 12 THEN avg(c) OVER (PARTITION BY ticker ORDER BY date ROWS 11 PRECEDING) END", 4),
       "sma_slow": (roll('avg', 'c', 26), 4),
       "vortex_ind_pos": (div(f"({roll('sum', 'vp', 14)})", f"({roll('sum', 'tr', 14)})"), 6),
       "vortex_ind_neg": (div(f"({roll('sum', 'vm', 14)})", f"({roll('sum', 'tr', 14)})"), 6),
       "dpo": (f"lag(c, 11) OVER w - ({roll('avg', 'c', 20)})", 4), "kst": ("kst", 3), "kst_sig": (roll('avg', 'kst', 9), 3),
       "ichimoku_conv": ("cv", 4), "ichimoku_base": ("bs", 4), "ichimoku_a": ("ia", 4), "ichimoku_b": ("sb", 4),
       "visual_ichimoku_a": ("lag(ia, 26) OVER w", 4), "visual_ichimoku_b": ("lag(sb, 26) OVER w", 4),
       "cci": ("(typ - tm) / nullif(0.015::DOUBLE * mad, 0)", 4), "aroon_up": ("au", 2), "aroon_down": ("ad", 2), "aroon_ind": ("au - ad", 2)}


@query("r126_ta_trend_windows", f"WITH {TRD_SQL} SELECT {D}, {', '.join(r(e, f'ta_trend_{n}', k) for n, (e, k) in TRD.items())} FROM t2 {WINDOWS}")
def _(spark, d):
    return out(TA.trend_indicators(bars(spark, d)), {f"ta_trend_{n}": k for n, (_e, k) in TRD.items()})


# EMA / MACD / ATR / RSI by recursion in SQL; the other recursive columns are checked against loops in tests.
REC_SQL = RSI_SQL + ", " + EMA_SQL


@query("r127_ta_trend_recursive", f"""WITH {REC_SQL} SELECT {D}, {r('ef', 'ta_trend_ema_fast', 4)}, {r('es', 'ta_trend_ema_slow', 4)},
  {r('ef - es', 'ta_trend_macd', 4)} FROM ema""")
def _(spark, d):
    return out(TA.recursive_indicators(bars(spark, d)), ["ta_trend_ema_fast", "ta_trend_ema_slow", "ta_trend_macd"], digits=4)


@query("r127_ta_recursive_all")
def _(spark, d):
    return out(TA.recursive_indicators(bars(spark, d)), list(TA.RECURSIVE_COLUMNS))


@query("r099_exponential_mean", f"""WITH {BARS}, st AS (SELECT date, ticker, row_number() OVER w AS rn, c FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
  {EMA_SQL} SELECT {D}, {r('es', 'ema_26', 4)} FROM ema""")
def _(spark, d):
    return out(TA.recursive_indicators(bars(spark, d)).withColumnRenamed("ta_trend_ema_slow", "ema_26"), ["ema_26"], digits=4)


MOM_SQL = TA0 + f""", t1 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN c - least(l, pc) END AS bp, CASE WHEN pc IS NOT NULL THEN greatest(h, pc) - least(l, pc) END AS tr,
  (h + l) / 2 AS md, {roll('max', 'h', 14)} AS hh, {roll('min', 'l', 14)} AS ll FROM t0 {WINDOWS}),
t2 AS (SELECT *, 100 * (c - ll) / nullif(hh - ll, 0) AS st, sum(bp) OVER w28 AS b28, sum(tr) OVER w28 AS t28, count(bp) OVER w28 AS n28,
  sum(bp) OVER w7 AS b7, sum(tr) OVER w7 AS t7, count(bp) OVER w7 AS n7 FROM t1 {WINDOWS},
  w7 AS (PARTITION BY ticker ORDER BY date ROWS 6 PRECEDING), w28 AS (PARTITION BY ticker ORDER BY date ROWS 27 PRECEDING))"""
MOM = {"stoch": ("st", 5), "stoch_signal": (roll('avg', 'st', 3), 5), "wr": ("-100 * (hh - c) / nullif(hh - ll, 0)", 5),
       "ao": (f"({roll('avg', 'md', 5)}) - ({roll('avg', 'md', 34)})", 4), "roc": ("100 * (c / nullif(lag(c, 12) OVER w, 0) - 1)", 4),
       "uo": (f"100 * (4 * CASE WHEN n7 >= 7 THEN b7 / nullif(t7, 0) END + 2 * {div(f'''({roll('sum', 'bp', 14)})''', f'''({roll('sum', 'tr', 14)})''')} + CASE WHEN n28 >= 28 THEN b28 / nullif(t28, 0) END) / 7", 5)}


@query("r128_ta_momentum_windows", f"WITH {MOM_SQL} SELECT {D}, {', '.join(r(e, f'ta_momentum_{n}', k) for n, (e, k) in MOM.items())} FROM t2 {WINDOWS}")
def _(spark, d):
    return out(TA.momentum_indicators(bars(spark, d)), {f"ta_momentum_{n}": k for n, (_e, k) in MOM.items()})


@query("r129_ta_momentum_recursive", f"""WITH {REC_SQL} SELECT {D}, {r('rsi', 'ta_momentum_rsi')}, {r('CASE WHEN rn >= 26 THEN 100 * (ef - es) / nullif(es, 0) END', 'ta_momentum_ppo')}
  FROM ema JOIN rsi USING (date, ticker)""")
def _(spark, d):
    return out(TA.recursive_indicators(bars(spark, d)), ["ta_momentum_rsi", "ta_momentum_ppo"])


@query("r130_ta_others", f"""WITH {TA0} SELECT {D}, {r('100 * (c / nullif(pc, 0) - 1)', 'ta_others_dr', 4)}, {r('100 * (ln(c) - ln(pc))', 'ta_others_dlr', 5)},
  {r('100 * (c / c0 - 1)', 'ta_others_cr', 4)} FROM t0""")
def _(spark, d):
    return out(TA.other_indicators(bars(spark, d)), {"ta_others_dr": 4, "ta_others_dlr": 5, "ta_others_cr": 4})
