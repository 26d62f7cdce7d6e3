"""Trade costs, trade closing, daily ledger, benchmark, candidate pool and summaries as tables."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.contract import DATE, HOLD_PERIOD, TICKER
from panelspark.operators.calendars import day_window, distinct_dates, session_index
from panelspark.operators.evaluation import one_row
from panelspark.sources.scans import SPEC_DEFAULTS


def running_before(df: DataFrame, group: list[str], order: list[str], bins: Column, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the group's earlier rows, for groups of any size.

    ``bins`` must not decrease along ``order``.  Bin totals give what lies before a bin; only the
    rows inside one bin are ordered together.
    """
    marked = df.withColumn("_bin", bins)
    totals = marked.groupBy(*group, "_bin").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*group, "_bin", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_shift"))
    inside = Window.partitionBy(*group, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (marked.join(shifts, [*group, "_bin"])
            .withColumn(out, F.col("_shift") + F.coalesce(F.sum(value).over(inside), F.lit(0.0))).drop("_bin", "_shift"))


def month_to_date_turnover(orders: DataFrame, account: str = "account", sequence: str = "sequence", value: str = "order_value") -> DataFrame:
    """Add ``month`` and the account's turnover earlier in the month, in (date, sequence) order.
    Negative orders count as 0."""
    df = orders.withColumns({"month": F.trunc(DATE, "MM"), "_value": F.greatest(F.col(value), F.lit(0.0))})
    day_and_run = F.struct(F.col(DATE), F.floor(F.col(sequence) / 65536))
    out = running_before(df, [account, "month"], [DATE, sequence], day_and_run, "_value", "month_to_date_turnover")
    return out.drop("_value")


def trade_cost(orders: DataFrame, value: str = "order_value", account_currency: str = "EUR") -> DataFrame:
    """Tiered cost of each order given its ``month_to_date_turnover``, group and currency.

    Spec fields not present as columns take their defaults.
    """
    def spec(name: str) -> Column:
        return F.col(name) if name in orders.columns else F.lit(SPEC_DEFAULTS[name])
    amount = F.greatest(F.col(value), F.lit(0.0))
    turnover = F.greatest(F.col("month_to_date_turnover"), F.lit(0.0))
    free = F.greatest(spec("monthly_commission_free_turnover_eur") - turnover, F.lit(0.0))
    df = orders.withColumn("billable_turnover", F.greatest(amount - free, F.lit(0.0)))
    billable = F.col("billable_turnover")
    exempt = (F.col("instrument_group") == "stock_cash") & (billable <= 0)
    foreign = F.upper("currency") != account_currency.upper()
    df = df.withColumns({
        "commission": F.when(billable > 0, F.greatest(spec("minimum_commission_eur"), billable * spec("commission_rate"))).otherwise(0.0),
        "fx_cost": F.when(~exempt & foreign, billable * spec("fx_conversion_bps") / 10_000.0).otherwise(0.0)})
    total = F.col("commission") + F.col("fx_cost")
    return df.withColumns({"total_cost": total, "cost_rate": F.coalesce(F.try_divide(total, amount), F.lit(0.0)),
                           "turnover_after": turnover + amount})


def order_sequence(trades: DataFrame) -> DataFrame:
    """Orders of a trade table in billing order: on a date exits come before entries, each by rank."""
    side = F.array(
        F.struct(F.col("exit_date").alias(DATE), F.lit("exit").alias("side"), F.lit(0).alias("leg")),
        F.struct(F.col("entry_date").alias(DATE), F.lit("entry").alias("side"), F.lit(1).alias("leg")))
    return (trades.select("*", F.explode(side).alias("_s")).select("*", "_s.*").drop("_s").where(F.col(DATE).isNotNull())
            .withColumn("sequence", F.col("leg").cast("bigint") * (1 << 40) + F.col("signal_rank")))


def monthly_turnover(orders: DataFrame, account: str = "account", value: str = "order_value") -> DataFrame:
    return orders.groupBy(account, F.trunc(DATE, "MM").alias("month")).agg(
        F.sum(F.greatest(F.col(value), F.lit(0.0))).alias("turnover"), F.avg(value).alias("average_value"), F.count("*").alias("orders"))


def exit_dates(sessions: DataFrame, hold: int = HOLD_PERIOD) -> DataFrame:
    """(date, exit_date): the hold-th next session, NULL near the end."""
    return distinct_dates(sessions).select(DATE, F.lead(DATE, hold).over(day_window()).alias("exit_date"))


def with_exit_date(trades: DataFrame, sessions: DataFrame, hold: int = HOLD_PERIOD, entry: str = "entry_date") -> DataFrame:
    return trades.join(F.broadcast(exit_dates(sessions, hold).withColumnRenamed(DATE, entry)), entry, "left")


def close_trades(trades: DataFrame) -> DataFrame:
    """Gross and net return, P&L and exit cash flow from notional, realised log return and costs."""
    gross = F.exp("realized_log_return") - 1.0
    cost = F.col("entry_cost") + F.col("exit_cost")
    df = trades.withColumns({"gross_return": gross, "gross_pnl": F.col("notional") * gross, "total_cost": cost})
    rate = F.col("total_cost") / F.greatest(F.col("notional"), F.lit(1e-12))
    return df.withColumns({"transaction_cost": rate, "net_return": F.col("gross_return") - rate,
                           "net_pnl": F.col("gross_pnl") - F.col("total_cost"),
                           "exit_cash_flow": F.col("notional") + F.col("gross_pnl") - F.col("exit_cost")})


def daily_ledger(trades: DataFrame, sessions: DataFrame, initial_equity: float, custody: bool = True) -> DataFrame:
    """Per session: opened / closed notional, costs, P&L, active notional, cash, equity, turnover.

    Trades are summed per date first; everything after runs on one row per session.  Trades
    without an exit stay open.
    """
    opened = trades.groupBy(F.col("entry_date").alias(DATE)).agg(
        F.sum("notional").alias("opened_notional"), F.sum("entry_cost").alias("entry_cost"), F.count("*").alias("opened_trades"))
    closed = trades.where(F.col("exit_date").isNotNull()).groupBy(F.col("exit_date").alias(DATE)).agg(
        F.sum("notional").alias("closed_notional"), F.sum("exit_cost").alias("exit_cost"), F.sum("gross_pnl").alias("gross_pnl_exits"),
        F.count("*").alias("closed_trades"))
    days = distinct_dates(sessions).join(opened, DATE, "left").join(closed, DATE, "left").na.fill(0)
    w = day_window()
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("active_notional", F.sum(F.col("opened_notional") - F.col("closed_notional")).over(until))
    days = days.withColumn("active_trades", F.sum(F.col("opened_trades") - F.col("closed_trades")).over(until))
    if custody:
        days = days.join(custody_fees(days), DATE, "left").na.fill(0, ["custody_fee"])
    else:
        days = days.withColumn("custody_fee", F.lit(0.0))
    pnl = F.col("gross_pnl_exits") - F.col("exit_cost") - F.col("entry_cost") - F.col("custody_fee")
    flow = F.col("closed_notional") - F.col("opened_notional") + pnl
    days = days.withColumns({"realized_pnl": pnl, "cash": F.lit(float(initial_equity)) + F.sum(flow).over(until)})
    days = days.withColumn("equity", F.col("cash") + F.col("active_notional"))
    days = days.withColumn("opening_equity", F.coalesce(F.lag("equity").over(w), F.lit(float(initial_equity))))
    opening = F.greatest(F.col("opening_equity"), F.lit(1e-12))
    return days.withColumns({
        "realized_return": F.col("realized_pnl") / opening,
        "turnover": (F.col("closed_notional") + F.col("opened_notional")) / opening,
        "gross_exposure": F.when(F.col("equity") > 0, F.col("active_notional") / F.col("equity")).otherwise(0.0),
        "total_return": F.col("equity") / float(initial_equity) - 1.0,
        # Equity from P&L alone must equal cash plus positions.
        "reconciliation_error": F.lit(float(initial_equity)) + F.sum("realized_pnl").over(until) - F.col("equity")})


def custody_fees(days: DataFrame, threshold: float = SPEC_DEFAULTS["custody_fee_threshold_eur"],
                 rate: float = SPEC_DEFAULTS["annual_custody_fee_rate"], minimum: float = SPEC_DEFAULTS["monthly_custody_fee_min_eur"]) -> DataFrame:
    """(date, custody_fee) on each month's last session: a fee on the average active notional above
    the threshold, when positions are open."""
    per_month = days.groupBy(F.trunc(DATE, "MM").alias("_month")).agg(
        F.max(DATE).alias(DATE), F.avg("active_notional").alias("_average"), F.max_by("active_trades", DATE).alias("_open"))
    fee = F.when((F.col("_open") > 0) & (F.col("_average") > threshold),
                 F.greatest(F.lit(minimum), F.col("_average") * rate / 12.0)).otherwise(0.0)
    return per_month.select(DATE, fee.alias("custody_fee"))


def buy_and_hold_benchmark(prices: DataFrame, price: str = "hl_context_stock_close_price") -> DataFrame:
    """Daily return of an equal start in every ticker priced on the first date, left to drift.

    A ticker's last known price carries over missing days, so only days with a price change the
    portfolio: sum of wealth changes over the wealth of the day before.
    """
    sessions = session_index(distinct_dates(prices))
    start = prices.agg(F.min(DATE))
    first = prices.where((F.col(DATE) == start.scalar()) & (F.col(price) > 0)).select(TICKER)
    held = prices.join(first, TICKER, "left_semi").where(F.col(price).isNotNull()).select(DATE, TICKER, price)
    order = Window.partitionBy(TICKER).orderBy(DATE)
    growth = F.try_divide(F.col(price), F.lag(price).over(order))
    held = held.withColumn("_growth", F.coalesce(growth, F.lit(1.0)))
    held = held.withColumn("_wealth", F.product("_growth").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = held.withColumn("_change", F.col("_wealth") - F.coalesce(F.lag("_wealth").over(order), F.lit(0.0)))
    daily = sessions.join(held.groupBy(DATE).agg(F.sum("_change").alias("_change")), DATE, "left").na.fill(0.0, ["_change"])
    daily = daily.withColumn("_total", F.sum("_change").over(day_window().rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("_total").over(day_window())
    return daily.select(DATE, F.coalesce(F.try_divide(F.col("_total") - before, before), F.lit(0.0)).alias("benchmark_return"))


def candidate_pool(day: DataFrame, equity: float, max_weight: float, pool: int = 40, buffer_rate: float = 0.0,
                   adv_limit: float = 0.05, account_currency: str = "EUR") -> DataFrame:
    """Per date the ``pool`` best names by net edge: expected return less cost and buffer.

    Needs expected_return, price, volume, month_to_date_turnover and the spec columns
    (max_adv_participation, instrument_group, currency).  The top-k keeps k rows per task and date
    before any shuffle.
    """
    minimum = F.col("minimum_order_value_eur") if "minimum_order_value_eur" in day.columns else F.lit(SPEC_DEFAULTS["minimum_order_value_eur"])
    price, volume = F.col("price"), F.col("volume")
    liquid = F.when((price > 0) & (volume > 0), price * volume * F.col("max_adv_participation") * max(adv_limit / 0.05, 0.0))
    df = day.where(price > 0).withColumns({
        "min_lot_shares": F.greatest(F.ceil(minimum / price), F.lit(1)).cast("bigint"),
        # Without price or volume the cap is unbounded, which leaves no shares by definition.
        "adv_cap_shares": F.greatest(F.lit(0), F.least(F.coalesce(F.floor(liquid / price), F.lit(0)),
                                                       F.floor(F.lit(max_weight * equity) / price))).cast("bigint")})
    df = trade_cost(df.withColumn("order_value", F.greatest(price * F.col("min_lot_shares"), minimum)), account_currency=account_currency)
    df = df.withColumn("net_edge", F.col("expected_return") - F.col("cost_rate") - buffer_rate)
    best = Window.partitionBy(DATE).orderBy(F.col("net_edge").desc(), TICKER)
    return (df.where((F.col("adv_cap_shares") >= F.col("min_lot_shares")) & (F.col("net_edge") > 0))
            .withColumn("pool_rank", F.row_number().over(best)).where(F.col("pool_rank") <= pool))


def allocation_diagnostics(weights: DataFrame, covariance: DataFrame, max_sector_weight: float) -> DataFrame:
    """Per date: expected return w'mu, volatility sqrt(w'Sw), net alpha, share of sectors at their cap
    and cash weight.  ``weights`` has one row per (date, ticker) of an allocation (a pool of names);
    ``covariance`` is (left, right, value)."""
    half = (weights.select(DATE, F.col(TICKER).alias("left"), "weight").join(covariance, "left")
            .groupBy(DATE, F.col("right").alias(TICKER)).agg(F.sum(F.col("weight") * F.col("value")).alias("_sw")))
    risk = weights.join(half, [DATE, TICKER]).groupBy(DATE).agg(F.sum(F.col("weight") * F.col("_sw")).alias("_variance"))
    sectors = weights.groupBy(DATE, "sector").agg(F.sum("weight").alias("_w")).groupBy(DATE).agg(
        F.avg((F.col("_w") >= max_sector_weight - 1e-6).cast("double")).alias("sector_binding_share"))
    base = weights.groupBy(DATE).agg(
        F.sum(F.col("weight") * F.col("expected_return")).alias("expected_portfolio_return"),
        F.sum(F.col("weight") * (F.col("expected_return") - F.col("cost_rate"))).alias("expected_net_alpha"),
        (1.0 - F.sum("weight")).alias("cash_weight"), F.count("*").alias("lines"))
    return (base.join(risk, DATE, "left").join(sectors, DATE, "left")
            .withColumn("expected_portfolio_volatility", F.sqrt(F.greatest(F.coalesce("_variance", F.lit(0.0)), F.lit(0.0)))).drop("_variance"))


def backtest_summary(daily: DataFrame, trades: DataFrame, initial_equity: float) -> DataFrame:
    """One row of 27 figures.  ``daily`` is a ledger with benchmark_return and capacity_binding_share;
    its running peak is the only ordered window and has one row per session."""
    until = day_window().rowsBetween(Window.unboundedPreceding, 0)
    days = daily.withColumn("_drawdown", F.col("equity") / F.max("equity").over(until) - 1.0)
    entry, exit_, custody = F.sum("entry_cost"), F.sum("exit_cost"), F.sum("custody_fee")
    d = days.agg(
        F.max_by("equity", DATE).alias("final_equity"), F.sum("gross_pnl_exits").alias("gross_pnl_before_costs"),
        entry.alias("entry_cost_amount_total"), exit_.alias("exit_cost_amount_total"), custody.alias("custody_fee_amount_total"),
        (entry + exit_ + custody).alias("transaction_cost_amount_total"), F.count("*").alias("_days"),
        F.product(1.0 + F.col("benchmark_return")).alias("_benchmark"),
        (F.stddev_pop("realized_return") * sqrt(252.0)).alias("annualized_volatility"), F.min("_drawdown").alias("max_drawdown"),
        (F.avg("turnover") * 252.0).alias("turnover_annualized"), F.avg("gross_exposure").alias("average_gross_exposure"),
        F.avg("capacity_binding_share").alias("capacity_binding_share"),
        F.max(F.abs("reconciliation_error")).alias("reconciliation_error_max_abs"))
    amount = F.sum("notional")
    t = trades.where(F.col("exit_date").isNotNull()).agg(
        F.count("*").cast("double").alias("trade_count"), F.coalesce(F.avg((F.col("net_return") > 0).cast("double")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.try_divide(F.sum("entry_cost"), amount), F.lit(0.0)).alias("avg_entry_cost_rate"),
        F.coalesce(F.try_divide(F.sum("exit_cost"), amount), F.lit(0.0)).alias("avg_exit_cost_rate"),
        F.coalesce(F.try_divide(F.sum("total_cost"), amount), F.lit(0.0)).alias("avg_roundtrip_cost_rate"))
    s = one_row(d, t)
    initial = float(initial_equity)
    years = 252.0 / F.greatest(F.col("_days"), F.lit(1))
    s = s.withColumns({
        "net_pnl": F.col("final_equity") - initial, "total_return": F.col("final_equity") / initial - 1.0,
        "net_pnl_after_costs": F.col("gross_pnl_before_costs") - F.col("transaction_cost_amount_total"),
        "annualized_return": F.pow(F.col("final_equity") / max(initial, 1e-12), years) - 1.0,
        "annualized_benchmark_return": F.pow(F.col("_benchmark"), years) - 1.0,
        "cost_drag_total": F.col("transaction_cost_amount_total"),
        "cost_drag_annualized": F.col("transaction_cost_amount_total") / F.greatest(F.col("_days"), F.lit(1)) * 252.0})
    r, vol, dd = F.col("annualized_return"), F.col("annualized_volatility"), F.col("max_drawdown")
    return s.withColumns({
        "alpha_over_benchmark_net": r - F.col("annualized_benchmark_return"),
        "sharpe_ratio": F.when(vol > 0, r / vol).otherwise(0.0),
        "calmar_ratio": F.when(dd < 0, r / F.abs(dd)).otherwise(0.0)}).drop("_days", "_benchmark")
