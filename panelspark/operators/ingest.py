"""Ingestion transforms: renames, price adjustment, log returns, beta fill, fundamentals, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.contract import DATE, TICKER
from panelspark.functions import rolling as R
from panelspark.functions.crosssection import with_group_stats
from panelspark.functions.scalar import ratio, ratio_present
from panelspark.sources.scans import first_per_ticker

# Published column names of the merged panel.
COLUMN_NAMES = {
    "open": "stock_open_price",
    "high": "stock_high_price",
    "low": "stock_low_price",
    "close": "stock_close_price",
    "open_log_return": "stock_open_log_return",
    "high_log_return": "stock_high_log_return",
    "low_log_return": "stock_low_log_return",
    "close_log_return": "stock_close_log_return",
    "adj_close_log_return": "stock_adjusted_close_log_return",
    "volume": "stock_trading_volume",
    "sector": "company_sector",
    "industry": "company_industry",
    "market_cap": "company_market_cap_usd",
    "trailing_p_e": "company_trailing_pe_ratio",
    "price_to_book": "company_price_to_book_ratio",
    "beta": "company_beta",
    "profit_margins": "company_profit_margin_ratio",
    "return_on_equity": "company_return_on_equity_ratio",
    "enterprise_value": "company_enterprise_value_usd",
    "revenue_growth": "company_revenue_growth_ratio",
    "current_ratio": "company_current_ratio",
    "book_value": "company_book_value_per_share_usd",
    "trailing_eps": "company_trailing_eps_usd",
    "is_fomc_day": "calendar_is_fomc_announcement_day",
    "days_to_next_fomc": "calendar_days_until_next_fomc",
    "days_since_last_fomc": "calendar_days_since_previous_fomc",
    "is_fomc_week": "calendar_is_fomc_week",
    "is_quad_witching": "calendar_is_quadruple_witching_day",
    "days_to_next_quad_witching": "calendar_days_until_next_quadruple_witching",
    "aaii_bullish": "sentiment_aaii_bullish_share",
    "aaii_neutral": "sentiment_aaii_neutral_share",
    "aaii_bearish": "sentiment_aaii_bearish_share",
    "gpr_index": "sentiment_geopolitical_risk_index",
    "xa_dax_log_return": "cross_asset_dax_log_return",
    "xa_ftse_log_return": "cross_asset_ftse100_log_return",
    "xa_gold_log_return": "cross_asset_gold_log_return",
    "xa_hangseng_log_return": "cross_asset_hang_seng_log_return",
    "xa_nikkei_log_return": "cross_asset_nikkei225_log_return",
    "xa_shanghai_log_return": "cross_asset_shanghai_composite_log_return",
    "xa_tlt_log_return": "cross_asset_tlt_log_return",
    "xa_xlb_log_return": "cross_asset_materials_etf_log_return",
    "xa_xle_log_return": "cross_asset_energy_etf_log_return",
    "xa_xlf_log_return": "cross_asset_financials_etf_log_return",
    "xa_xli_log_return": "cross_asset_industrials_etf_log_return",
    "xa_xlk_log_return": "cross_asset_technology_etf_log_return",
    "xa_xlp_log_return": "cross_asset_consumer_staples_etf_log_return",
    "xa_xlu_log_return": "cross_asset_utilities_etf_log_return",
    "xa_xlv_log_return": "cross_asset_health_care_etf_log_return",
    "xa_xly_log_return": "cross_asset_consumer_discretionary_etf_log_return",
    "dgs5": "macro_us_treasury_5y_yield_pct",
    "dgs2": "macro_us_treasury_2y_yield_pct",
    "dgs10": "macro_us_treasury_10y_yield_pct",
    "dgs1": "macro_us_treasury_1y_yield_pct",
    "dgs30": "macro_us_treasury_30y_yield_pct",
    "dtb3": "macro_us_tbill_3m_yield_pct",
    "t10y2y": "macro_us_yield_spread_10y_minus_2y_pct",
    "t10y3m": "macro_us_yield_spread_10y_minus_3m_pct",
    "dff": "macro_us_fed_funds_effective_rate_pct",
    "dfii10": "macro_us_tips_10y_real_yield_pct",
    "t10yie": "macro_us_breakeven_inflation_10y_pct",
    "t5yie": "macro_us_breakeven_inflation_5y_pct",
    "t5yifr": "macro_us_forward_inflation_5y5y_pct",
    "bamlh0a0hym2": "macro_us_high_yield_oas_pct",
    "bamlc0a0cm": "macro_us_investment_grade_oas_pct",
    "vixcls": "macro_vix_close_level",
    "dcoilwtico": "macro_wti_crude_oil_price_usd",
    "dcoilbrenteu": "macro_brent_crude_oil_price_usd",
    "dtwexbgs": "macro_us_dollar_trade_weighted_index",
    "dhhngsp": "macro_henry_hub_natural_gas_price_usd",
    "dexjpus": "macro_fx_jpy_per_usd",
    "dexchus": "macro_fx_cny_per_usd",
    "usepuindxd": "macro_us_economic_policy_uncertainty_index",
    "dexuseu": "macro_fx_usd_per_eur",
    "walcl": "macro_fed_total_assets_usd_millions",
    "dexusuk": "macro_fx_usd_per_gbp",
    "stlfsi4": "macro_stl_financial_stress_index",
    "nfci": "macro_chicago_financial_conditions_index",
    "cpiaucsl": "macro_us_cpi_all_items_index",
    "cpilfesl": "macro_us_core_cpi_index",
    "pcepi": "macro_us_pce_price_index",
    "pcepilfe": "macro_us_core_pce_price_index",
    "unrate": "macro_us_unemployment_rate_pct",
    "mortgage30us": "macro_us_mortgage_rate_30y_pct",
    "payems": "macro_us_nonfarm_payrolls_thousands",
    "awhman": "macro_us_avg_weekly_hours_manufacturing",
    "ces0500000003": "macro_us_avg_hourly_earnings_usd",
    "jtsjol": "macro_us_jolts_job_openings_thousands",
    "indpro": "macro_us_industrial_production_index",
    "rsafs": "macro_us_retail_sales_millions_usd",
    "dgorder": "macro_us_durable_goods_orders_millions_usd",
    "totalsa": "macro_us_total_vehicle_sales_millions",
    "bopgstb": "macro_us_trade_balance_goods_services_millions_usd",
    "houst": "macro_us_housing_starts_thousands",
    "permit": "macro_us_building_permits_thousands",
    "csushpisa": "macro_us_case_shiller_home_price_index",
    "m2sl": "macro_us_m2_money_supply_billions_usd",
    "umcsent": "macro_us_consumer_sentiment_index",
    "cp0000ez19m086nest": "macro_euro_area_hicp_index",
    "lrhuttttezm156s": "macro_euro_area_unemployment_rate_pct",
    "irltlt01ezm156n": "macro_euro_area_long_term_rate_pct",
    "irstci01ezm156n": "macro_euro_area_short_term_rate_pct",
    "chncpiallminmei": "macro_china_cpi_index",
    "gdpc1": "macro_us_real_gdp_billions_chained_2017_usd",
    "a191rl1q225sbea": "macro_us_real_gdp_growth_rate_qoq_annualized_pct",
    "cp": "macro_us_corporate_profits_after_tax_billions_usd",
    "clvmnacscab1gqea19": "macro_euro_area_real_gdp_index",
}


def rename_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in COLUMN_NAMES.items() if old in df.columns})


def drop_raw_levels(df: DataFrame) -> DataFrame:
    """Drop adj_close and cross-asset levels, keep their log returns."""
    return df.drop(*[c for c in df.columns if c == "adj_close" or (c.startswith("xa_") and not c.endswith("_log_return"))])


def adjust_prices(df: DataFrame) -> DataFrame:
    """Multiply O, H, L, C by adj_close / close; where that is unknown, by 1."""
    if not {"adj_close", "close"} <= set(df.columns):
        return df
    factor = F.coalesce(F.when(F.col("close") > 0, F.col("adj_close") / F.col("close")), F.lit(1.0))
    return df.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close") if c in df.columns})


def add_log_returns(df: DataFrame) -> DataFrame:
    """``<c>_log_return`` for price columns and cross assets; a price <= 0 has none."""
    names = [c for c in df.columns if c in ("open", "high", "low", "close", "adj_close") or (
        c.startswith("xa_") and not c.endswith("_log_return"))]

    def log_of(c: str) -> Column:
        return F.when(F.col(c) > 0, F.log(c))
    return df.withColumns({f"{c}_log_return": log_of(c) - R.lag(log_of(c)) for c in names})


def fill_beta(df: DataFrame, window: int = 252, minimum: int = 63) -> DataFrame:
    """Missing ``beta`` := (E[rm] - E[r]E[m]) / var(m) over the rolling window, m the date mean.

    The numerator is a population moment and the denominator a sample variance; kept so.
    """
    x = F.col("adj_close_log_return")
    df = with_group_stats(df, [DATE], {"_m": F.avg(x)}).withColumn("_xm", x * F.col("_m"))
    covariance = R.mean("_xm", window, minimum) - R.mean(x, window, minimum) * R.mean("_m", window, minimum)
    proxy = ratio(covariance, R.var("_m", window, minimum))
    return df.withColumn("beta", F.coalesce(F.col("beta"), proxy)).drop("_m", "_xm")


# Name columns in order of preference.
NAME_COLUMNS = ("company_name", "company_long_name", "company_short_name", "security", "name")


def company_listing(panel: DataFrame, membership: DataFrame | None = None, snapshot: DataFrame | None = None) -> DataFrame:
    """(ticker, company_name): first non-blank name over the candidate columns, then membership,
    then the snapshot, else blank."""
    present = [c for c in NAME_COLUMNS if c in panel.columns]
    blank_free = {c: F.nullif(F.trim(c), F.lit("")) for c in present}
    names = panel.groupBy(TICKER).agg(F.count("*").alias("_n"), *[
        F.min_by(F.when(blank_free[c].isNotNull(), F.col(c)), F.when(blank_free[c].isNotNull(), F.col(DATE))).alias(f"_{c}") for c in present])
    sources = [F.col(f"_{c}") for c in present]
    for i, extra in enumerate(x for x in (membership, snapshot) if x is not None):
        column = next((c for c in NAME_COLUMNS if c in extra.columns), None)
        if column is None:
            continue
        known = extra.where(F.trim(column) != "").groupBy(TICKER).agg(F.min(column).alias(f"_extra{i}"))
        names = names.join(known, TICKER, "left")
        sources.append(F.col(f"_extra{i}"))
    return names.select(TICKER, F.coalesce(*sources, F.lit("")).alias("company_name"))


# --- fundamentals --------------------------------------------------------------------------------------------

EVENT, STRUCTURAL, PROXY = "wrds_event", "bootstrap_structural", "bootstrap_proxy"
NUMBERS = ("market_cap", "trailing_p_e", "price_to_book", "beta", "profit_margins", "return_on_equity", "enterprise_value",
           "revenue_growth", "current_ratio", "book_value", "trailing_eps")
FUNDAMENTAL_COLUMNS = (DATE, TICKER, "company_name", "sector", "industry", *NUMBERS, "fundamentals_provenance")
PUBLICATION_DAYS = 45


def static_names(df: DataFrame, constituents: DataFrame) -> DataFrame:
    """Left join name, sector and industry; the ticker stands in for a missing name."""
    static = first_per_ticker(constituents.select(TICKER, "company_name", "sector", "industry"),
                              [F.col(c) for c in ("company_name", "sector", "industry")])
    return df.join(static, TICKER, "left").withColumn("company_name", F.coalesce("company_name", TICKER))


def quarterly_ratios(fundq: DataFrame, membership: DataFrame, constituents: DataFrame, start: str, end: str) -> DataFrame:
    """Point-in-time ratios per quarter, dated when available (release date, else 45 days later)."""
    members = membership.select(TICKER).distinct()
    available = F.coalesce(F.col("rdq"), F.date_add("datadate", PUBLICATION_DAYS))
    df = (fundq.join(members, TICKER, "left_semi").withColumn(DATE, available)
          .where(F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    for c in ("dlttq", "dlcq", "cheq"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    million = 1_000_000.0
    df = df.withColumns({"market_cap": F.col("prccq") * F.col("cshoq") * million, "trailing_eps": F.col("epspxq"),
                         "book_value": ratio_present("ceqq", "cshoq")})
    debt_known = F.coalesce("dlttq", "dlcq", "cheq").isNotNull()

    def or_zero(c):
        return F.coalesce(F.col(c), F.lit(0.0)) * million
    df = df.withColumns({
        "trailing_p_e": ratio_present("prccq", "trailing_eps"), "price_to_book": ratio_present("prccq", "book_value"),
        "current_ratio": ratio_present("actq", "lctq"), "profit_margins": ratio_present("niq", "saleq"),
        "return_on_equity": ratio_present("niq", "ceqq"), "beta": F.lit(None).cast("double"),
        "revenue_growth": ratio("saleq", F.lag("saleq", 4).over(R.ticker_window(order=("datadate",)))) - 1.0,
        "enterprise_value": F.when(debt_known, F.col("market_cap") + or_zero("dlttq") + or_zero("dlcq") - or_zero("cheq")),
        "fundamentals_provenance": F.lit(EVENT)})
    return static_names(df, constituents).select(*FUNDAMENTAL_COLUMNS)


def bootstrap_fundamentals(membership: DataFrame, constituents: DataFrame, financials: DataFrame, start: str, end: str) -> DataFrame:
    """A structural row at the start (numbers missing) and a proxy row at the end per ticker; a
    proxy row without any anchor number is left out."""
    anchors = ("market_cap", "trailing_p_e", "price_to_book", "trailing_eps")
    base = (membership.select(TICKER).distinct().join(constituents.select(TICKER, "company_name", "sector", "industry"), TICKER, "left")
            .join(financials.withColumnRenamed("company_name", "_name"), TICKER, "left")
            .withColumn("company_name", F.coalesce("company_name", "_name", TICKER)))
    nothing = F.lit(None).cast("double")
    structural = base.select(F.lit(start).cast("date").alias(DATE), TICKER, "company_name", "sector", "industry",
                             *[nothing.alias(c) for c in NUMBERS], F.lit(STRUCTURAL).alias("fundamentals_provenance"))
    book = F.when((F.col("price") > 0) & (F.col("price_to_book") > 0), F.col("price") / F.col("price_to_book"))
    kept = {**{c: F.col(c) for c in anchors}, "book_value": book}
    proxy = (base.where(F.coalesce(*anchors).isNotNull())
             .select(F.lit(end).cast("date").alias(DATE), TICKER, "company_name", "sector", "industry",
                     *[kept.get(c, nothing).alias(c) for c in NUMBERS], F.lit(PROXY).alias("fundamentals_provenance")))
    return structural.unionByName(proxy)


def with_bootstrap(history: DataFrame, membership: DataFrame, constituents: DataFrame, financials: DataFrame, start: str, end: str) -> DataFrame:
    """Primary rows plus bootstrap rows for member tickers that have none."""
    if "fundamentals_provenance" not in history.columns:
        history = history.withColumn("fundamentals_provenance", F.lit(EVENT))
    unresolved = membership.join(history.select(TICKER).distinct(), TICKER, "left_anti")
    return history.unionByName(bootstrap_fundamentals(unresolved, constituents, financials, start, end))


def earnings_from_fundamentals(history: DataFrame) -> DataFrame:
    """Distinct (ticker, date) of event rows as announcements of unknown session."""
    events = (history.where((F.trim("fundamentals_provenance") == EVENT) & F.col(DATE).isNotNull() & (F.trim(TICKER) != ""))
              .select(F.trim(TICKER).alias(TICKER), DATE).distinct())
    return events.select(TICKER, F.col(DATE).alias("announcement_date"), F.lit("unknown").alias("announcement_session"),
                         F.year(DATE).cast("bigint").alias("fiscal_year"), F.quarter(DATE).cast("bigint").alias("fiscal_quarter"))
