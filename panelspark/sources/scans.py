"""Scans of landed files and tables, and the normalisation each source needs.

Text sources are read with string columns (no inference pass over the data) and cast
explicitly.  Network clients are out of scope: their output is expected as landed files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.contract import DATE, KEY, SPLIT, TICKER, TRAIN
from panelspark.session import missing_to_null

# --- panels ---------------------------------------------------------------------------------------


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """Parquet panel with NaN as NULL; a missing path fails at analysis."""
    return missing_to_null(spark.read.parquet(path))


def load_split_panel(spark: SparkSession, path: str, splits: list[str], columns: list[str] | None = None) -> DataFrame:
    """Requested columns that exist, rows of the allowed splits; both reach the Parquet scan."""
    raw = spark.read.parquet(path)
    if columns is not None:
        wanted = list(dict.fromkeys([*KEY, SPLIT, *columns]))
        raw = raw.select(*[c for c in wanted if c in raw.columns])
    return missing_to_null(raw.where(F.col(SPLIT).isin(*splits)))


def load_sampled_train(spark: SparkSession, path: str, sampled_dates: DataFrame, columns: list[str]) -> DataFrame:
    """Train rows of the sampled dates; the split and the last date are pushed into the scan."""
    cutoff = sampled_dates.agg(F.max(DATE)).first()[0]
    if cutoff is None:
        raise ValueError("no sampled train dates")
    rows = load_split_panel(spark, path, [TRAIN], columns).where(F.col(DATE) <= F.lit(cutoff))
    return rows.join(F.broadcast(sampled_dates.select(DATE)), DATE, "left_semi")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _need(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _with_ticker(df: DataFrame, *aliases: str) -> DataFrame:
    for alias in aliases:
        if alias in df.columns and TICKER not in df.columns:
            df = df.withColumnRenamed(alias, TICKER)
    return _need(df, TICKER)


# --- reference files --------------------------------------------------------------------------------


def load_membership(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Intervals overlapping [start, end], clipped to it, distinct."""
    df = _need(_with_ticker(_csv(spark, path), "symbol"), "start_date", "end_date")
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    a, b = F.to_date("start_date"), F.to_date("end_date")
    return (df.where((b >= s) & (a <= e))
            .select(F.trim(TICKER).alias(TICKER), F.greatest(a, s).alias("start_date"), F.least(b, e).alias("end_date")).distinct())


def load_fundamentals(spark: SparkSession, path: str, numeric: tuple[str, ...] = ()) -> DataFrame:
    df = _need(_with_ticker(_csv(spark, path), "symbol"), DATE)
    return df.withColumns({TICKER: F.trim(TICKER), DATE: F.to_date(DATE),
                           **{c: F.col(c).try_cast("double") for c in numeric if c in df.columns}})


QUARTERLY_NUMBERS = ("prccq", "cshoq", "epspxq", "ceqq", "actq", "lctq", "niq", "saleq", "dlttq", "dlcq", "cheq")


def load_quarterly_extract(spark: SparkSession, path: str) -> DataFrame:
    """Quarterly fundamentals: ticker under any of three names, ``datadate`` needed, ``rdq`` optional."""
    return quarterly_extract(_csv(spark, path))


def quarterly_extract(raw: DataFrame) -> DataFrame:
    df = _need(_with_ticker(raw, "tic", "symbol"), "datadate")
    numbers = {c: F.col(c).try_cast("double") for c in QUARTERLY_NUMBERS if c in df.columns}
    released = F.to_date("rdq") if "rdq" in df.columns else F.lit(None).cast("date")
    return df.withColumns({TICKER: normalize_symbol(F.col(TICKER)), "datadate": F.to_date("datadate"), "rdq": released, **numbers})


SPEC_SCHEMA = """symbol string, instrument_group string, currency string, spread_bps double, slippage_bps double,
 long_swap_bps_daily double, short_swap_bps_daily double, margin_requirement double, max_adv_participation double,
 effective_from date, effective_to date, commission_rate double, monthly_commission_free_turnover_eur double,
 minimum_commission_eur double, minimum_order_value_eur double, fx_conversion_bps double, annual_custody_fee_rate double,
 custody_fee_threshold_eur double, monthly_custody_fee_min_eur double, supports_fractional_orders boolean"""
# Defaults of the optional spec fields.
SPEC_DEFAULTS = {"commission_rate": 0.002, "monthly_commission_free_turnover_eur": 100_000.0, "minimum_commission_eur": 10.0,
                 "minimum_order_value_eur": 10.0, "fx_conversion_bps": 50.0, "annual_custody_fee_rate": 0.0002,
                 "custody_fee_threshold_eur": 250_000.0, "monthly_custody_fee_min_eur": 10.0, "supports_fractional_orders": True}


def with_spec_defaults(specs: DataFrame) -> DataFrame:
    known = [c for c in SPEC_DEFAULTS if c in specs.columns]
    return specs.withColumns({c: F.coalesce(c, F.lit(SPEC_DEFAULTS[c])) if c in known else F.lit(SPEC_DEFAULTS[c])
                              for c in SPEC_DEFAULTS})


def load_instrument_specs(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame:
    """Spec records with defaults filled in; ``default`` rows are added for symbols not present."""
    specs = with_spec_defaults(spark.read.schema(SPEC_SCHEMA).option("multiLine", True).json(path))
    if default is None:
        return specs
    return specs.unionByName(with_spec_defaults(default).join(specs.select("symbol").distinct(), "symbol", "left_anti"))


EARNINGS_COLUMNS = (TICKER, "announcement_date", "announcement_session", "fiscal_year", "fiscal_quarter")
EARNINGS_SESSIONS = ("before_open", "after_close", "unknown")


def load_earnings(spark: SparkSession, path: str) -> DataFrame:
    return earnings_events(_need(_csv(spark, path), *EARNINGS_COLUMNS))


def earnings_events(raw: DataFrame) -> DataFrame:
    """Known sessions only; ``unknown`` rows go and any other session is an error."""
    session = F.lower("announcement_session")
    checked = F.when(session.isin(*EARNINGS_SESSIONS), session).otherwise(
        F.raise_error(F.concat(F.lit("unsupported announcement_session: "), session)))
    return (raw.select(TICKER, F.to_date("announcement_date").alias("announcement_date"), checked.alias("announcement_session"),
                       F.col("fiscal_year").cast("bigint").alias("fiscal_year"), F.col("fiscal_quarter").cast("bigint").alias("fiscal_quarter"))
            .where(F.col("announcement_session") != "unknown"))


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    return _need(_csv(spark, path), "symbol", "provider_symbol").select("symbol", "provider_symbol").distinct()


def provider_symbols(symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add the two provider spellings: alias or dots as dashes, and lower case with '.us'."""
    known = symbols.join(aliases, "symbol", "left")
    return known.select(*symbols.columns,
                        F.coalesce("provider_symbol", F.translate("symbol", ".", "-")).alias("dashed_symbol"),
                        F.concat(F.lower(F.coalesce("provider_symbol", "symbol")), F.lit(".us")).alias("lower_symbol"))


def normalize_symbol(symbol: Column) -> Column:
    return F.translate(F.trim(symbol), "-", ".")


def normalize_symbols(df: DataFrame, source: str, known: DataFrame | None = None) -> DataFrame:
    """Add ``ticker``: trimmed, '-' as '.', unless the trimmed symbol is itself known."""
    trimmed = F.trim(source)
    if known is None:
        return df.withColumn(TICKER, normalize_symbol(F.col(source)))
    marks = known.select(F.col(TICKER).alias("_known")).distinct()
    return (df.withColumn("_trim", trimmed).join(marks, F.col("_trim") == F.col("_known"), "left")
            .withColumn(TICKER, F.coalesce("_known", F.translate("_trim", "-", "."))).drop("_trim", "_known"))


def first_per_ticker(df: DataFrame, order: list[Column]) -> DataFrame:
    """First row per ticker in the given order; an aggregate, so copies collapse before the shuffle."""
    values = F.struct(*df.columns)
    return df.groupBy(TICKER).agg(F.min_by(values, F.struct(*order)).alias("_r")).select("_r.*")


CONSTITUENT_NAMES = {"Security": "company_name", "GICS Sector": "sector", "GICS Sub-Industry": "industry"}
FINANCIAL_NAMES = {"Name": "company_name", "Price": "price", "Market Cap": "market_cap", "Price/Earnings": "trailing_p_e",
                   "Price/Book": "price_to_book", "Earnings/Share": "trailing_eps"}


def constituents(raw: DataFrame, symbol: str = "Symbol") -> DataFrame:
    df = normalize_symbols(raw, symbol).withColumnsRenamed(CONSTITUENT_NAMES)
    return first_per_ticker(df.select(TICKER, *CONSTITUENT_NAMES.values()), [F.col(c) for c in CONSTITUENT_NAMES.values()])


def financials(raw: DataFrame, known: DataFrame | None = None, symbol: str = "Symbol") -> DataFrame:
    df = normalize_symbols(raw, symbol, known).withColumnsRenamed(FINANCIAL_NAMES)
    df = df.select(TICKER, "company_name", *[F.col(c).try_cast("double").alias(c) for c in list(FINANCIAL_NAMES.values())[1:]])
    return first_per_ticker(df, [F.col(c) for c in FINANCIAL_NAMES.values()])


def _match_names(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns by their trimmed lower-case header."""
    return raw.withColumnsRenamed({c: names[c.strip().lower()] for c in raw.columns if c.strip().lower() in names})


def survey_table(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Investor survey: bullish / neutral / bearish shares by date; bad dates go."""
    df = _match_names(raw, {"date": DATE, "bullish": "aaii_bullish", "neutral": "aaii_neutral", "bearish": "aaii_bearish"})
    _need(df, DATE, "aaii_bullish", "aaii_neutral", "aaii_bearish")
    day = F.try_to_timestamp(F.col(DATE).cast("string")).cast("date")
    return (df.select(day.alias(DATE), "aaii_bullish", "aaii_neutral", "aaii_bearish")
            .where(F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date"))))


def risk_index_table(raw: DataFrame, start: str, end: str) -> DataFrame:
    names = {"month": DATE, "date": DATE, "gpr": "gpr_index", "gprd": "gpr_index", "gpr_act": "gpr_act", "gpr_threat": "gpr_threat"}
    df = _need(_match_names(raw, names), DATE, "gpr_index")
    kept = [c for c in ("gpr_index", "gpr_act", "gpr_threat") if c in df.columns]
    return (df.select(F.to_date(DATE).alias(DATE), *kept)
            .where(F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date"))))


OHLCV_NAMES = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
OHLCV = ("open", "high", "low", "close", "adj_close", "volume")
ADJUSTED_NAMES = {"adjClose": "adj_close", "adjOpen": "open", "adjHigh": "high", "adjLow": "low", "adjVolume": "volume"}


def provider_prices(raw: DataFrame) -> DataFrame:
    """Known OHLCV columns; rows without any value go; ``adj_close`` defaults to ``close``."""
    df = raw.withColumnsRenamed(OHLCV_NAMES)
    if "adj_close" not in df.columns and "close" in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    kept = [c for c in OHLCV if c in df.columns]
    return df.select(*KEY, *kept).dropna(how="all", subset=kept)


def adjusted_provider_prices(raw: DataFrame) -> DataFrame:
    """A provider that also delivers adjusted fields: they replace the raw ones, and the raw
    close has no adjusted twin of its own name."""
    df = raw.drop("close", "high", "low", "open", "volume").withColumnsRenamed(ADJUSTED_NAMES)
    kept = [c for c in OHLCV if c in df.columns]
    return df.select(*KEY, *kept).dropna(how="all", subset=kept)


def provider_fallback(*providers: DataFrame) -> DataFrame:
    """Whole-ticker priority: a later provider only serves tickers absent from all earlier ones."""
    out = providers[0]
    for later in providers[1:]:
        out = out.unionByName(later.join(out.select(TICKER).distinct(), TICKER, "left_anti"), allowMissingColumns=True)
    return out


def symbol_variants(symbol: Column) -> Column:
    """Spellings of a symbol with dots and dashes kept, swapped or removed, upper case."""
    base = F.upper(F.trim(symbol))
    return F.array_distinct(F.array(base, F.translate(base, ".", ""), F.translate(base, ".", "-"),
                                    F.translate(base, "-", ""), F.translate(base, "-", ".")))


def resolve_securities(requested: DataFrame, securities: DataFrame, extra_aliases: DataFrame | None = None) -> DataFrame:
    """Best security row per requested ticker: exact tic, exact ibtic, active, open-ended, lowest iid.

    ``extra_aliases`` (ticker, alias) adds hand-kept names, each with its own spellings.
    """
    names = requested.select(F.upper(F.trim(TICKER)).alias("requested_ticker")).where("requested_ticker <> ''").distinct()
    spelled = names.select("requested_ticker", F.explode(symbol_variants(F.col("requested_ticker"))).alias("variant"))
    if extra_aliases is not None:
        more = names.join(extra_aliases.select(F.upper(TICKER).alias("requested_ticker"), "alias"), "requested_ticker")
        spelled = spelled.unionByName(more.select("requested_ticker", F.explode(symbol_variants(F.col("alias"))).alias("variant"))).distinct()
    s = securities.withColumns({"tic": F.upper("tic"), "ibtic": F.upper(F.coalesce("ibtic", F.lit("")))})
    # Two equi joins instead of one OR join.
    hits = (spelled.join(s, F.col("variant") == F.col("tic")).unionByName(spelled.join(s, F.col("variant") == F.col("ibtic"))))
    better = F.struct((F.col("tic") != F.col("requested_ticker")).alias("a"), (F.col("ibtic") != F.col("requested_ticker")).alias("b"),
                      (~F.coalesce(F.col("secstat") == "A", F.lit(False))).alias("c"), F.col("dldtei").isNotNull().alias("d"),
                      F.col("iid").alias("e"), F.col("gvkey").alias("f"))
    return hits.groupBy("requested_ticker").agg(
        F.min_by("gvkey", better).alias("gvkey"), F.min_by("tic", better).alias("source_ticker"))


def quarterly_history(fundq: DataFrame, resolved: DataFrame, start: str, end: str) -> DataFrame:
    """Standardised industrial, domestic, consolidated quarters of the resolved securities."""
    standard = (F.col("indfmt") == "INDL") & (F.col("datafmt") == "STD") & (F.col("popsrc") == "D") & (F.col("consol") == "C")
    rows = fundq.where(F.col("datadate").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & standard)
    return rows.drop("indfmt", "datafmt", "popsrc", "consol").join(resolved, "gvkey")


# Symbol spellings in the broker text and their exchange form.
SYMBOL_FORM = {"BFB": "BF.B", "BRKB": "BRK.B"}
SYMBOL = r"([A-Z0-9]{1,8}(?:\.[A-Z0-9])?)\s*\.US\*?"
CLOSE_ONLY = SYMBOL + r"CLOSE ONLY\s*/"


def extract_symbols(texts: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Distinct exchange symbols named in a text table, with where each is first seen; symbols that
    are anywhere marked close-only are left out."""
    closed = texts.select(F.explode(F.regexp_extract_all(text, F.lit(CLOSE_ONLY), F.lit(1))).alias("raw")).distinct()
    found = texts.select(order, F.posexplode(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(1))).alias("position", "raw"))
    form = F.create_map(*[F.lit(x) for pair in SYMBOL_FORM.items() for x in pair])
    return (found.join(closed, "raw", "left_anti").withColumn("symbol", F.coalesce(form[F.col("raw")], F.col("raw")))
            .groupBy("symbol").agg(F.min(F.struct(order, "position")).alias("_first"))
            .select("symbol", F.col(f"_first.{order}").alias(order), F.col("_first.position").alias("position")))


# --- observation tables -------------------------------------------------------------------------------


def stale_filled(observations: DataFrame, sessions: DataFrame, lag: Column | int, limit: int | None | dict[str, int],
                 names: list[str], key: str = "series") -> DataFrame:
    """One column per series on every session: availability shift, then a fill at most ``limit``
    sessions old (None: any age; a dict gives it per series)."""
    from panelspark.operators.calendars import day_window, distinct_dates
    from panelspark.operators.joins import shift_to_availability
    placed = shift_to_availability(observations, sessions, lag, key)
    wide = placed.groupBy(DATE).pivot(key, names).agg(F.first("value"))
    spine = distinct_dates(sessions).join(wide, DATE, "left")

    def fill(name: str) -> Column:
        age = limit[name] if isinstance(limit, dict) else limit
        start = Window.unboundedPreceding if age is None else -age
        return F.last(name, True).over(day_window().rowsBetween(start, 0))
    return spine.select(DATE, *[fill(n).alias(n.lower()) for n in names])


# Publication lag and fill limit in sessions by frequency.
FREQUENCY_LAG = {"daily": 1, "weekly": 5, "monthly": 22, "quarterly": 66}
FREQUENCY_LIMIT = {"daily": 5, "weekly": 15, "monthly": 45, "quarterly": 130}
SURVEY_LAG, RISK_INDEX_LAG = 5, 22


def macro_panel(observations: DataFrame, sessions: DataFrame, frequency: dict[str, str]) -> DataFrame:
    """Macro series by their frequency; a series of unknown frequency counts as daily."""
    names = sorted(frequency)
    lags = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(FREQUENCY_LAG.get(frequency[n], 1)))])
    limits = {n: FREQUENCY_LIMIT.get(frequency[n], FREQUENCY_LIMIT["daily"]) for n in names}
    return stale_filled(observations, sessions, lags[F.col("series")], limits, names)


def sentiment_panel(observations: DataFrame, sessions: DataFrame, lags: dict[str, int]) -> DataFrame:
    """Survey and risk-index series with their own lag, filled without limit."""
    names = sorted(lags)
    lag = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(lags[n]))])
    return stale_filled(observations, sessions, lag[F.col("series")], None, names)


# Short names of the cross-asset symbols.
CROSS_ASSET_NAMES = {"^N225": "nikkei", "^GDAXI": "dax", "^FTSE": "ftse", "^HSI": "hangseng", "000001.SS": "shanghai", "GC=F": "gold"}


def cross_asset_name(symbol: str) -> str:
    return CROSS_ASSET_NAMES.get(symbol, symbol.lower().replace("-", "_").replace("=", "").replace("^", ""))


def pivot_cross_assets(prices: DataFrame, symbols: list[str]) -> DataFrame:
    """(date, ticker, adj_close) -> one ``xa_`` column per symbol, the mean on repeats."""
    wide = prices.groupBy(DATE).pivot(TICKER, symbols).agg(F.avg("adj_close"))
    return wide.withColumnsRenamed({s: f"xa_{cross_asset_name(s)}" for s in symbols})
