"""Registered queries: sources, sinks, ingestion, point-in-time and interval joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from panelspark import contract as K
from panelspark.contract import CLOSE, DATE, KEY, OPEN, SECTOR, SPLIT, TICKER, VOLUME
from panelspark.functions import scalar as S
from panelspark.operators import calendars as C
from panelspark.operators import ingest as I
from panelspark.operators import joins as J
from panelspark.operators import labels as L
from panelspark.operators import market as M
from panelspark.operators import splits as SP
from panelspark.plans.q_market import EARN_SQL, SESSIONS_SQL, SPECS_SQL, earnings, specs
from panelspark.plans.q_panel import LAB, SPLIT_SQL, TEST_START, TRAIN_DATES
from panelspark.plans.registry import BARS, COMPANIES, D, PANEL, WINDOWS, out, query, r
from panelspark.plans.testbars import bars, companies, panel
from panelspark.session import scratch_folder, table
from panelspark.sources import scans as SC
from panelspark.sources import sinks as W

# --- scans ------------------------------------------------------------------------------------------


@query("r001_panel_scan", f"WITH {BARS} SELECT {D}, {r('CASE WHEN v > 1 THEN c END', CLOSE, 4)} FROM bars")
def _(spark, d):
    # Written with NaN where volume is 1; the scan gives NULL there.
    path = scratch_folder(spark, "panel")
    bars(spark, d).withColumn(CLOSE, F.when(F.col(VOLUME) > 1, F.col(CLOSE)).otherwise(float("nan"))).write.parquet(path)
    return out(SC.load_panel(spark, path), [CLOSE], digits=4)


def _split_path(spark, d):
    root = scratch_folder(spark, "splits")
    W.write_splits(SP.assign_splits(bars(spark, d), TEST_START), root)
    return root


@query("r002_projected_split_scan", f"WITH {SPLIT_SQL} SELECT {D}, dataset_split, {r('c', CLOSE, 4)} FROM bars JOIN dsp USING (date) WHERE dataset_split IN ('val', 'test')")
def _(spark, d):
    df = SC.load_split_panel(spark, _split_path(spark, d) + "/all", ["val", "test"], [CLOSE, "not_in_file"])
    return out(df, [CLOSE], keep=("date", "ticker", SPLIT), digits=4)


@query("r003_sampled_train_scan", f"""WITH {TRAIN_DATES}, cfg AS (SELECT count(*) AS n, least(count(*), greatest(40, CAST(ceil(0.25::DOUBLE * count(*)) AS BIGINT))) AS w FROM td),
  pos AS (SELECT DISTINCT CASE WHEN i = w - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1)::DOUBLE / (w - 1)::DOUBLE)) AS BIGINT) END AS p FROM (SELECT n, w, unnest(range(0, w)) AS i FROM cfg))
  SELECT {D}, {r('c', CLOSE, 4)} FROM bars WHERE date IN (SELECT date FROM td WHERE i - 1 IN (SELECT p FROM pos))""")
def _(spark, d):
    path = _split_path(spark, d) + "/all"
    dates = SP.temporal_date_sample(C.distinct_dates(SC.load_split_panel(spark, path, ["train"], [])), 0.25, 40)
    return out(SC.load_sampled_train(spark, path, dates, [CLOSE]), [CLOSE], digits=4)


# Membership spells: each bar keeps its ticker a member for its volume in days.
SPELL_SQL = BARS + ", iv AS (SELECT ticker, date AS start_date, date + CAST(v AS INT) AS end_date FROM bars)"


def _spells(spark, d):
    return bars(spark, d).select(TICKER, F.col(DATE).alias("start_date"), F.date_add(DATE, F.col(VOLUME).cast("int")).alias("end_date"))


@query("r004_interval_csv_scan", f"""WITH {SPELL_SQL} SELECT DISTINCT ticker, CAST(greatest(start_date, DATE '1996-01-01') AS VARCHAR) AS start_date,
  CAST(least(end_date, DATE '1998-12-31') AS VARCHAR) AS end_date FROM iv WHERE end_date >= DATE '1996-01-01' AND start_date <= DATE '1998-12-31'""")
def _(spark, d):
    path = scratch_folder(spark, "membership")
    _spells(spark, d).withColumnRenamed(TICKER, "symbol").write.option("header", True).csv(path)
    return out(SC.load_membership(spark, path, "1996-01-01", "1998-12-31"), keep=("ticker", "start_date", "end_date"))


FUND_SQL = """fund AS (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS market_cap,
  max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS trailing_eps FROM orders GROUP BY 1, 2)"""


def fundamentals(spark, d):
    """Customer-day order totals as a point-in-time history; trailing_eps is missing on many rows."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias(TICKER), F.to_date("o_orderdate").alias(DATE)).agg(
        F.sum("o_totalprice").alias("market_cap"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("trailing_eps"))


@query("r005_event_csv_scan", f"WITH {FUND_SQL} SELECT {D}, {r('market_cap', 'market_cap', 2)}, {r('trailing_eps', 'trailing_eps', 2)} FROM fund")
def _(spark, d):
    path = scratch_folder(spark, "fundamentals")
    fundamentals(spark, d).withColumnRenamed(TICKER, "symbol").write.option("header", True).csv(path)
    return out(SC.load_fundamentals(spark, path, ("market_cap", "trailing_eps")), ["market_cap", "trailing_eps"], digits=2)


# Quarterly extract from orders: one row per (customer, quarter), ticker with a dash.
QTR_SQL = """fq AS (SELECT 'C.' || CAST(o_custkey AS VARCHAR) AS ticker, date_trunc('quarter', o_orderdate)::DATE AS datadate,
  CASE WHEN o_custkey % 3 > 0 THEN date_trunc('quarter', o_orderdate)::DATE + 30 END AS rdq, sum(o_totalprice) / 1000 AS prccq, count(*)::DOUBLE AS cshoq,
  max(o_totalprice) / 100 AS epspxq, CASE WHEN o_custkey % 5 > 0 THEN sum(o_totalprice) / 10 END AS ceqq, max(o_totalprice) AS actq, min(o_totalprice) AS lctq, avg(o_totalprice) AS niq,
  sum(o_totalprice) AS saleq, CASE WHEN o_custkey % 2 = 0 THEN max(o_totalprice) / 7 END AS dlttq FROM orders GROUP BY o_custkey, 2, 3)"""


def quarterly(spark, d):
    key, q = F.col("o_custkey"), F.trunc("o_orderdate", "quarter").alias("datadate")
    p = F.col("o_totalprice")
    df = table(spark, d, "orders").groupBy(key, q).agg(
        (F.sum(p) / 1000).alias("prccq"), F.count("*").cast("double").alias("cshoq"), (F.max(p) / 100).alias("epspxq"),
        (F.sum(p) / 10).alias("ceqq"), F.max(p).alias("actq"), F.min(p).alias("lctq"), F.avg(p).alias("niq"),
        F.sum(p).alias("saleq"), (F.max(p) / 7).alias("dlttq"))
    return df.select(F.concat(F.lit("C-"), key.cast("string")).alias("tic"), "datadate",
                     F.when(key % 3 > 0, F.date_add("datadate", 30)).alias("rdq"), "prccq", "cshoq", "epspxq",
                     F.when(key % 5 > 0, F.col("ceqq")).alias("ceqq"), "actq", "lctq", "niq", "saleq",
                     F.when(key % 2 == 0, F.col("dlttq")).alias("dlttq"))


@query("r006_quarterly_extract_scan", f"""WITH {QTR_SQL} SELECT ticker, CAST(datadate AS VARCHAR) AS datadate, CAST(rdq AS VARCHAR) AS rdq, {r('saleq', 'saleq', 2)}, {r('ceqq', 'ceqq', 2)} FROM fq""")
def _(spark, d):
    path = scratch_folder(spark, "quarterly")
    quarterly(spark, d).write.option("header", True).csv(path)
    return out(SC.load_quarterly_extract(spark, path), ["saleq", "ceqq"], keep=("ticker", "datadate", "rdq"), digits=2)


@query("r007_instrument_spec_scan", f"""WITH {SPECS_SQL}, s AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 0.001::DOUBLE ELSE 0.002::DOUBLE END AS cr FROM specs)
  SELECT symbol, instrument_group, CAST(effective_from AS VARCHAR) AS effective_from, CAST(effective_to AS VARCHAR) AS effective_to, {r('spread_bps', 'spread_bps')},
  {r('cr', 'commission_rate')}, 100000.0::DOUBLE AS monthly_commission_free_turnover_eur FROM s
  UNION ALL SELECT '__default_stock__', 'stock_cash', '1995-01-01', NULL, 5.0::DOUBLE, 0.002::DOUBLE, 100000.0::DOUBLE""")
def _(spark, d):
    path = scratch_folder(spark, "specs")
    half = F.when(F.col("p_partkey") % 2 == 0, F.lit(0.001))
    specs(spark, d).withColumn("commission_rate", half).drop("p_partkey").write.json(path)
    values = {"symbol": "__default_stock__", "instrument_group": "stock_cash", "spread_bps": 5.0, "effective_from": date(1995, 1, 1)}
    schema = spark.read.schema(SC.SPEC_SCHEMA).json(path).schema
    default = spark.createDataFrame([tuple(values.get(f.name) for f in schema.fields)], schema)
    # One JSON object per line here; a snapshot file holds one array, read with multiLine.
    df = SC.with_spec_defaults(spark.read.schema(SC.SPEC_SCHEMA).json(path))
    df = df.unionByName(SC.with_spec_defaults(default).join(df.select("symbol").distinct(), "symbol", "left_anti"))
    return out(df, ["spread_bps", "commission_rate", "monthly_commission_free_turnover_eur"],
               keep=("symbol", "instrument_group", "effective_from", "effective_to"))


@query("r008_earnings_csv_scan", f"""WITH {EARN_SQL} SELECT ticker, CAST(ad AS VARCHAR) AS announcement_date, sess AS announcement_session, year(ad) AS fiscal_year,
  quarter(ad) AS fiscal_quarter FROM earn WHERE sess <> 'unknown'""")
def _(spark, d):
    path = scratch_folder(spark, "earnings")
    e = earnings(spark, d).withColumns({"announcement_session": F.upper("announcement_session"),
                                        "fiscal_year": F.year("announcement_date"), "fiscal_quarter": F.quarter("announcement_date")})
    e.write.option("header", True).csv(path)
    return out(SC.load_earnings(spark, path), keep=("ticker", "announcement_date", "announcement_session", "fiscal_year", "fiscal_quarter"))


# Symbols from part brands with a dot; every third size has an alias.
@query("r009_alias_map", """SELECT DISTINCT replace(p_brand, '#', '.') AS symbol,
  coalesce(CASE WHEN CAST(split_part(p_brand, '#', 2) AS INT) % 3 = 0 THEN 'ALIAS' || split_part(p_brand, '#', 2) END, replace(p_brand, '#', '-')) AS dashed_symbol,
  lower(coalesce(CASE WHEN CAST(split_part(p_brand, '#', 2) AS INT) % 3 = 0 THEN 'ALIAS' || split_part(p_brand, '#', 2) END, replace(p_brand, '#', '.'))) || '.us' AS lower_symbol FROM part""")
def _(spark, d):
    symbols = table(spark, d, "part").select(F.translate("p_brand", "#", ".").alias("symbol")).distinct()
    number = F.split_part("symbol", F.lit("."), F.lit(2))
    aliases = symbols.where(number.cast("int") % 3 == 0).select("symbol", F.concat(F.lit("ALIAS"), number).alias("provider_symbol"))
    return SC.provider_symbols(symbols, aliases)


@query("r010_constituent_snapshot", """SELECT replace(p_brand, '#', '.') AS ticker, min(p_name) AS company_name, arg_min(p_type, p_name || '|' || p_type) AS sector
  FROM part GROUP BY 1""")
def _(spark, d):
    raw = table(spark, d, "part").select(F.concat(F.lit(" "), F.translate("p_brand", "#", "-")).alias("Symbol"), F.col("p_name").alias("Security"),
                                         F.col("p_type").alias("GICS Sector"), F.col("p_size").cast("string").alias("GICS Sub-Industry"))
    return SC.constituents(raw).select(TICKER, "company_name", "sector")


@query("r011_survey_table", """SELECT CAST(date AS VARCHAR) AS date, floor(b * 10000 + 0.4871) / 10000 AS aaii_bullish, floor(n * 10000 + 0.4871) / 10000 AS aaii_neutral, floor(e * 10000 + 0.4871) / 10000 AS aaii_bearish FROM (
  SELECT CAST(ts AS DATE) AS date, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END)::DOUBLE AS b, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END)::DOUBLE AS n,
  sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END)::DOUBLE AS e FROM events GROUP BY 1) WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def _(spark, d):
    def part(kind):
        return F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0))
    raw = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias(" Date ")).agg(
        part("click").alias("Bullish"), part("view").alias("NEUTRAL "), part("error").alias("bearish"))
    broken = raw.limit(1).withColumn(" Date ", F.lit("see notes"))
    return out(SC.survey_table(raw.unionByName(broken), "2024-01-05", "2024-01-25"), ["aaii_bullish", "aaii_neutral", "aaii_bearish"], keep=("date",), digits=4)


@query("r012_risk_index_table", f"""SELECT CAST(date AS VARCHAR) AS date, {r('g', 'gpr_index', 4)}, {r('t', 'gpr_threat', 4)} FROM (SELECT CAST(ts AS DATE) AS date, avg(value) AS g, max(value) AS t FROM events GROUP BY 1)
  WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def _(spark, d):
    raw = table(spark, d, "events").groupBy(F.to_date("ts").alias("Month")).agg(F.avg("value").alias("GPRD"), F.max("value").alias("GPR_THREAT"))
    return out(SC.risk_index_table(raw, "2024-01-05", "2024-01-25"), ["gpr_index", "gpr_threat"], keep=("date",), digits=4)


def _raw_prices(spark, d):
    return bars(spark, d).select(DATE, TICKER, F.col(OPEN).alias("Open"), F.col(K.HIGH).alias("High"), F.col(K.LOW).alias("Low"),
                                 F.when(F.col(VOLUME) > 3, F.col(CLOSE)).alias("Close"), F.col(VOLUME).alias("Volume"), F.lit("x").alias("Note"))


@query("r013_provider_table", f"WITH {BARS} SELECT {D}, {r('o', 'open', 4)}, {r('CASE WHEN v > 3 THEN c END', 'close', 4)}, {r('CASE WHEN v > 3 THEN c END', 'adj_close', 4)} FROM bars")
def _(spark, d):
    return out(SC.provider_prices(_raw_prices(spark, d)), ["open", "close", "adj_close"], digits=4)


@query("r013_adjusted_provider_table", f"WITH {BARS} SELECT {D}, {r('c / 2', 'adj_close', 4)}, {r('o / 2', 'open', 4)} FROM bars")
def _(spark, d):
    raw = _raw_prices(spark, d).withColumnsRenamed({"Close": "close", "Open": "open", "High": "high", "Low": "low", "Volume": "volume"})
    raw = raw.join(bars(spark, d).select(*KEY, (F.col(CLOSE) / 2).alias("adjClose"), (F.col(OPEN) / 2).alias("adjOpen")), list(KEY))
    df = SC.adjusted_provider_prices(raw)
    assert df.columns == ["date", "ticker", "open", "adj_close"]
    return out(df, ["adj_close", "open"], digits=4)


@query("r014_provider_fallback", f"""WITH {BARS}, {COMPANIES}
  SELECT {D}, CASE WHEN balance > 6000 THEN 'first' WHEN balance > 1000 THEN 'second' ELSE 'third' END AS provider, {r('c', 'close', 4)} FROM bars LEFT JOIN companies USING (ticker)""")
def _(spark, d):
    # The first provider covers the largest accounts, the second more, the third all.
    base = bars(spark, d).select(DATE, TICKER, F.col(CLOSE).alias("close"))

    def covered(floor):
        chosen = companies(spark, d).where(F.col("account_balance") > floor).select(TICKER)
        return base.join(chosen, TICKER, "left_semi")
    return out(SC.provider_fallback(covered(6000).withColumn("provider", F.lit("first")),
                                    covered(1000).withColumn("provider", F.lit("second")),
                                    base.withColumn("provider", F.lit("third"))), ["close"], keep=("date", "ticker", "provider"), digits=4)


# Securities from part: tic with a dash, ibtic without; requested symbols with a dot.
@query("r015_security_alias_resolution", """WITH s AS (SELECT p_partkey AS gvkey, upper(replace(p_brand, '#', CASE WHEN p_size % 2 = 0 THEN '-' ELSE '.' END)) AS tic,
  CASE WHEN p_size % 3 = 0 THEN upper(replace(p_brand, '#', '')) ELSE '' END AS ibtic, CASE WHEN p_size % 4 = 0 THEN 'I' ELSE 'A' END AS st, p_size % 5 = 0 AS closed, p_size AS iid FROM part),
  q AS (SELECT DISTINCT upper(replace(p_brand, '#', '.')) AS rq FROM part),
  m AS (SELECT rq, s.*, row_number() OVER (PARTITION BY rq ORDER BY (tic = rq) DESC, (ibtic = rq) DESC, (st = 'A') DESC, closed, iid, gvkey) AS k
    FROM q JOIN s ON tic IN (rq, replace(rq, '.', '-'), replace(rq, '.', '')) OR ibtic IN (rq, replace(rq, '.', '-'), replace(rq, '.', '')))
  SELECT rq AS requested_ticker, gvkey, tic AS source_ticker FROM m WHERE k = 1""")
def _(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    s = p.select(F.col("p_partkey").alias("gvkey"), F.when(size % 2 == 0, F.translate("p_brand", "#", "-")).otherwise(F.translate("p_brand", "#", ".")).alias("tic"),
                 F.when(size % 3 == 0, F.translate("p_brand", "#", "")).alias("ibtic"), F.when(size % 4 == 0, "I").otherwise("A").alias("secstat"),
                 F.when(size % 5 == 0, F.lit("2001-01-01").cast("date")).alias("dldtei"), size.alias("iid"))
    wanted = p.select(F.translate("p_brand", "#", ".").alias(TICKER)).distinct()
    return SC.resolve_securities(wanted, s)


@query("r016_quarterly_history", f"""WITH {QTR_SQL}, st AS (SELECT fq.*, CAST(split_part(ticker, '.', 2) AS BIGINT) AS g FROM fq)
  SELECT g AS gvkey, CAST(datadate AS VARCHAR) AS datadate, 'N' || CAST(g AS VARCHAR) AS requested_ticker, {r('saleq', 'saleq', 2)} FROM st
  WHERE saleq > 100000 AND g IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND datadate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def _(spark, d):
    g = F.split_part("tic", F.lit("-"), F.lit(2)).cast("bigint")
    fq = quarterly(spark, d).select(g.alias("gvkey"), "datadate", "saleq", F.when(F.col("saleq") > 100000, "INDL").otherwise("FS").alias("indfmt"),
                                    F.lit("STD").alias("datafmt"), F.lit("D").alias("popsrc"), F.lit("C").alias("consol"))
    resolved = table(spark, d, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("gvkey"), F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("requested_ticker"))
    return out(SC.quarterly_history(fq, resolved, "1996-01-01", "1999-12-31"), ["saleq"], keep=("gvkey", "datadate", "requested_ticker"), digits=2)


# Text: part names followed by exchange symbols, some of them close-only.
TEXT_SQL = """txt AS (SELECT p_partkey AS id, p_name || ' ' || upper(substr(p_type, 1, 3)) || CAST(p_size AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN '.US* ' ELSE ' .US ' END
  || p_brand || ' BRK' || substr(p_name, 1, 1) || '.US' || CASE WHEN p_size % 7 = 0 THEN ' CLOSE ONLY' ELSE '' END || CASE WHEN p_size = 11 THEN upper(substr(p_type, 1, 3)) || '12.US*CLOSE ONLY /' ELSE '' END || ' BRKB.US' AS text FROM part)"""


@query("r017_symbol_extraction", f"""WITH {TEXT_SQL}, f AS (SELECT id, unnest(l) AS raw, unnest(range(len(l))) AS p FROM (SELECT id, regexp_extract_all(text, '{SC.SYMBOL}', 1) AS l FROM txt)),
  cl AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{SC.CLOSE_ONLY}', 1)) AS raw FROM txt),
  g AS (SELECT CASE raw WHEN 'BRKB' THEN 'BRK.B' WHEN 'BFB' THEN 'BF.B' ELSE raw END AS symbol, min(struct_pack(id := id, p := p)) AS m FROM f WHERE raw NOT IN (SELECT raw FROM cl) GROUP BY 1)
  SELECT symbol, m.id AS id, m.p::INT AS position FROM g""")
def _(spark, d):
    size, name, kind = F.col("p_size"), F.col("p_name"), F.upper(F.substring("p_type", 1, 3))
    text = F.concat(name, F.lit(" "), kind, size.cast("string"), F.when(size % 2 == 0, ".US* ").otherwise(" .US "), F.col("p_brand"),
                    F.lit(" BRK"), F.substring(name, 1, 1), F.lit(".US"), F.when(size % 7 == 0, " CLOSE ONLY").otherwise(""),
                    F.when(size == 11, F.concat(kind, F.lit("12.US*CLOSE ONLY /"))).otherwise(""), F.lit(" BRKB.US"))
    return SC.extract_symbols(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "id")


# --- sinks -----------------------------------------------------------------------------------------------


@query("r018_parquet_and_sample_sink", f"WITH {BARS} SELECT {D}, {r('c', CLOSE, 4)}, 1 AS sample_is_subset FROM bars")
def _(spark, d):
    path, sample = scratch_folder(spark, "merged"), scratch_folder(spark, "sample")
    W.write_with_sample(bars(spark, d), path, sample)
    stored = spark.read.parquet(path)
    drawn = SC._csv(spark, sample).select(F.to_date(DATE).alias(DATE), TICKER)
    outside = drawn.join(stored, list(KEY), "left_anti").isEmpty() and not drawn.isEmpty()
    return out(stored.withColumn("sample_is_subset", F.lit(int(outside))), [CLOSE], keep=("date", "ticker", "sample_is_subset"), digits=4)


@query("r019_grouped_sink", f"WITH {BARS} SELECT {D}, {r('c', CLOSE, 4)} FROM bars")
def _(spark, d):
    path = scratch_folder(spark, "grouped")
    W.write_grouped(bars(spark, d), path)
    return out(spark.read.parquet(path), [CLOSE], digits=4)


@query("r020_checked_lag_sink", f"WITH {BARS} SELECT {D}, {r('CAST(lag(c / o - 1, 1) OVER w AS FLOAT)', 'quant_intraday_return_lag_1d', 4)} FROM bars {WINDOWS}")
def _(spark, d):
    df = bars(spark, d).select(DATE, TICKER, (F.col(CLOSE) / F.col(OPEN) - 1).alias("quant_intraday_return"))
    rows, tickers = df.agg(F.count("*"), F.count_distinct(TICKER)).first()
    path = scratch_folder(spark, "lagged")
    W.write_checked(M.add_feature_lags(df), path, rows, tickers)
    return out(W.read_published(spark, path), ["quant_intraday_return_lag_1d"], digits=4)


@query("r021_split_sink", f"""WITH {SPLIT_SQL} SELECT dataset_split, count(*) AS rows, count(*) AS rows_in_own_file FROM bars JOIN dsp USING (date) GROUP BY 1""")
def _(spark, d):
    root = _split_path(spark, d)
    whole = spark.read.parquet(f"{root}/all").groupBy(SPLIT).agg(F.count("*").alias("rows"))
    parts = [W.read_split(spark, root, s).groupBy(SPLIT).agg(F.count("*").alias("rows_in_own_file")) for s in ("train", "val", "test")]
    return whole.join(parts[0].unionByName(parts[1]).unionByName(parts[2]), SPLIT)


@query("r022_label_sink", f"WITH {LAB} SELECT {D}, {r('week', K.WEEK_NET)}, {r('intraday', K.INTRADAY_GROSS)} FROM lab")
def _(spark, d):
    path = scratch_folder(spark, "labels")
    W.write_label_panel(L.create_targets(panel(spark, d)), path)
    df = spark.read.parquet(path)
    assert set(df.columns) == {*KEY, *K.TARGET_COLUMNS}
    return out(df, [K.WEEK_NET, K.INTRADAY_GROSS])


@query("r023_bundle_sink", f"WITH {BARS} SELECT ticker, count(*) AS rows, (SELECT count(DISTINCT date) FROM bars) AS dates FROM bars GROUP BY ticker")
def _(spark, d):
    df, root = bars(spark, d), scratch_folder(spark, "bundle")
    dates = C.distinct_dates(df).count()
    W.write_bundle({"tickers": df.groupBy(TICKER).agg(F.count("*").alias("rows"))}, root, {"dates": dates}, csv=("tickers",))
    scalars = spark.read.json(f"{root}/scalars").select(F.col("dates").cast("bigint"))
    return spark.read.parquet(f"{root}/tickers").withColumn("dates", scalars.scalar())


@query("r024_broker_snapshots", f"""WITH {SPECS_SQL} SELECT symbol, count(*) AS specs, {r('sum(long_swap_bps_daily)', 'long_swap')} FROM specs GROUP BY symbol""")
def _(spark, d):
    root = scratch_folder(spark, "snapshots")
    s = specs(spark, d).withColumns({"margin_requirement": F.lit(1.0), "max_adv_participation": F.lit(0.05)})
    W.write_broker_snapshots(s, root)
    swaps = spark.read.schema("symbol string, long_swap_bps_daily double").json(f"{root}/swaps")
    return out(swaps.groupBy("symbol").agg(F.count("*").alias("specs"), F.sum("long_swap_bps_daily").alias("long_swap")), ["long_swap"], keep=("symbol", "specs"))


@query("r025_universe_and_listing_sink", f"WITH {BARS}, {COMPANIES} SELECT DISTINCT ticker, company_name FROM bars JOIN companies USING (ticker)")
def _(spark, d):
    root = scratch_folder(spark, "universe")
    named = bars(spark, d).join(companies(spark, d).select(TICKER, "company_name"), TICKER)
    W.write_universe(named.select(TICKER).distinct(), I.company_listing(named), root)
    return SC._csv(spark, f"{root}/listing").join(spark.read.parquet(f"{root}/universe"), TICKER, "left_semi").select(TICKER, "company_name")


# --- projections -------------------------------------------------------------------------------------------


@query("r028_explicit_rename", f"WITH {BARS} SELECT {D}, {r('o', OPEN, 4)}, {r('v', VOLUME, 4)}, {r('c', 'macro_vix_close_level', 4)} FROM bars")
def _(spark, d):
    df = bars(spark, d).select(DATE, TICKER, F.col(OPEN).alias("open"), F.col(VOLUME).alias("volume"), F.col(CLOSE).alias("vixcls"))
    return out(I.rename_columns(df), [OPEN, VOLUME, "macro_vix_close_level"], digits=4)


@query("r029_raw_level_drop", f"WITH {BARS} SELECT {D}, {r('o', 'open', 4)}, {r('c', 'xa_gold_log_return', 4)} FROM bars")
def _(spark, d):
    df = bars(spark, d).select(DATE, TICKER, F.col(OPEN).alias("open"), F.col(CLOSE).alias("adj_close"), F.col(CLOSE).alias("xa_gold"), F.col(CLOSE).alias("xa_gold_log_return"))
    df = I.drop_raw_levels(df)
    assert df.columns == ["date", "ticker", "open", "xa_gold_log_return"]
    return out(df, ["open", "xa_gold_log_return"], digits=4)


# Raw OHLC with an adjustment factor: adj_close is missing where volume <= 5, close 0 where volume is 50.
OHLC_SQL = BARS + """, raw AS (SELECT date, ticker, o AS open, h AS high, l AS low, CASE WHEN v = 50 THEN 0 ELSE c END AS close, CASE WHEN v > 5 THEN c * 0.5::DOUBLE END AS adj_close, v AS volume FROM bars)"""


def _ohlc(spark, d):
    v = F.col(VOLUME)
    return bars(spark, d).select(DATE, TICKER, F.col(OPEN).alias("open"), F.col(K.HIGH).alias("high"), F.col(K.LOW).alias("low"),
                                 F.when(v == 50, 0.0).otherwise(F.col(CLOSE)).alias("close"), F.when(v > 5, F.col(CLOSE) * 0.5).alias("adj_close"), v.alias("volume"))


@query("r030_split_dividend_adjustment", f"""WITH {OHLC_SQL}, f AS (SELECT *, coalesce(CASE WHEN close > 0 THEN adj_close / close END, 1) AS k FROM raw)
  SELECT {D}, {", ".join(r(f'{c} * k', c, 4) for c in ('open', 'high', 'low', 'close'))} FROM f""")
def _(spark, d):
    return out(I.adjust_prices(_ohlc(spark, d)), ["open", "high", "low", "close"], digits=4)


@query("r031_drop_high_missing_tickers", f"""WITH {OHLC_SQL}, p AS (SELECT ticker, 100.0::DOUBLE * sum((adj_close IS NULL)::INT) / (6 * count(*)) AS pct FROM raw GROUP BY ticker)
  SELECT {D}, {r('open', 'open', 4)} FROM raw WHERE ticker IN (SELECT ticker FROM p WHERE pct <= 1.6)""")
def _(spark, d):
    from panelspark.operators.clean import drop_high_missing_tickers
    return out(drop_high_missing_tickers(_ohlc(spark, d), 1.6), ["open"], digits=4)


@query("r032_trim_leading_dates", f"""WITH {BARS}, f AS (SELECT *, CASE WHEN v < 48 THEN 1 END AS feature FROM bars), g AS (SELECT date FROM f GROUP BY date HAVING bool_and(feature IS NOT NULL))
  SELECT {D} FROM f WHERE date >= (SELECT min(date) FROM g)""")
def _(spark, d):
    from panelspark.operators.clean import trim_leading_incomplete_dates
    df = bars(spark, d).select(DATE, TICKER, F.when(F.col(VOLUME) < 48, 1).alias("feature"))
    return out(trim_leading_incomplete_dates(df))


@query("r039_selected_feature_dataset", f"""WITH {PANEL} SELECT {D}, sector AS company_sector, {r('c', 'hl_context_stock_close_price', 4)}, {r('c', CLOSE, 4)}, {r('v', VOLUME, 4)} FROM panel""")
def _(spark, d):
    from panelspark.operators.selection import selected_features
    df = selected_features(panel(spark, d), protected=[SECTOR], context=[CLOSE], selected=[CLOSE, VOLUME])
    return out(df, ["hl_context_stock_close_price", CLOSE, VOLUME], keep=("date", "ticker", SECTOR), digits=4)


@query("r045_numeric_coercion", """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number FROM events""")
def _(spark, d):
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", S.to_number(text).alias("number"))


@query("r047_symbol_normalise", """SELECT p_partkey AS id, CASE WHEN p_size <= 25 THEN replace(p_brand, '#', '-') ELSE replace(p_brand, '#', '.') END AS ticker FROM part""")
def _(spark, d):
    p = table(spark, d, "part")
    raw = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.translate("p_brand", "#", "-"), F.lit(" ")).alias("s"), "p_size", "p_brand")
    known = p.select(F.translate("p_brand", "#", "-").alias(TICKER)).distinct()
    small = SC.normalize_symbols(raw.where("p_size <= 25"), "s", known)
    large = SC.normalize_symbols(raw.where("p_size > 25"), "s", known.where(F.col(TICKER) == "none"))
    return small.unionByName(large).select("id", TICKER)


@query("r048_company_listing", f"""WITH {BARS}, {COMPANIES}, x AS (SELECT ticker, date, CASE WHEN v > 49 THEN 'bar ' || CAST(date AS VARCHAR) ELSE ' ' END AS company_name, CASE WHEN CAST(ticker AS INT) % 2 = 0 THEN 'second' END AS security FROM bars)
  SELECT x.ticker AS ticker, coalesce(arg_min(CASE WHEN trim(x.company_name) <> '' THEN x.company_name END, CASE WHEN trim(x.company_name) <> '' THEN x.date END), max(security), max(companies.company_name), '') AS company_name
  FROM x LEFT JOIN companies ON companies.ticker = x.ticker GROUP BY x.ticker""")
def _(spark, d):
    df = bars(spark, d).select(DATE, TICKER, F.when(F.col(VOLUME) > 49, F.concat(F.lit("bar "), F.col(DATE).cast("string"))).otherwise(" ").alias("company_name"),
                               F.when(F.col(TICKER).cast("int") % 2 == 0, "second").alias("security"))
    return I.company_listing(df, membership=companies(spark, d))


STATIC_SQL = """co AS (SELECT 'C.' || CAST(c_custkey AS VARCHAR) AS ticker, c_name AS company_name, c_mktsegment AS sector FROM customer WHERE c_mktsegment <> 'BUILDING')"""


def _constituents(spark, d):
    return table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.concat(F.lit("C."), F.col("c_custkey").cast("string")).alias(TICKER), F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("sector"), F.col("c_mktsegment").alias("industry"))


def _members(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("C."), F.col("c_custkey").cast("string")).alias(TICKER)).distinct()


def _history(spark, d):
    fq = SC.quarterly_extract(quarterly(spark, d))
    return I.quarterly_ratios(fq, _members(spark, d), _constituents(spark, d), "1996-01-01", "2000-12-31")


HIST_SQL = QTR_SQL + ", " + STATIC_SQL + """, h AS (SELECT *, coalesce(rdq, datadate + 45) AS date FROM fq),
h2 AS (SELECT *, prccq * cshoq * 1e6 AS mc, ceqq / nullif(cshoq, 0) AS bv, saleq / nullif(lag(saleq, 4) OVER (PARTITION BY ticker ORDER BY datadate), 0) - 1 AS rg
  FROM h WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
hist AS (SELECT h2.date, h2.ticker, coalesce(company_name, h2.ticker) AS company_name, sector, mc AS market_cap, prccq / nullif(epspxq, 0) AS trailing_p_e, prccq / nullif(bv, 0) AS price_to_book,
  actq / nullif(lctq, 0) AS current_ratio, niq / nullif(saleq, 0) AS profit_margins, niq / nullif(ceqq, 0) AS return_on_equity, CASE WHEN dlttq IS NOT NULL THEN mc + dlttq * 1e6 END AS enterprise_value,
  rg AS revenue_growth FROM h2 LEFT JOIN co ON co.ticker = h2.ticker)"""


@query("r050_fundamental_ratios", f"""WITH {HIST_SQL} SELECT {D}, {r('market_cap / 1e6', 'market_cap', 3)}, {r('trailing_p_e', 'trailing_p_e')}, {r('price_to_book', 'price_to_book')},
  {r('current_ratio', 'current_ratio', 4)}, {r('profit_margins', 'profit_margins')}, {r('return_on_equity', 'return_on_equity')}, {r('enterprise_value / 1e6', 'enterprise_value', 3)},
  {r('revenue_growth', 'revenue_growth', 5)} FROM hist""")
def _(spark, d):
    df = _history(spark, d).withColumns({c: F.col(c) / 1e6 for c in ("market_cap", "enterprise_value")})
    return out(df, {"market_cap": 3, "trailing_p_e": 6, "price_to_book": 6, "current_ratio": 4, "profit_margins": 6, "return_on_equity": 6,
                    "enterprise_value": 3, "revenue_growth": 5})


@query("r070_static_attribute_join", f"WITH {HIST_SQL} SELECT {D}, company_name, sector FROM hist")
def _(spark, d):
    return out(_history(spark, d), keep=("date", "ticker", "company_name", "sector"))


BOOT_SQL = """fin AS (SELECT 'C.' || CAST(c_custkey AS VARCHAR) AS ticker, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS market_cap, c_acctbal AS price, CASE WHEN c_custkey % 3 = 0 THEN 2.5::DOUBLE END AS pb FROM customer),
boot AS (SELECT DATE '1996-01-01' AS date, ticker, NULL::DOUBLE AS market_cap, NULL::DOUBLE AS book_value, 'bootstrap_structural' AS prov FROM fin
  UNION ALL SELECT DATE '2000-12-31', ticker, market_cap, CASE WHEN pb > 0 AND price > 0 THEN price / pb END, 'bootstrap_proxy' FROM fin WHERE market_cap IS NOT NULL OR pb IS NOT NULL)"""


def _financials(spark, d):
    c = table(spark, d, "customer")
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return c.select(F.concat(F.lit("C."), k.cast("string")).alias(TICKER), F.lit(None).cast("string").alias("company_name"), b.alias("price"),
                    F.when(k % 2 == 0, b).alias("market_cap"), F.lit(None).cast("double").alias("trailing_p_e"),
                    F.when(k % 3 == 0, 2.5).alias("price_to_book"), F.lit(None).cast("double").alias("trailing_eps"))


@query("r051_bootstrap_fundamentals", f"WITH {BOOT_SQL} SELECT {D}, {r('market_cap', 'market_cap', 2)}, {r('book_value', 'book_value', 4)}, prov AS fundamentals_provenance FROM boot")
def _(spark, d):
    df = I.bootstrap_fundamentals(_members(spark, d), _constituents(spark, d), _financials(spark, d), "1996-01-01", "2000-12-31")
    return out(df, {"market_cap": 2, "book_value": 4}, keep=("date", "ticker", "fundamentals_provenance"))


@query("r069_fallback_union", f"""WITH {HIST_SQL}, {BOOT_SQL}, u AS (SELECT date, ticker, 'wrds_event' AS prov FROM hist UNION ALL SELECT date, ticker, prov FROM boot WHERE ticker NOT IN (SELECT ticker FROM hist))
  SELECT {D}, prov AS fundamentals_provenance FROM u""")
def _(spark, d):
    df = I.with_bootstrap(_history(spark, d), _members(spark, d), _constituents(spark, d), _financials(spark, d), "1996-01-01", "2000-12-31")
    return out(df, keep=("date", "ticker", "fundamentals_provenance"))


@query("r052_earnings_derivation", f"""WITH {HIST_SQL} SELECT DISTINCT ticker, CAST(date AS VARCHAR) AS announcement_date, 'unknown' AS announcement_session, year(date) AS fiscal_year, quarter(date) AS fiscal_quarter FROM hist""")
def _(spark, d):
    return out(I.earnings_from_fundamentals(_history(spark, d)), keep=("ticker", "announcement_date", "announcement_session", "fiscal_year", "fiscal_quarter"))


# --- joins ----------------------------------------------------------------------------------------------------

DAILY = "od AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders, sum(o_totalprice) AS amount FROM orders GROUP BY 1)"


def _order_days(spark, d):
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias(DATE)).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("amount"))


@query("r053_full_outer_date_merge", f"""WITH {BARS}, {DAILY}, bd AS (SELECT date, count(*) AS bars FROM bars GROUP BY date), ed AS (SELECT CAST(ts AS DATE) AS date, count(*) AS events FROM events GROUP BY 1)
  SELECT CAST(date AS VARCHAR) AS date, bars, orders, events FROM bd FULL JOIN od USING (date) FULL JOIN ed USING (date)""")
def _(spark, d):
    bd = bars(spark, d).groupBy(DATE).agg(F.count("*").alias("bars"))
    ed = table(spark, d, "events").groupBy(F.to_date("ts").alias(DATE)).agg(F.count("*").alias("events"))
    return out(J.merge_date_frames([bd, _order_days(spark, d), ed]), keep=("date", "bars", "orders", "events"))


@query("r054_panel_date_features", f"WITH {BARS}, {DAILY} SELECT {D}, orders, {r('amount', 'amount', 2)} FROM bars LEFT JOIN od USING (date)")
def _(spark, d):
    return out(J.attach_date_features(bars(spark, d), _order_days(spark, d)), ["amount"], keep=("date", "ticker", "orders"), digits=2)


@query("r055_asof_join", f"""WITH {BARS}, {FUND_SQL} SELECT CAST(bars.date AS VARCHAR) AS date, bars.ticker AS ticker, {r('market_cap', 'market_cap', 2)}, {r('trailing_eps', 'trailing_eps', 2)}
  FROM bars ASOF LEFT JOIN fund ON bars.ticker = fund.ticker AND bars.date >= fund.date""")
def _(spark, d):
    return out(J.asof_backward(bars(spark, d), fundamentals(spark, d)), ["market_cap", "trailing_eps"], digits=2)


@query("r056_range_expansion", f"WITH {SPELL_SQL}, se AS (SELECT DISTINCT date FROM bars) SELECT DISTINCT CAST(se.date AS VARCHAR) AS date, ticker FROM iv JOIN se ON se.date BETWEEN start_date AND end_date")
def _(spark, d):
    return out(J.expand_intervals(_spells(spark, d), C.distinct_dates(bars(spark, d))))


@query("r057_interval_intersection", f"""WITH {SPELL_SQL}, {SPECS_SQL}, s AS (SELECT symbol, effective_from AS f, coalesce(effective_to, DATE '2001-12-31') AS t FROM specs WHERE instrument_group = 'stock_cash' AND spread_bps <= 30)
  SELECT DISTINCT ticker, CAST(greatest(start_date, f) AS VARCHAR) AS start_date, CAST(least(end_date, t) AS VARCHAR) AS end_date FROM iv JOIN s ON s.symbol = ticker WHERE greatest(start_date, f) <= least(end_date, t)""")
def _(spark, d):
    df = J.intersect_intervals(_spells(spark, d), specs(spark, d), F.lit("2001-12-31").cast("date"), max_spread=30.0)
    return out(df, keep=("ticker", "start_date", "end_date"))


@query("r058_calendar_spine", f"""WITH {BARS}, se AS (SELECT DISTINCT date FROM bars), tk AS (SELECT DISTINCT ticker FROM bars), sp AS (SELECT date, ticker, c FROM se CROSS JOIN tk LEFT JOIN bars USING (date, ticker))
  SELECT {D}, {r('last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)', CLOSE, 4)} FROM sp""")
def _(spark, d):
    df = bars(spark, d)
    return out(J.calendar_spine(df.select(*KEY, CLOSE), C.distinct_dates(df), fill=[CLOSE]), [CLOSE], digits=4)


@query("r060_overlap_symbol_set", f"""WITH {SPECS_SQL} SELECT DISTINCT symbol FROM specs WHERE instrument_group = 'stock_cash' AND effective_from <= DATE '1996-06-30' AND (effective_to IS NULL OR effective_to >= DATE '1996-01-01')""")
def _(spark, d):
    return J.symbols_available(specs(spark, d), F.lit("1996-01-01").cast("date"), F.lit("1996-06-30").cast("date"), "stock_cash")


@query("r061_tradable_universe", f"""WITH {BARS}, {SPECS_SQL} SELECT DISTINCT ticker FROM bars WHERE ticker IN (SELECT symbol FROM specs WHERE instrument_group = 'stock_cash' AND effective_from <= DATE '1996-01-15' AND (effective_to IS NULL OR effective_to >= DATE '1996-01-15'))""")
def _(spark, d):
    return J.tradable_universe(bars(spark, d), specs(spark, d), F.lit("1996-01-15").cast("date"), "stock_cash")


# Observations: daily mean value per event type; sessions of the following 120 days too.
OBS_SQL = """eb AS (SELECT CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) + 120 AS e FROM events),
obs AS (SELECT event_type AS series, CAST(ts AS DATE) AS obs_date, avg(value) AS value FROM events GROUP BY 1, 2), """ + SESSIONS_SQL.replace(
    "b AS (SELECT CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders)", "b AS (SELECT s, e FROM eb)")
ALIGN_SQL = OBS_SQL + """, si AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM sessions),
lagged AS (SELECT series, obs_date, value, CASE series WHEN 'click' THEN 1 WHEN 'error' THEN 5 WHEN 'purchase' THEN 22 WHEN 'signup' THEN 66 ELSE 1 END AS k FROM obs),
placed AS (SELECT series, si.date, arg_max(value, obs_date) AS value FROM (SELECT *, (SELECT count(*) FROM si WHERE si.date <= obs_date) + k AS i FROM lagged) l JOIN si USING (i) GROUP BY 1, 2)"""


def _obs(spark, d):
    ev = table(spark, d, "events")
    obs = ev.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("obs_date")).agg(F.avg("value").alias("value"))
    bounds = ev.agg(F.to_date(F.min("ts")).alias("start"), F.date_add(F.to_date(F.max("ts")), 120).alias("end"))
    return obs, C.exchange_sessions(bounds)


@query("r064_availability_shift", f"""WITH {ALIGN_SQL}, p5 AS (SELECT series, si.date, arg_max(value, obs_date) AS value FROM (SELECT *, (SELECT count(*) FROM si WHERE si.date <= obs_date) + 5 AS i FROM obs) l JOIN si USING (i) GROUP BY 1, 2)
  SELECT series, CAST(date AS VARCHAR) AS date, {r('value', 'value')} FROM p5""")
def _(spark, d):
    obs, sessions = _obs(spark, d)
    return out(J.shift_to_availability(obs, sessions, 5), ["value"], keep=("series", "date"))


def _wide_sql(limits):
    cols = []
    for name, limit in limits.items():
        frame = "UNBOUNDED PRECEDING" if limit is None else f"{limit} PRECEDING"
        cols.append(r(f"last_value(max(CASE WHEN series = '{name}' THEN value END) IGNORE NULLS) OVER (ORDER BY sessions.date ROWS {frame})", name))
    return f"SELECT CAST(sessions.date AS VARCHAR) AS date, {', '.join(cols)} FROM sessions LEFT JOIN placed ON placed.date = sessions.date GROUP BY sessions.date"


FREQ = {"click": "daily", "error": "weekly", "purchase": "monthly", "signup": "quarterly", "view": "unknown"}
NAMES = ["click", "error", "purchase", "signup", "view"]


@query("r141_macro_panel", f"WITH {ALIGN_SQL} {_wide_sql({'click': 5, 'error': 15, 'purchase': 45, 'signup': 130, 'view': 5})}")
def _(spark, d):
    obs, sessions = _obs(spark, d)
    return out(SC.macro_panel(obs, sessions, FREQ), NAMES, keep=("date",))


@query("r142_sentiment_panel", f"WITH {ALIGN_SQL} {_wide_sql(dict.fromkeys(FREQ))}")
def _(spark, d):
    obs, sessions = _obs(spark, d)
    lags = {"click": 1, "error": SC.SURVEY_LAG, "purchase": SC.RISK_INDEX_LAG, "signup": 66, "view": 1}
    return out(SC.sentiment_panel(obs, sessions, lags), list(FREQ), keep=("date",))


@query("r143_cross_asset_pivot", f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, {r("avg(CASE WHEN event_type = 'click' THEN value END)", 'xa_click')}, {r("avg(CASE WHEN event_type = 'view' THEN value END)", 'xa_gold')},
  {", ".join(r(f"avg(CASE WHEN event_type = '{x}' THEN value END)", f'xa_{x}') for x in ('error', 'purchase', 'signup'))} FROM events GROUP BY CAST(ts AS DATE)""")
def _(spark, d):
    symbol = F.when(F.col("event_type") == "view", "GC=F").otherwise(F.concat(F.lit("^"), F.upper("event_type")))
    ev = table(spark, d, "events").select(F.to_date("ts").alias(DATE), symbol.alias(TICKER), F.col("value").alias("adj_close"))
    return out(SC.pivot_cross_assets(ev, ["^CLICK", "^ERROR", "^PURCHASE", "^SIGNUP", "GC=F"]), ["xa_click", "xa_gold", "xa_error", "xa_purchase", "xa_signup"], keep=("date",))


@query("r144_log_return_columns", f"""WITH {OHLC_SQL}, q AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lc, ln(open) AS lo FROM raw) SELECT {D}, {r('lo - lag(lo) OVER w', 'open_log_return')}, {r('lc - lag(lc) OVER w', 'close_log_return')} FROM q {WINDOWS}""")
def _(spark, d):
    return out(I.add_log_returns(_ohlc(spark, d)), ["open_log_return", "close_log_return"])


@query("r145_rolling_beta_fill", f"""WITH {BARS}, q AS (SELECT *, ln(c) - ln(lag(c) OVER w) AS x FROM bars {WINDOWS}), m AS (SELECT *, avg(x) OVER (PARTITION BY date) AS m FROM q), p AS (SELECT *, x * m AS xm FROM m)
  SELECT {D}, {r("CASE WHEN v > 45 THEN 1.5 WHEN count(x) OVER w252 >= 63 THEN (avg(xm) OVER w252 - avg(x) OVER w252 * avg(m) OVER w252) / nullif(var_samp(m) OVER w252, 0) END", 'beta', 5)} FROM p {WINDOWS}""")
def _(spark, d):
    from panelspark.functions import rolling as R
    df = bars(spark, d).withColumns({"adj_close_log_return": F.log(CLOSE) - F.log(R.lag(CLOSE)), "beta": F.when(F.col(VOLUME) > 45, 1.5)})
    return out(I.fill_beta(df), ["beta"], digits=5)


@query("r068_semi_join", f"WITH {SPECS_SQL} SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS ticker FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT symbol FROM specs)")
def _(spark, d):
    members = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias(TICKER)).distinct()
    return members.join(specs(spark, d).select(F.col("symbol").alias(TICKER)), TICKER, "left_semi")


@query("r071_aligned_column_bind", f"WITH {BARS} SELECT {D}, {r('c', CLOSE, 4)}, {r('v * 2', 'doubled', 4)}, 0 AS unmatched FROM bars")
def _(spark, d):
    a = bars(spark, d).select(*KEY, CLOSE)
    b = bars(spark, d).select(*KEY, (F.col(VOLUME) * 2).alias("doubled"))
    gaps = J.aligned(a, b).select("unmatched")
    return out(J.bind_columns(a, b).withColumn("unmatched", gaps.scalar()), [CLOSE, "doubled"], keep=("date", "ticker", "unmatched"), digits=4)


@query("r074_interval_merge", f"""WITH {SPELL_SQL}, u AS (SELECT *, max(end_date) OVER (PARTITION BY ticker ORDER BY start_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
  i AS (SELECT *, sum(CASE WHEN start_date <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY start_date) AS isl FROM u)
  SELECT ticker, CAST(min(start_date) AS VARCHAR) AS start_date, CAST(max(end_date) AS VARCHAR) AS end_date FROM i GROUP BY ticker, isl""")
def _(spark, d):
    return out(J.merge_intervals(_spells(spark, d)), keep=("ticker", "start_date", "end_date"))


# Day snapshots: comma list of the (25 at most) nations whose customers ordered that day.
SNAP_SQL = """sn AS (SELECT DISTINCT o_orderdate::DATE AS date, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
sd AS (SELECT date, coalesce(lead(date) OVER (ORDER BY date) - 1, DATE '2001-12-31') AS e FROM (SELECT DISTINCT date FROM sn))"""


@query("r075_snapshots_to_intervals", f"WITH {SNAP_SQL} SELECT n_name AS ticker, CAST(date AS VARCHAR) AS start_date, CAST(e AS VARCHAR) AS end_date FROM sn JOIN sd USING (date)")
def _(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    seen = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.to_date("o_orderdate").alias(DATE), "n_name").distinct()
    snapshots = seen.groupBy(DATE).agg(F.array_join(F.sort_array(F.collect_set("n_name")), ", ").alias("tickers"))
    return out(J.snapshots_to_intervals(snapshots, F.lit("2001-12-31").cast("date")), keep=("ticker", "start_date", "end_date"))
