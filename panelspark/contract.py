"""Column names, prefixes and horizons shared by every operator.

Panel contract: one row per (date, ticker), ``date`` at DATE grain.  Two bounds follow
from it and carry the physical design:

* a ticker owns at most one row per calendar day, so a window over one ticker holds at
  most ~36 500 rows per century, however large the table is;
* a frame with one row per date is bounded the same way, so it may be broadcast.

Nothing bounds the number of tickers on one date; cross-sections therefore use
aggregate-and-join or binned ranks (``functions.crosssection``), never a full sort of
one date in one task.
"""

from __future__ import annotations

DATE = "date"
TICKER = "ticker"
KEY = (DATE, TICKER)
SPLIT = "dataset_split"
TRAIN, VAL, TEST = "train", "val", "test"

OPEN = "stock_open_price"
HIGH = "stock_high_price"
LOW = "stock_low_price"
CLOSE = "stock_close_price"
VOLUME = "stock_trading_volume"
PRICE_COLUMNS = (OPEN, HIGH, LOW, CLOSE, VOLUME)
SECTOR = "company_sector"
INDUSTRY = "company_industry"
MISSING_SECTOR = "__missing_sector__"

QUANT = "quant_"
INTERNAL = "_quant_internal_"
HL_TEMP = "__hl_"
DAYS_PER_YEAR = 252

# Label column names and the temporal contract.
EXECUTION_LAG = 1
HOLD_PERIOD = 5
LABEL_EMBARGO = EXECUTION_LAG + HOLD_PERIOD

INTRADAY_GROSS = "target_intraday_open_to_close_log_return"
INTRADAY_NET = "target_intraday_open_to_close_net_log_return"
OVERNIGHT_NET = "target_overnight_close_to_next_open_net_log_return"
SHORT_NET = "target_short_hold_1d_to_2d_net_log_return"
MEDIUM_GROSS = "target_medium_hold_3d_to_5d_log_return"
MEDIUM_NET = "target_medium_hold_3d_to_5d_net_log_return"
WEEK_GROSS = "target_week_hold_5sessions_close_log_return"
WEEK_NET = "target_week_hold_5sessions_net_log_return"
LEGACY_TARGET = "target_main"

# Cross-sectional label metrics, per horizon: benchmark, excess, sector residual, z-score, rank.
INTRADAY_METRICS = (
    "benchmark_intraday_open_to_close_net_log_return",
    "target_intraday_open_to_close_excess_log_return",
    "target_intraday_open_to_close_sector_residual_log_return",
    "target_intraday_open_to_close_net_cs_zscore",
    "target_intraday_open_to_close_net_cs_rank",
)
WEEK_METRICS = (
    "benchmark_week_hold_net_log_return",
    "target_week_hold_excess_log_return",
    "target_week_hold_sector_residual_log_return",
    "target_week_hold_net_cs_zscore",
    "target_week_hold_net_cs_rank",
)
MODEL_TARGET = WEEK_METRICS[3]
REALIZED_RETURN = WEEK_GROSS
TARGET_COLUMNS = (
    INTRADAY_GROSS, INTRADAY_NET, OVERNIGHT_NET, SHORT_NET, MEDIUM_GROSS, MEDIUM_NET,
    WEEK_GROSS, WEEK_NET, *INTRADAY_METRICS, *WEEK_METRICS,
)
PREDICTION = "prediction"
