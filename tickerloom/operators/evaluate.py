"""One row per ticker: all measures, and why a ticker is rejected.

The plan: scan the longest lookback once, shuffle it by ticker, sort it once, attach the
broadcast market returns, and reduce to one row per ticker with conditional aggregates.
Prices, factors and the universe then join on the ticker the rows are already hashed by:
company values are put under the universe's own spelling of its tickers first, and only the
companies of the universe are read from the filings.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tickerloom.functions.moments import in_lookback
from tickerloom.operators import accounting
from tickerloom.operators.daily import (
    band_aggregates,
    beta_aggregates,
    beta_return,
    beta_value,
    last_changes,
    market_returns,
    pct_below_band,
    price_aggregate,
    rsi_aggregates,
    rsi_value,
)
from tickerloom.operators.resample import latest_price
from tickerloom.params import DEFAULTS, ScreenParams
from tickerloom.schemas import FACTOR_COLUMNS, METRIC_COLUMNS, SNAPSHOT_COLUMNS

NO_BARS = "no_bars"
PENNY = "penny"
NO_PRICE = "no_price"
RSI_UNDEFINED = "rsi_undefined"
RSI_ZERO = "rsi_zero"
ACCEPTED = "accepted"


def reject_reason(params: ScreenParams) -> Column:
    """First failing test in the order they are made; NULL if all pass."""
    return (
        F.when(F.coalesce("band_bars", F.lit(0)) == 0, NO_BARS)
        .when(F.col("last_close") <= params.penny_limit, PENNY)
        .when(F.col("price").isNull(), NO_PRICE)
        .when(F.col("rsi").isNull(), RSI_UNDEFINED)
        .when(F.col("rsi") == 0, RSI_ZERO)
    )


def _measures(
    bars: DataFrame, market_bars: DataFrame, as_of: datetime, params: ScreenParams
) -> DataFrame:
    longest = max(params.rsi_days, params.beta_days, params.band_days, params.price_days)
    series = bars.where(in_lookback(F.col("ts"), as_of, longest)).withColumns(
        {"ret": beta_return(as_of, params), "last_chg": last_changes(as_of, params)}
    )
    market = market_returns(market_bars, as_of, params)
    return (
        series.join(F.broadcast(market), "ts", "left")
        .groupBy("ticker")
        .agg(
            *band_aggregates(as_of, params),
            price_aggregate(as_of, params),
            *rsi_aggregates(),
            *beta_aggregates(),
        )
    )


def evaluate(
    bars: DataFrame,
    as_of: datetime,
    facts: DataFrame | None = None,
    cik_map: DataFrame | None = None,
    universe: DataFrame | None = None,
    price_bars: DataFrame | None = None,
    market_bars: DataFrame | None = None,
    params: ScreenParams = DEFAULTS,
    complete: bool = True,
) -> DataFrame:
    """Snapshot columns plus ``reason`` for every ticker of the universe.

    ``bars`` are daily bars with unique ``(ticker, ts)``. Without ``universe`` every ticker
    with bars in the longest lookback is evaluated. ``price_bars`` are the minute bars the
    current price is taken from; without them the daily bars serve. ``market_bars`` are
    where the market ticker's daily bars are, if not in ``bars``. Tickers of the universe
    without bars have a row unless ``complete`` is False, which spares a join where the
    caller knows what is missing. Neither bars nor filings from after ``as_of`` count, so what
    comes in later never changes an earlier evaluation.
    """
    scanned = bars
    if universe is not None:
        universe = universe.select("ticker").distinct()
        scanned = bars.join(universe, "ticker", "left_semi")
    market_bars = bars if market_bars is None else market_bars
    measured = _measures(scanned, market_bars, as_of, params)
    if price_bars is not None:
        prices = latest_price(price_bars, as_of, params.price_days)
        measured = measured.drop("price").join(prices, "ticker", "left")
    return from_measures(measured, as_of, facts, cik_map, universe, params, complete)


def from_measures(
    measured: DataFrame,
    as_of: datetime,
    facts: DataFrame | None = None,
    cik_map: DataFrame | None = None,
    universe: DataFrame | None = None,
    params: ScreenParams = DEFAULTS,
    complete: bool = True,
) -> DataFrame:
    """What ``evaluate`` makes of a ticker's measures: factors, distance, beta and reason."""
    if universe is not None and complete:
        measured = universe.select("ticker").distinct().join(measured, "ticker", "left")
    if facts is None or cik_map is None:
        nothing = {
            name: F.lit(None).cast("double") for name in FACTOR_COLUMNS if name != "beta"
        }
        factored = measured.withColumns(nothing)
    else:
        facts = accounting.filed_by(facts, as_of)
        if universe is not None:
            values = accounting.values_of(universe, facts, cik_map)
            joined = measured.join(values, "ticker", "left")
        else:
            values = accounting.values_by_ticker(facts, cik_map)
            values = values.withColumnRenamed("ticker", "listed_ticker")
            joined = measured.join(
                values, F.upper("ticker") == F.col("listed_ticker"), "left"
            )
        factored = joined.withColumns(accounting.factor_columns())
    return factored.withColumn("rsi", rsi_value(params)).withColumns(
        {
            "pct_below_ci": pct_below_band(params),
            "beta": beta_value(params),
            "reason": reject_reason(params),
        }
    ).select(*SNAPSHOT_COLUMNS, "reason")


def snapshot(evaluated: DataFrame, drop_zero_rsi: bool = True) -> DataFrame:
    """Rows of accepted tickers. An RSI of zero counts as missing unless told otherwise."""
    passed = F.col("reason").isNull()
    if not drop_zero_rsi:
        passed = passed | (F.col("reason") == RSI_ZERO)
    return evaluated.where(passed).select(*SNAPSHOT_COLUMNS)


def rejects(evaluated: DataFrame) -> DataFrame:
    """Rejected tickers with the reason."""
    return evaluated.where(F.col("reason").isNotNull()).select("ticker", "reason")


def run_counts(evaluated: DataFrame) -> DataFrame:
    """Number of tickers per outcome."""
    outcome = F.coalesce("reason", F.lit(ACCEPTED)).alias("outcome")
    return evaluated.groupBy(outcome).agg(F.count("*").alias("n_tickers"))


#: Every outcome an evaluated ticker can have.
OUTCOMES = [ACCEPTED, NO_BARS, PENNY, NO_PRICE, RSI_UNDEFINED, RSI_ZERO]


def write_counted(evaluated: DataFrame, path: str, mode: str = "error") -> dict[str, int]:
    """Store an evaluation and return its ``run_counts``, gathered by the tasks that write it.

    Nothing is read or computed again for the counts. They are taken in the job's last stage, where
    Spark counts each partition once, however often a task was tried.
    """
    outcome = F.coalesce("reason", F.lit(ACCEPTED))
    counts = Observation("run_counts")
    counted = evaluated.observe(counts, *(F.count_if(outcome == name).alias(name) for name in OUTCOMES))
    counted.write.mode(mode).parquet(path)
    return {name: n for name, n in counts.get.items() if n}


def lookup(evaluated: DataFrame) -> DataFrame:
    """Answer to single-ticker requests: status plus the row, empty unless ok.

    The RSI is computed first, so its absence is an error whatever else is wrong; a missing
    band means not found; an RSI of zero is an answer.
    """
    status = (
        F.when(F.col("rsi").isNull(), "error")
        .when(F.col("reason").isNull() | (F.col("reason") == RSI_ZERO), "ok")
        .otherwise("not_found")
    )
    answered = evaluated.withColumn("status", status)
    shown = [
        F.when(F.col("status") == "ok", F.col(name)).alias(name)
        for name in METRIC_COLUMNS
    ]
    return answered.select("ticker", "status", *shown)


def coverage(
    universe: DataFrame, bars: DataFrame, as_of: datetime, days_back: float = 5
) -> DataFrame:
    """Which tickers of the universe have a bar within the last days."""
    fresh = bars.where(in_lookback(F.col("ts"), as_of, days_back))
    seen = fresh.groupBy("ticker").agg(F.max("ts").alias("last_ts"))
    listed = universe.select("ticker").distinct()
    return listed.join(seen, "ticker", "left").withColumn(
        "covered", F.col("last_ts").isNotNull()
    )


def coverage_counts(covered: DataFrame) -> DataFrame:
    return covered.groupBy("covered").agg(F.count("*").alias("n_tickers"))
