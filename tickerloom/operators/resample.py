"""Bars from ticks or finer bars, and the latest price."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.moments import (
    bucket_start,
    canonical_frequency,
    in_lookback,
    lookback_start,
    moment_literal,
)
from tickerloom.operators.checkpoints import checkpointed
from tickerloom.params import DEFAULTS

# The days of the windows in which a current price is looked for, one after another.
PRICE_WINDOWS = [5 / 1440, 1, 3, 5]


def has_price(price: str) -> Column:
    """True for a price that is a number; NaN sorts above all others and is none."""
    return F.col(price).isNotNull() & ~F.isnan(F.col(price).cast("double"))


def resample(
    ticks: DataFrame,
    frequency: str,
    price: str = "price",
    volume: str | None = None,
    tie_breaker: str | None = None,
) -> DataFrame:
    """Open, high, low, close and tick count per ticker and day, hour or minute.

    All of it is one hash aggregate with map-side partials, so a ticker with a large
    share of the ticks is reduced to one row per bucket before the shuffle. Ticks of one
    ticker at one instant need a ``tie_breaker`` column to be ordered; that costs a sort.
    Ticks without a price, NULL or NaN, do not count.
    """
    moment = F.col("ts") if tie_breaker is None else F.struct("ts", tie_breaker)
    aggregates = [
        F.min_by(price, moment).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, moment).alias("close"),
        F.count(price).alias("n_ticks"),
    ]
    if volume is not None:
        aggregates.append(F.sum(volume).alias("volume"))
    bars = (
        ticks.where(has_price(price))
        .groupBy("ticker", bucket_start(F.col("ts"), frequency).alias("bucket"))
        .agg(*aggregates)
    )
    return bars.withColumnRenamed("bucket", "ts").withColumn(
        "freq", F.lit(canonical_frequency(frequency))
    )


def latest_price(
    bars: DataFrame, as_of: datetime, days_back: float = DEFAULTS.price_days
) -> DataFrame:
    """Last close of every ticker within the lookback.

    Trying ever longer windows until one has a bar gives the same row as the longest
    window, since they all end at ``as_of``.
    """
    recent = bars.where(in_lookback(F.col("ts"), as_of, days_back))
    return recent.groupBy("ticker").agg(F.max_by("close", "ts").alias("price"))


def widening_price(
    bars: DataFrame, as_of: datetime, tickers: DataFrame, windows: Sequence[float] = PRICE_WINDOWS
) -> DataFrame:
    """``(ticker, price, window)``: last closes, and the days of the first window that has one.

    Same prices as ``latest_price`` over the widest window, with less read. Each window reads the
    stretch of time that the one before did not, for the tickers still without a price; when none is
    left, the wider ones are never read. What the driver learns is whether any are left.
    """
    left = checkpointed(tickers.select("ticker").distinct())
    found = []
    newer = None
    for days in windows:
        if left.isEmpty():
            break
        stretch = bars.where(in_lookback(F.col("ts"), as_of, days))
        if newer is not None:
            stretch = stretch.where(F.col("ts") < moment_literal(lookback_start(as_of, newer)))
        last = stretch.join(left, "ticker", "left_semi").groupBy("ticker").agg(F.max_by("close", "ts").alias("price"))
        found.append(checkpointed(last.withColumn("window", F.lit(float(days)))))
        left = checkpointed(left.join(found[-1], "ticker", "left_anti"))
        newer = days
    if not found:
        return bars.select("ticker", F.col("close").alias("price"), F.lit(0.0).alias("window")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found)
