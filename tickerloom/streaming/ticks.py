"""Bars and latest prices from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.moments import (
    BUCKETS,
    canonical_frequency,
    utc_instant,
    utc_wall_clock,
)
from tickerloom.operators.resample import has_price


def stream_bars(
    ticks: DataFrame, frequency: str, delay: str, price: str = "price"
) -> DataFrame:
    """Bars of closed buckets; ticks more than ``delay`` behind the newest are dropped.

    How late a tick may be is the caller's choice. The drop shows only in the stream's
    progress, as ``numRowsDroppedByWatermark``. Ticks without a price do not count.

    State per ticker is the open buckets only. Append mode emits each bar once. Watermarks
    need TIMESTAMP, so wall-clock times pass through it and come back as TIMESTAMP_NTZ.
    """
    name = canonical_frequency(frequency)
    if isinstance(ticks.schema["ts"].dataType, T.TimestampNTZType):
        ticks = ticks.withColumn("ts", utc_instant("ts"))
    bars = (
        ticks.withWatermark("ts", delay)
        .where(has_price(price))
        .groupBy(F.window("ts", BUCKETS[name]).alias("bucket"), "ticker")
        .agg(
            F.min_by(price, "ts").alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, "ts").alias("close"),
            F.count(price).alias("n_ticks"),
        )
    )
    return bars.select(
        "ticker",
        utc_wall_clock("bucket.start").alias("ts"),
        "open",
        "high",
        "low",
        "close",
        "n_ticks",
        F.lit(name).alias("freq"),
    )


def stream_latest_price(ticks: DataFrame, price: str = "price") -> DataFrame:
    """Latest price and its time per ticker, one state row each; for update mode."""
    return (
        ticks.where(has_price(price))
        .groupBy("ticker")
        .agg(F.max_by(price, "ts").alias("price"), F.max("ts").alias("ts"))
    )
