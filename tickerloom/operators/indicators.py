"""Price series indicators.

Each takes bars ``(ticker, ts, close)`` with unique ``(ticker, ts)``. Daily bars need no
``slice_every``: a ticker has at most one bar per calendar day. Give it, e.g. ``"7 days"``,
for intraday series.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.moments import in_lookback, moment_literal
from tickerloom.functions.numeric import half_even
from tickerloom.operators.slices import over_series
from tickerloom.params import DEFAULTS

# RSI at or below the first is a buy zone, at or above the second a sell zone.
BUY_BELOW = 30
SELL_ABOVE = 70


def _ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ts")


def full_window(aggregate: Column, guard: Column, bars: int) -> Column:
    """``aggregate`` only where the frame holds ``bars`` values."""
    return F.when(guard >= bars, aggregate)


def changes(bars: DataFrame, slice_every: str | None = None) -> DataFrame:
    """Change of close from the bar before; the first bar of a ticker has none."""

    def compute(rows: DataFrame, keys: list[str]) -> DataFrame:
        previous = F.lag("close").over(_ordered(keys))
        return rows.withColumn("chg", F.col("close") - previous)

    return over_series(bars, compute, 1, slice_every).where(F.col("chg").isNotNull())


def simple_returns(bars: DataFrame, slice_every: str | None = None) -> DataFrame:
    """Relative change of close from the bar before; none after a zero close."""

    def compute(rows: DataFrame, keys: list[str]) -> DataFrame:
        previous = F.lag("close").over(_ordered(keys))
        return rows.withColumn("ret", F.try_divide("close", previous) - 1)

    return over_series(bars, compute, 1, slice_every).where(F.col("ret").isNotNull())


def gain_loss(bars: DataFrame, slice_every: str | None = None) -> DataFrame:
    """Change split into its positive and its negative part."""
    zero = F.lit(0.0)
    return changes(bars, slice_every).select(
        "*",
        F.greatest("chg", zero).alias("gain"),
        F.least("chg", zero).alias("loss"),
    )


def moving_average(
    bars: DataFrame, bars_back: int, name: str = "sma", slice_every: str | None = None
) -> DataFrame:
    """Mean close of the last ``bars_back`` bars; NULL until there are that many."""

    def compute(rows: DataFrame, keys: list[str]) -> DataFrame:
        frame = _ordered(keys).rowsBetween(1 - bars_back, 0)
        mean = F.avg("close").over(frame)
        return rows.withColumn(
            name, full_window(mean, F.count("close").over(frame), bars_back)
        )

    return over_series(bars, compute, bars_back - 1, slice_every)


def add_rsi(rows: DataFrame, keys: list[str], bars_back: int) -> DataFrame:
    """Add ``rsi`` = 100 * up / (up + down) with plain means of the last changes.

    The common divisor of both means cancels, so sums do. NULL with fewer than
    ``bars_back`` changes or none of them nonzero.
    """
    ordered = _ordered(keys)
    frame = ordered.rowsBetween(1 - bars_back, 0)
    chg = F.col("_chg")
    up = F.sum(F.greatest(chg, F.lit(0.0))).over(frame)
    down = F.sum(F.greatest(-chg, F.lit(0.0))).over(frame)
    rsi = full_window(F.try_divide(100 * up, up + down), F.count(chg).over(frame), bars_back)
    return (
        rows.withColumn("_chg", F.col("close") - F.lag("close").over(ordered))
        .withColumn("rsi", rsi)
        .drop("_chg")
    )


def rsi_series(
    bars: DataFrame,
    bars_back: int = DEFAULTS.rsi_bars,
    slice_every: str | None = None,
) -> DataFrame:
    """RSI of every bar, with simple instead of smoothed means."""

    def compute(rows: DataFrame, keys: list[str]) -> DataFrame:
        return add_rsi(rows, keys, bars_back)

    return over_series(bars, compute, bars_back, slice_every)


def rsi_at(
    bars: DataFrame,
    moment: datetime,
    as_of: datetime,
    days_back: float = DEFAULTS.rsi_days,
) -> DataFrame:
    """RSI of the bar at exactly ``moment``, for tickers that have one."""
    window = bars.where(
        in_lookback(F.col("ts"), as_of, days_back)
        & (F.col("ts") <= moment_literal(moment))
    )
    at = rsi_series(window).where(F.col("ts") == moment_literal(moment))
    return at.select("ticker", "ts", half_even(F.col("rsi")).cast("int").alias("rsi"))


def rsi_at_requests(
    bars: DataFrame,
    requests: DataFrame,
    bars_back: int = DEFAULTS.rsi_bars,
    slice_every: str = "180 days",
) -> DataFrame:
    """``(ticker, ts, rsi_exact, bar_ts, rsi_as_of)`` for every ``(ticker, ts)`` of ``requests``.

    ``rsi_exact`` is the RSI of the bar at exactly that moment. ``bar_ts`` and ``rsi_as_of`` are those
    of the last bar up to then; both are NULL before the first bar, and the RSI is NULL where that of
    the bar is. Series and requests are united and each request takes the last bar above it, in
    slices of time, so that a ticker with most of the bars or of the requests spreads over tasks. A
    slice begins with the last bar before it, which comes from a table of one row a slice.
    """
    asked = requests.select("ticker", "ts").distinct()
    piece = F.window("ts", slice_every)["start"].alias("piece")
    valued = rsi_series(bars, bars_back, slice_every).select("ticker", "ts", piece, F.struct("ts", "rsi").alias("bar"))
    wanted = asked.select("ticker", "ts", piece, F.lit(None).cast(valued.schema["bar"].dataType).alias("bar"))
    ends = valued.groupBy("ticker", "piece").agg(F.max_by("bar", "ts").alias("end"))
    pieces = ends.unionByName(
        wanted.select("ticker", "piece").distinct().withColumn("end", F.lit(None).cast(valued.schema["bar"].dataType))
    )
    pieces = pieces.groupBy("ticker", "piece").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("ticker").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    opened = pieces.select("ticker", "piece", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    # of equal moments the bar comes before the request
    ordered = Window.partitionBy("ticker", "piece").orderBy("ts", F.col("bar").isNull())
    united = valued.unionByName(wanted).withColumn("latest", F.last("bar", ignorenulls=True).over(ordered))
    answered = united.where(F.col("bar").isNull()).join(opened, ["ticker", "piece"], "left")
    latest = F.coalesce("latest", "before")
    return answered.withColumn("latest", latest).select(
        "ticker",
        "ts",
        F.when(F.col("latest.ts") == F.col("ts"), half_even(F.col("latest.rsi")).cast("int")).alias("rsi_exact"),
        F.col("latest.ts").alias("bar_ts"),
        half_even(F.col("latest.rsi")).cast("int").alias("rsi_as_of"),
    )


def moving_average_signals(
    bars: DataFrame,
    short: int = 20,
    middle: int = 50,
    long: int = 200,
    slice_every: str | None = None,
) -> DataFrame:
    """Three moving averages, whether close lies above each, and short/middle crossings.

    ``cross`` is "up" or "down" on the bar where the short average changes sides of the
    middle one, else NULL.
    """

    def compute(rows: DataFrame, keys: list[str]) -> DataFrame:
        ordered = _ordered(keys)
        for length in (short, middle, long):
            frame = ordered.rowsBetween(1 - length, 0)
            mean = F.avg("close").over(frame)
            rows = rows.withColumn(
                f"sma_{length}", full_window(mean, F.count("close").over(frame), length)
            )
        side = F.signum(F.col(f"sma_{short}") - F.col(f"sma_{middle}"))
        before = F.lag("_side").over(ordered)
        cross = F.when((before <= 0) & (F.col("_side") > 0), "up").when(
            (before >= 0) & (F.col("_side") < 0), "down"
        )
        above = {
            f"above_{length}": F.col("close") > F.col(f"sma_{length}")
            for length in (short, middle, long)
        }
        return (
            rows.withColumn("_side", side)
            .withColumn("cross", cross)
            .withColumns(above)
            .drop("_side")
        )

    return over_series(bars, compute, long, slice_every)


def rsi_zone(rsi: Column) -> Column:
    return (
        F.when(rsi <= BUY_BELOW, "buy")
        .when(rsi >= SELL_ABOVE, "sell")
        .when(rsi.isNotNull(), "neutral")
    )


def rsi_accuracy(
    bars: DataFrame, horizon: int = 5, slice_every: str | None = None
) -> DataFrame:
    """Share of buy and sell signals the close ``horizon`` bars later confirmed.

    The pair is looked up from its later bar, so the whole computation looks back only.
    """
    back = DEFAULTS.rsi_bars

    def compute(rows: DataFrame, keys: list[str]) -> DataFrame:
        ordered = _ordered(keys)
        return add_rsi(rows, keys, back).withColumns(
            {
                "zone": rsi_zone(F.lag("rsi", horizon).over(ordered)),
                "moved": F.signum(F.col("close") - F.lag("close", horizon).over(ordered)),
            }
        )

    judged = over_series(bars, compute, back + horizon, slice_every)
    hit = F.when(F.col("zone") == "buy", (F.col("moved") > 0).cast("int")).when(
        F.col("zone") == "sell", (F.col("moved") < 0).cast("int")
    )
    return judged.groupBy("ticker").agg(
        F.count(hit).alias("n_signals"),
        F.try_divide(F.sum(hit), F.count(hit)).alias("accuracy"),
    )


def rsi_turnover(bars: DataFrame, slice_every: str | None = None) -> DataFrame:
    """Number of zone changes of the RSI per ticker and calendar year."""
    back = DEFAULTS.rsi_bars

    def compute(rows: DataFrame, keys: list[str]) -> DataFrame:
        zoned = add_rsi(rows, keys, back).withColumn("zone", rsi_zone(F.col("rsi")))
        return zoned.withColumn("before", F.lag("zone").over(_ordered(keys)))

    zoned = over_series(bars, compute, back + 1, slice_every)
    changed = F.col("zone").isNotNull() & (F.col("before") != F.col("zone"))
    return zoned.groupBy("ticker", F.year("ts").alias("year")).agg(
        F.count_if(F.coalesce(changed, F.lit(False))).alias("n_changes")
    )
