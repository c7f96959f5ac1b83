"""Row windows over long series without one task per ticker.

``Window.partitionBy("ticker")`` puts a whole ticker in one task. That is fine for daily
bars (a few thousand rows), not for ticks or minute bars of a busy ticker. Here a series is
cut into time slices, and each slice is preceded by a copy of the ``rows`` bars before it,
so that windows over (ticker, slice) see everything a look-back of ``rows`` needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE = "slice"
LEAD_IN = "lead_in"


def with_lead_in(bars: DataFrame, rows: int, every: str) -> DataFrame:
    """Bars with their time slice, plus up to ``rows`` earlier bars marked ``lead_in``.

    Two small tables say what goes where. The counts have one row a slice; the only window over a
    ticker is over these, and it tells a slice which later slices are near enough to need some of
    its bars. The tails are the last ``rows`` bars of each slice by a limited row number, which Spark
    applies in every task before the shuffle, so that a busy slice sends no more than ``rows`` bars
    from a task and is never gathered. Both meet on the slice, and the bars needed are copied.
    """
    columns = list(bars.columns)
    sliced = bars.withColumn(SLICE, F.window("ts", every)["start"])
    counts = sliced.groupBy("ticker", SLICE).agg(F.count("*").alias("_n"))
    by_slice = Window.partitionBy("ticker").orderBy(SLICE)
    so_far = F.sum("_n").over(by_slice.rowsBetween(Window.unboundedPreceding, 0))
    later = F.collect_list(F.struct(SLICE, (F.col("_so_far") - F.col("_n")).alias("before")))
    near = (
        counts.withColumn("_so_far", so_far)
        .withColumn("_later", later.over(by_slice.rowsBetween(1, rows)))
        # between the end of this slice and a later one lie before - so_far bars
        .select("ticker", SLICE, "_so_far", F.explode("_later").alias("_target"))
        .select("ticker", SLICE, "_target", (F.col("_target.before") - F.col("_so_far")).alias("_gap"))
        .where(F.col("_gap") < rows)
    )
    latest_first = Window.partitionBy("ticker", SLICE).orderBy(F.col("ts").desc())
    tails = sliced.withColumn("_back", F.row_number().over(latest_first)).where(F.col("_back") <= rows)
    handed_over = (
        tails.join(near, ["ticker", SLICE])
        .where(F.col("_back") <= rows - F.col("_gap"))
        .select(*columns, F.col(f"_target.{SLICE}").alias(SLICE))
    )
    return sliced.withColumn(LEAD_IN, F.lit(False)).unionByName(
        handed_over.withColumn(LEAD_IN, F.lit(True))
    )


def over_series(
    bars: DataFrame,
    compute: Callable[[DataFrame, list[str]], DataFrame],
    rows: int,
    every: str | None = None,
) -> DataFrame:
    """Apply ``compute(bars, partition_columns)`` per ticker, or per slice if ``every``.

    ``rows`` is how far back, in bars, the computation looks. Without ``every`` a ticker's
    whole series is one group, which suits daily bars only.
    """
    if every is None:
        return compute(bars, ["ticker"])
    computed = compute(with_lead_in(bars, rows, every), ["ticker", SLICE])
    return computed.where(~F.col(LEAD_IN)).drop(LEAD_IN, SLICE)
