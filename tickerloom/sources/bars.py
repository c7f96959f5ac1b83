"""Price bars: conforming raw tables, scanning a lookback, storing them for pruning."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom import schemas
from tickerloom.functions.moments import (
    canonical_frequency,
    in_lookback,
    lookback_start,
    naive_utc,
    utc_wall_clock,
)
from tickerloom.operators.checkpoints import checkpointed

BAR_PARTITIONS = ["freq", "month"]


def conform_bars(raw: DataFrame, frequency: str | None = None) -> DataFrame:
    """Bars with the standard types, without rows that carry no usable close.

    NaN closes go here, once, because NaN sorts above every number and passes null tests.
    """
    ts_type = raw.schema["ts"].dataType
    ts = F.col("ts")
    if isinstance(ts_type, T.TimestampType):
        ts = utc_wall_clock("ts")
    elif not isinstance(ts_type, T.TimestampNTZType):
        ts = ts.cast("timestamp_ntz")
    freq = F.lit(canonical_frequency(frequency)) if frequency else F.col("freq")
    close = F.col("close").cast("double")
    return (
        raw.withColumns({"ts": ts, "freq": freq, "close": close})
        .where(
            F.col("ticker").isNotNull()
            & F.col("ts").isNotNull()
            & F.col("close").isNotNull()
            & ~F.isnan("close")
        )
    )


def bar_key_violations(bars: DataFrame) -> DataFrame:
    """Keys that occur more than once; every operator relies on there being none."""
    keys = [name for name in ("ticker", "freq", "ts") if name in bars.columns]
    return bars.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def scan_bars(
    bars: DataFrame,
    as_of: datetime,
    days_back: float,
    frequency: str | None = None,
    tickers: DataFrame | list[str] | None = None,
) -> DataFrame:
    """Bars of a lookback that ends at ``as_of``, both ends included.

    A list of tickers becomes a pushed-down filter, a DataFrame a semi-join on ``ticker``.
    """
    scanned = bars.where(in_lookback(F.col("ts"), as_of, days_back))
    if frequency is not None and "freq" in bars.columns:
        scanned = scanned.where(F.col("freq") == canonical_frequency(frequency))
    if isinstance(tickers, DataFrame):
        scanned = scanned.join(tickers.select("ticker"), "ticker", "left_semi")
    elif tickers is not None:
        scanned = scanned.where(F.col("ticker").isin(list(tickers)))
    return scanned


def _month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def write_bars(bars: DataFrame, path: str, mode: str = "error", dynamic: bool = False) -> None:
    """Store bars by frequency and month, sorted by ticker and time within the files.

    The range includes ``ts``, so one busy ticker spreads over several tasks and files. A
    ``dynamic`` overwrite replaces the folders it has bars for and leaves the others.
    """
    order = [*BAR_PARTITIONS, "ticker", "ts"]
    (
        bars.withColumn("month", _month(F.col("ts")))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        .partitionBy(*BAR_PARTITIONS)
        .parquet(path)
    )


def read_bars(
    spark: SparkSession,
    path: str,
    as_of: datetime | None = None,
    days_back: float | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read what ``write_bars`` stored, pruned to the months of the lookback."""
    schema = T.StructType(
        [f for f in schemas.BARS.fields if f.name != "freq"]
        + [T.StructField(name, T.StringType()) for name in BAR_PARTITIONS]
    )
    bars = spark.read.schema(schema).parquet(path)
    if as_of is not None:
        bars = bars.where(F.col("month") <= f"{naive_utc(as_of):%Y-%m}")
        if days_back is not None:
            first = lookback_start(as_of, days_back)
            bars = bars.where(F.col("month") >= f"{first:%Y-%m}")
    return bars.select(*(columns or schemas.BARS.fieldNames()))


def read_months(
    spark: SparkSession, path: str, months: Sequence[str], frequency: str
) -> DataFrame:
    """Stored bars of some months, given as yyyy-MM; no other folder is read."""
    stored = read_bars(spark, path, columns=[*schemas.BARS.fieldNames(), "month"])
    chosen = stored.where(F.col("month").isin(list(months)) & (F.col("freq") == canonical_frequency(frequency)))
    return chosen.drop("month", "freq")


def merge_bars(spark: SparkSession, path: str, changes: DataFrame) -> list[str]:
    """Put corrected, late and withdrawn bars into what ``write_bars`` stored.

    ``changes`` has ``(ticker, freq, ts, close, load)``. Of several for one bar that of the highest
    ``load`` counts, and it counts over the stored bar; a NULL close takes the bar away. Only the
    months that have changes are read and written again, those of other months keep their files. The
    merged months are checkpointed before any file is replaced, and merging the same changes again
    changes nothing, so that a run that broke off is repeated. Returns the months written.
    """
    keys = ["ticker", "freq", "ts"]
    newest = (
        changes.groupBy(*keys)
        .agg(F.max_by(F.struct("close"), "load").alias("new"))
        .withColumn("month", _month(F.col("ts")))
    )
    newest = checkpointed(newest)
    # one row a month and frequency
    touched = [tuple(row) for row in newest.select(*BAR_PARTITIONS).distinct().collect()]
    if not touched:
        return []
    stored = read_bars(spark, path, columns=[*schemas.BARS.fieldNames(), "month"])
    there = F.lit(False)
    for freq, month in touched:
        there = there | ((F.col("freq") == freq) & (F.col("month") == month))
    both = stored.where(there).join(newest, [*keys, "month"], "full_outer")
    merged = both.withColumn("close", F.when(F.col("new").isNull(), F.col("close")).otherwise(F.col("new.close")))
    merged = merged.where(F.col("close").isNotNull()).select(*schemas.BARS.fieldNames())
    # a month that loses all its bars has nothing to overwrite its folder with
    left = checkpointed(merged)
    write_bars(left, path, "overwrite", dynamic=True)
    kept = {tuple(row) for row in left.select("freq", _month(F.col("ts"))).distinct().collect()}
    for freq, month in set(touched) - kept:
        _drop_folder(spark, f"{path}/freq={freq}/month={month}")
    return sorted({month for _, month in touched})


def _drop_folder(spark: SparkSession, folder: str) -> None:
    """Empty one folder of a table: an empty file replaces what was there."""
    nothing = spark.createDataFrame([], "ticker STRING, ts TIMESTAMP_NTZ, close DOUBLE")
    nothing.write.mode("overwrite").parquet(folder)


BarReader = Callable[[datetime, float], DataFrame]


def bar_reader(spark: SparkSession, path: str, frequency: str) -> BarReader:
    """A function ``(as_of, days_back)`` that reads stored bars of one frequency.

    Each call prunes to its own months and to the folder of the frequency.
    """
    name = canonical_frequency(frequency)

    def read(as_of: datetime, days_back: float) -> DataFrame:
        stored = read_bars(spark, path, as_of, days_back)
        return stored.where(F.col("freq") == name).drop("freq")

    return read


def write_bucketed_bars(bars: DataFrame, table: str, buckets: int, mode: str = "error") -> None:
    """Store bars as a table bucketed and sorted by ticker.

    Semi-joins and windows by ticker over ``spark.table(table)`` then need no shuffle of the bars,
    and with one file a bucket no sort. The bars are dealt to their buckets before they are written,
    so a bucket is one file. ``buckets`` should keep a bucket's bars within a few hundred megabytes.
    """
    dealt = bars.select("ticker", "ts", "close").repartition(buckets, "ticker")
    writer = dealt.sortWithinPartitions("ticker", "ts").write.mode(mode).format("parquet")
    writer.bucketBy(buckets, "ticker").sortBy("ticker", "ts").saveAsTable(table)


def read_raw_bars(
    spark: SparkSession, path: str, file_format: str, frequency: str, **options: str
) -> DataFrame:
    """Bars from CSV, JSON, ORC or Parquet files with ticker, ts and close columns."""
    schema = "ticker STRING, ts TIMESTAMP_NTZ, close DOUBLE"
    raw = spark.read.schema(schema).options(**options).format(file_format).load(path)
    return conform_bars(raw, frequency).select(*schemas.BARS.fieldNames())
