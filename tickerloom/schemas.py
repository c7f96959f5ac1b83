"""Schemas of the long tables every operator works on."""

from __future__ import annotations

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("freq", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("close", T.DoubleType()),
    ]
)

TICKS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)

FACTS = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("taxonomy", T.StringType()),
        T.StructField("concept", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("end", T.StringType()),
        T.StructField("filed", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("val", T.DoubleType()),
    ]
)

SNAPSHOT = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("pct_below_ci", T.DoubleType()),
        T.StructField("rsi", T.IntegerType()),
        T.StructField("bm", T.DoubleType()),
        T.StructField("op", T.DoubleType()),
        T.StructField("inv", T.DoubleType()),
        T.StructField("beta", T.DoubleType()),
        T.StructField("mcap", T.DoubleType()),
    ]
)

#: One evaluated ticker: the snapshot plus why it is rejected, if it is.
EVALUATION = T.StructType(SNAPSHOT.fields + [T.StructField("reason", T.StringType())])

#: One stored universe: the snapshot plus insertion order and the time it was computed for.
UNIVERSE = T.StructType(
    SNAPSHOT.fields
    + [
        T.StructField("seq", T.LongType()),
        T.StructField("as_of", T.TimestampNTZType()),
    ]
)

SNAPSHOT_COLUMNS = SNAPSHOT.fieldNames()
METRIC_COLUMNS = SNAPSHOT_COLUMNS[1:]
FACTOR_COLUMNS = ["bm", "op", "inv", "beta", "mcap"]

# The column names a snapshot row carries when it is exported.
EXPORT_NAMES = {
    "ticker": "Ticker",
    "pct_below_ci": "% Below 95% CI",
    "rsi": "RSI",
    "bm": "BM",
    "op": "OP",
    "inv": "INV",
    "beta": "BETA",
    "mcap": "MCAP",
}
