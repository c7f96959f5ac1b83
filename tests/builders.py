"""Small hand-made tables."""

from __future__ import annotations

from datetime import datetime, timedelta

AS_OF = datetime(2024, 6, 28)

BAR = "ticker STRING, ts TIMESTAMP_NTZ, close DOUBLE"
FACT = (
    "cik STRING, taxonomy STRING, concept STRING, unit STRING, pos BIGINT, end STRING,"
    " filed STRING, form STRING, val DOUBLE"
)


def daily(ticker, closes, last=AS_OF):
    """Daily bars that end at ``last``."""
    first = last - timedelta(days=len(closes) - 1)
    return [
        (ticker, first + timedelta(days=i), float(close))
        for i, close in enumerate(closes)
    ]


def bars(spark, *series):
    return spark.createDataFrame([row for rows in series for row in rows], BAR)


def fact(cik, concept, end, filed, val, unit="USD", pos=0, form="10-K", taxonomy="us-gaap"):
    return (cik, taxonomy, concept, unit, pos, end, filed, form, float(val))


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


def values(frame, key="ticker"):
    """Rows as dictionaries under their key."""
    found = {row[key]: row.asDict() for row in frame.collect()}
    return found
