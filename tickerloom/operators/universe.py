"""Maintenance of a universe's rows: create, refresh, add, remove.

``stored`` rows carry the snapshot columns, ``seq`` and ``as_of``; ``evaluated`` is the
result of ``evaluate`` for the tickers concerned. Everything is an equi-join on the ticker.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.moments import moment_literal
from tickerloom.operators.evaluate import NO_BARS, NO_PRICE, RSI_UNDEFINED, RSI_ZERO
from tickerloom.schemas import METRIC_COLUMNS, UNIVERSE

#: Reasons after which a refresh keeps what it had.
KEEPS_OLD_ROW = [NO_BARS, NO_PRICE, RSI_UNDEFINED]

UNIVERSE_COLUMNS = UNIVERSE.fieldNames()


def first_places(listing: DataFrame) -> DataFrame:
    """Distinct tickers of a list with the place of their first mention."""
    return listing.groupBy("ticker").agg(F.min("ordinal").alias("ordinal"))


def tickers_to_evaluate(stored: DataFrame, listing: DataFrame) -> DataFrame:
    return stored.select("ticker").union(listing.select("ticker")).distinct()


def _settle(seeds: DataFrame, evaluated: DataFrame, as_of: datetime) -> DataFrame:
    """Choose the new row, the old row or none for every seed."""
    fresh = evaluated.select(
        "ticker",
        F.lit(True).alias("known"),
        "reason",
        *[F.col(name).alias(f"new_{name}") for name in METRIC_COLUMNS],
    )
    joined = seeds.join(fresh, "ticker", "left")
    renewed = F.coalesce(F.col("known") & F.col("reason").isNull(), F.lit(False))
    failed_softly = F.col("known").isNull() | F.col("reason").isin(KEEPS_OLD_ROW)
    # an old RSI of zero, possible after an add, does not survive a refresh
    kept = failed_softly & (F.coalesce("rsi", F.lit(0)) != 0)

    def pick(name: str, new: Column) -> Column:
        return F.when(renewed, new).otherwise(F.col(name)).alias(name)

    return joined.where(renewed | kept).select(
        "ticker",
        *[pick(name, F.col(f"new_{name}")) for name in METRIC_COLUMNS],
        "seq",
        pick("as_of", moment_literal(as_of)),
    )


def refresh(stored: DataFrame, evaluated: DataFrame, as_of: datetime) -> DataFrame:
    """Recompute every row.

    A penny stock and a new RSI of zero delete the row; missing bars, price or RSI keep it.
    """
    return _settle(stored.select(*UNIVERSE_COLUMNS), evaluated, as_of)


def create(
    stored: DataFrame,
    listing: DataFrame,
    evaluated: DataFrame,
    as_of: datetime,
    seq_base: int,
) -> DataFrame:
    """Create or extend a universe by the ``(ticker, ordinal)`` of a list.

    Listed tickers start empty, so a failing one is removed; the others are refreshed.
    Known tickers keep their place, new ones follow in list order from ``seq_base``.
    """
    listed = first_places(listing)
    emptied = F.col("ordinal").isNotNull()
    seeds = stored.join(listed, "ticker", "full_outer").select(
        "ticker",
        *[F.when(~emptied, F.col(name)).alias(name) for name in METRIC_COLUMNS],
        F.coalesce("seq", F.col("ordinal") + F.lit(seq_base)).alias("seq"),
        F.when(~emptied, F.col("as_of")).alias("as_of"),
    )
    return _settle(seeds, evaluated, as_of)


def add(
    stored: DataFrame,
    candidates: DataFrame,
    evaluated: DataFrame,
    as_of: datetime,
    seq_base: int,
) -> DataFrame:
    """Append accepted candidates that are not there yet; an RSI of zero is accepted."""
    new = first_places(candidates).join(stored, "ticker", "left_anti")
    accepted = evaluated.where(
        F.col("reason").isNull() | (F.col("reason") == RSI_ZERO)
    ).drop("reason")
    rows = new.join(accepted, "ticker").select(
        "ticker",
        *METRIC_COLUMNS,
        (F.col("ordinal") + F.lit(seq_base)).alias("seq"),
        moment_literal(as_of).alias("as_of"),
    )
    return stored.select(*UNIVERSE_COLUMNS).unionByName(rows)


def remove(stored: DataFrame, tickers: DataFrame) -> DataFrame:
    """Drop rows by ticker; tickers that are not there do not matter."""
    return stored.join(tickers.select("ticker"), "ticker", "left_anti")


def reset(stored: DataFrame) -> DataFrame:
    """The universe without any rows."""
    return stored.where(F.lit(False))
