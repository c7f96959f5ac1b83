"""Factor bands, target screens, listings for people, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import labels
from tickerloom.schemas import EXPORT_NAMES


def with_factor_bands(rows: DataFrame) -> DataFrame:
    """Add ``<factor>_band`` for each factor."""
    return rows.withColumns(
        {f"{name}_band": labels.band_label(name) for name in labels.FACTOR_BANDS}
    )


def with_target_score(rows: DataFrame) -> DataFrame:
    """Add ``<factor>_ok`` for each target range and ``n_passed``, how many are met."""
    scored = rows.withColumns(
        {f"{name}_ok": labels.meets_target(name) for name in labels.TARGET_RANGES}
    )
    passed = sum(F.col(f"{name}_ok").cast("int") for name in labels.TARGET_RANGES)
    return scored.withColumn("n_passed", passed)


def screen_targets(rows: DataFrame, factors: Sequence[str] | None = None) -> DataFrame:
    """Rows that meet the target ranges of all ``factors`` (default: every factor)."""
    for name in labels.TARGET_RANGES if factors is None else factors:
        rows = rows.where(labels.meets_target(name))
    return rows


def report_view(rows: DataFrame) -> DataFrame:
    """All columns as display texts; missing values as a dash."""
    col = F.col
    return rows.select(
        "ticker",
        labels.band_text(col("pct_below_ci")).alias("pct_below_ci"),
        labels.whole_text(col("rsi")).alias("rsi"),
        labels.number_text(col("beta"), 2).alias("beta"),
        labels.number_text(col("mcap"), 2).alias("mcap"),
        labels.number_text(col("bm"), 3).alias("bm"),
        labels.percent_text(col("op")).alias("op"),
        labels.percent_text(col("inv")).alias("inv"),
    )


def export_rows(rows: DataFrame) -> DataFrame:
    """Rows under their export names."""
    return rows.select(
        *[F.col(name).alias(shown) for name, shown in EXPORT_NAMES.items()]
    )


def export_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row; missing values are written as null."""
    fields = [F.col(name).alias(shown) for name, shown in EXPORT_NAMES.items()]
    options = {"ignoreNullFields": "false"}
    return rows.select("ticker", F.to_json(F.struct(*fields), options).alias("json"))


def search_list(results: DataFrame, seq: str = "seq") -> DataFrame:
    """Search results with one row per ticker, its newest; the newest comes first.

    The winner is an aggregate, so a ticker searched very often shrinks before the shuffle.
    ``seq`` is unique, so one maximum per column takes all of them from the same row; columns
    of fixed width then need no sort.
    """
    others = [name for name in results.columns if name not in ("ticker", seq)]
    newest = [F.max_by(name, seq).alias(name) for name in others]
    latest = results.groupBy("ticker").agg(*newest, F.max(seq).alias(seq))
    return latest.select(results.columns).orderBy(F.col(seq).desc())


def remove_result(results: DataFrame, ticker: str) -> DataFrame:
    return results.where(F.col("ticker") != ticker)
