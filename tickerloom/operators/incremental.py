"""Evaluation from monthly summaries, so that a refresh reads a few months of bars.

A summary has one row per ticker and month: moments of the closes (count, mean, sum of squares about
the mean), co-moments with the market's returns, the last bars, and the few returns that reach over
the month's edge. Summaries of whole months are stored and never change; moments merge pairwise, so
a lookback is the sum of its months. Bars are read for the months after the last summary and for
those in which a lookback begins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.moments import lookback_start, moment_literal, naive_utc
from tickerloom.operators.daily import market_days
from tickerloom.params import DEFAULTS, ScreenParams

BAR = "STRUCT<ts: TIMESTAMP_NTZ, close: DOUBLE>"
EDGE = (
    "STRUCT<ts: TIMESTAMP_NTZ, close: DOUBLE, before: "
    f"{BAR}, m_ret: DOUBLE, m_before: TIMESTAMP_NTZ>"
)
#: One row per ticker and month.
SUMMARY = (
    "ticker STRING, n BIGINT, mean DOUBLE, m2 DOUBLE, last "
    f"{BAR}, tail ARRAY<{BAR}>, pairs STRUCT<n: BIGINT, r: DOUBLE, m: DOUBLE, m2: DOUBLE, c: DOUBLE>,"
    f" edges ARRAY<{EDGE}>, month STRING"
)

#: Bars of some months, given as yyyy-MM.
MonthReader = Callable[[Sequence[str]], DataFrame]


def month_of(moment: datetime) -> str:
    return f"{naive_utc(moment):%Y-%m}"


def months_between(first: str, last: str) -> list[str]:
    """All months from one to another, both included."""
    year, month = map(int, first.split("-"))
    out = []
    while (name := f"{year:04d}-{month:02d}") <= last:
        out.append(name)
        year, month = (year, month + 1) if month < 12 else (year + 1, 1)
    return out


def _market_returns(bars: DataFrame, params: ScreenParams) -> DataFrame:
    """``(ts, m_ret, m_before)``: the market's return and the moment of the bar before."""
    by_time = Window.partitionBy("ticker").orderBy("ts")
    returns = F.try_divide("close", F.lag("close").over(by_time)) - 1
    days = market_days(bars.where(F.col("ticker") == params.market), params)
    return days.select("ts", returns.alias("m_ret"), F.lag("ts").over(by_time).alias("m_before")).where("m_ret is not null")


def month_summaries(bars: DataFrame, market_bars: DataFrame, params: ScreenParams = DEFAULTS) -> DataFrame:
    """Summaries of daily bars, by ticker and calendar month.

    ``market_bars`` has the market's bars of these months and the last one before them. A ticker's
    month is at most 31 bars, so that its list of last bars is bounded. A return counts in ``pairs``
    if the bars before, of the ticker and of the market, are in the month too; others are edges, at
    most two a month.
    """
    by_time = Window.partitionBy("ticker", "month").orderBy("ts")
    monthly = bars.select("ticker", "ts", "close", F.date_format("ts", "yyyy-MM").alias("month"))
    before = F.lag(F.struct("ts", "close")).over(by_time)
    market = F.broadcast(_market_returns(market_bars, params))  # one row a day
    rows = monthly.withColumn("before", before).join(market, "ts", "left")
    whole = F.col("before").isNotNull() & (F.date_format("m_before", "yyyy-MM") == F.col("month"))
    edge = F.when(~F.coalesce(whole, F.lit(False)) & F.col("m_ret").isNotNull(), F.struct("ts", "close", "before", "m_ret", "m_before"))
    ret = F.when(whole, F.try_divide("close", F.col("before.close")) - 1)
    rows = rows.withColumns({"r": ret, "m": F.when(ret.isNotNull(), F.col("m_ret"))})
    pairs = F.count("m")
    tail = F.sort_array(F.collect_list(F.struct("ts", "close")))
    return rows.groupBy("ticker", "month").agg(
        F.count("close").alias("n"),
        F.avg("close").alias("mean"),
        (F.var_pop("close") * F.count("close")).alias("m2"),
        F.max_by(F.struct("ts", "close"), "ts").alias("last"),
        F.slice(tail, F.greatest(F.size(tail) - params.rsi_bars, F.lit(1)), params.rsi_bars + 1).alias("tail"),
        F.struct(
            pairs.alias("n"), F.avg(F.when(F.col("m").isNotNull(), F.col("r"))).alias("r"), F.avg("m").alias("m"),
            (F.var_pop("m") * pairs).alias("m2"), (F.covar_pop("r", "m") * pairs).alias("c"),
        ).alias("pairs"),
        F.collect_list(edge).alias("edges"),
    )


@dataclass(frozen=True)
class SummaryStore:
    """Summaries of whole months as Parquet, a folder for each month.

    Writing a month replaces that month and no other, so a repeated write is harmless.
    """

    spark: SparkSession
    path: str

    def write(self, summaries: DataFrame) -> None:
        writer = summaries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("month").parquet(self.path)

    def read(self, months: Sequence[str]) -> DataFrame:
        rows = self.spark.read.schema(SUMMARY).parquet(self.path)
        return rows.where(F.col("month").isin(list(months)))

    def months(self) -> list[str]:
        """The months there are, from the names of their folders."""
        rows = self.spark.read.schema(SUMMARY).parquet(self.path)
        return sorted(r.month for r in rows.select("month").distinct().collect())


def _merged(parts: Column) -> Column:
    """Moments ``(n, mean, m2)`` of several groups, merged pairwise."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.when(b["n"] > 0, F.struct(
            n.alias("n"),
            (a["mean"] + gap * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"),
        )).otherwise(a)

    return F.aggregate(parts, start, merge)


def _merged_pairs(parts: Column) -> Column:
    """Co-moments ``(n, r, m, m2, c)`` of several groups, merged pairwise."""
    zero = F.lit(0.0)
    start = F.struct(
        F.lit(0).cast("bigint").alias("n"), zero.alias("r"), zero.alias("m"), zero.alias("m2"), zero.alias("c")
    )

    def merge(a: Column, b: Column) -> Column:
        n, gap_r, gap_m = a["n"] + b["n"], b["r"] - a["r"], b["m"] - a["m"]
        share = a["n"] * b["n"] / n
        return F.when(b["n"] > 0, F.struct(
            n.alias("n"),
            (a["r"] + gap_r * b["n"] / n).alias("r"),
            (a["m"] + gap_m * b["n"] / n).alias("m"),
            (a["m2"] + b["m2"] + gap_m * gap_m * share).alias("m2"),
            (a["c"] + b["c"] + gap_r * gap_m * share).alias("c"),
        )).otherwise(a)

    return F.aggregate(parts, start, merge)


def _edge_pairs(start: datetime) -> Column:
    """The edges whose bars before, of ticker and market, lie in the lookback, as pairs of one."""
    floor = moment_literal(start)

    def valued(edge: Column) -> Column:
        before = F.coalesce(edge["before"], F.col("_before"))
        ret = F.try_divide(edge["close"], before["close"]) - 1
        zero = F.lit(0.0)
        return F.when((before["ts"] >= floor) & (edge["m_before"] >= floor) & ret.isNotNull(), F.struct(
            F.lit(1).cast("bigint").alias("n"), ret.alias("r"), edge["m_ret"].alias("m"), zero.alias("m2"), zero.alias("c")
        ))

    return F.filter(F.transform("edges", valued), lambda pair: pair.isNotNull())


def _rsi_sums(bars: Column, start: datetime, params: ScreenParams) -> dict[str, Column]:
    """Sums of the last gains and losses, from a ticker's last bars in order."""
    kept = F.filter(bars, lambda bar: bar["ts"] >= moment_literal(start))
    last = F.slice(kept, F.greatest(F.size(kept) - params.rsi_bars, F.lit(1)), params.rsi_bars + 1)
    later = F.slice(last, 2, params.rsi_bars)
    changes = F.zip_with(later, F.slice(last, 1, F.greatest(F.size(last) - 1, F.lit(0))), lambda b, a: b["close"] - a["close"])

    def total(sign: int) -> Column:
        return F.aggregate(changes, F.lit(0.0), lambda sum_, chg: sum_ + F.greatest(sign * chg, F.lit(0.0)))

    return {"gains": total(1), "losses": total(-1), "n_changes": F.size(changes).cast("bigint")}


def lookback_months(as_of: datetime, last_stored: str, params: ScreenParams = DEFAULTS) -> tuple[list[str], list[str]]:
    """The months read from summaries and those read from bars, for an evaluation at ``as_of``."""
    now = month_of(as_of)
    starts = [month_of(lookback_start(as_of, days)) for days in (params.rsi_days, params.beta_days, params.band_days)]
    stored = [m for m in months_between(min(starts), now) if m <= last_stored and m < now]
    fresh = [m for m in months_between(min(starts), now) if m not in stored]
    return stored, sorted({*fresh, *starts[1:]})


def measures_from_summaries(
    summaries: DataFrame,
    read_months: MonthReader,
    last_stored: str,
    as_of: datetime,
    params: ScreenParams = DEFAULTS,
    universe: DataFrame | None = None,
) -> DataFrame:
    """The measures of ``evaluate``, from whole months up to ``last_stored`` and bars of the others.

    ``summaries`` has the months that ``lookback_months`` names; ``universe`` cuts bars and summaries
    to its tickers, the market's last bars apart.
    """
    stored, raw = lookback_months(as_of, last_stored, params)
    rsi, beta, band = (lookback_start(as_of, d) for d in (params.rsi_days, params.beta_days, params.band_days))
    bars = read_months(raw).where(F.col("ts") <= moment_literal(as_of)).select("ticker", "ts", "close")
    is_market = F.col("ticker") == params.market
    known = summaries.where(is_market).select("ticker", F.explode("tail").alias("bar")).select("ticker", "bar.*")
    market = bars.where(is_market).unionByName(known).distinct()
    if universe is not None:
        asked = universe.select("ticker").distinct()
        bars, summaries = (rows.join(asked, "ticker", "left_semi") for rows in (bars, summaries))

    def begun(start: datetime) -> DataFrame:
        """The month in which a lookback begins, from there on."""
        inside = F.col("ts").between(moment_literal(start), moment_literal(_month_end(start)))
        return month_summaries(bars.where(inside), market.where(inside), params)

    fresh = [m for m in raw if m not in stored]
    month = F.date_format("ts", "yyyy-MM")
    whole = summaries.where(F.col("month").isin(stored) if stored else F.lit(False)).unionByName(
        month_summaries(bars.where(month.isin(fresh)), market, params)
    )
    parts = (
        whole.withColumns({"in_band": F.col("month") > month_of(band), "in_beta": F.col("month") > month_of(beta), "in_tail": F.lit(True)})
        .unionByName(begun(band).withColumns({"in_band": F.lit(True), "in_beta": F.lit(False), "in_tail": F.lit(False)}))
        .unionByName(begun(beta).withColumns({"in_band": F.lit(False), "in_beta": F.lit(True), "in_tail": F.lit(False)}))
    )
    by_month = Window.partitionBy("ticker", "in_beta").orderBy("month")
    linked = parts.withColumn("_before", F.lag("last").over(by_month))
    pairs = F.when(F.col("in_beta"), F.concat(F.array("pairs"), _edge_pairs(beta)))
    merged = linked.groupBy("ticker").agg(
        _merged(F.collect_list(F.when(F.col("in_band"), F.struct("n", "mean", "m2")))).alias("band"),
        _merged_pairs(F.flatten(F.collect_list(pairs))).alias("pairs"),
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("in_tail"), F.col("tail"))))).alias("bars"),
    )
    final = F.element_at(F.filter("bars", lambda bar: bar["ts"] >= moment_literal(rsi)), -1)
    merged = merged.withColumn("final", F.when(F.size(F.filter("bars", lambda b: b["ts"] >= moment_literal(rsi))) > 0, final))
    more = F.col("band.n") > 1
    price_start = moment_literal(lookback_start(as_of, params.price_days))
    n_pairs = F.col("pairs.n")
    return merged.where(F.col("final").isNotNull()).select(
        "ticker",
        F.col("band.n").alias("band_bars"),
        F.when(F.col("final.ts") >= moment_literal(band), F.col("final.close")).alias("last_close"),
        F.when(F.col("band.n") > 0, F.col("band.mean")).alias("mean_close"),
        F.when(more, F.sqrt(F.col("band.m2") / (F.col("band.n") - 1))).alias("std_close"),
        F.when(F.col("final.ts") >= price_start, F.col("final.close")).alias("price"),
        *[value.alias(name) for name, value in _rsi_sums(F.col("bars"), rsi, params).items()],
        n_pairs.alias("n_common"),
        F.when(n_pairs > 1, F.col("pairs.c") / (n_pairs - 1)).alias("cov_market"),
        F.when(n_pairs > 1, F.col("pairs.m2") / (n_pairs - 1)).alias("var_market"),
    )


def _month_end(moment: datetime) -> datetime:
    """The last microsecond of a moment's month."""
    first = naive_utc(moment).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    return (first + timedelta(days=32)).replace(day=1) - timedelta(microseconds=1)
