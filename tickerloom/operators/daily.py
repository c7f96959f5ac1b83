"""Measures of daily bars: price band, relative strength, market beta.

The column and aggregate builders here are shared, so that the full evaluation computes
all of them from one scan, one shuffle by ticker and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickerloom.functions.moments import in_lookback, lookback_start, moment_literal
from tickerloom.functions.numeric import half_even
from tickerloom.operators.resample import latest_price
from tickerloom.operators.slices import over_series
from tickerloom.params import DEFAULTS, ScreenParams


def _last_close(where: Column) -> Column:
    # both arguments are conditional: rows with a NULL ordering key do not count
    return F.max_by(F.when(where, F.col("close")), F.when(where, F.col("ts")))


def band_aggregates(as_of: datetime, params: ScreenParams) -> list[Column]:
    """Bar count, last close, mean and sample deviation over the band lookback."""
    inside = in_lookback(F.col("ts"), as_of, params.band_days)
    close = F.when(inside, F.col("close"))
    return [
        F.count(close).alias("band_bars"),
        _last_close(inside).alias("last_close"),
        F.avg(close).alias("mean_close"),
        F.stddev_samp(close).alias("std_close"),
    ]


def price_aggregate(as_of: datetime, params: ScreenParams) -> Column:
    inside = in_lookback(F.col("ts"), as_of, params.price_days)
    return _last_close(inside).alias("price")


def lower_band(params: ScreenParams) -> Column:
    return F.col("mean_close") - F.lit(params.band_sigmas) * F.col("std_close")


def pct_below_band(params: ScreenParams) -> Column:
    """How far the price lies below the lower band, in percent of the band."""
    below = (1 - F.try_divide(F.col("price"), lower_band(params))) * 100
    return half_even(below, 2)


def price_band(
    bars: DataFrame,
    as_of: datetime,
    prices: DataFrame | None = None,
    params: ScreenParams = DEFAULTS,
) -> DataFrame:
    """Band and distance per ticker with bars in the band lookback.

    ``prices(ticker, price)`` defaults to the latest close of the same bars.
    """
    banded = (
        bars.where(in_lookback(F.col("ts"), as_of, params.band_days))
        .groupBy("ticker")
        .agg(*band_aggregates(as_of, params), price_aggregate(as_of, params))
    )
    if prices is not None:
        banded = banded.drop("price").join(prices, "ticker", "left")
    return banded.withColumns(
        {"lower_band": lower_band(params), "pct_below_ci": pct_below_band(params)}
    )


def penny_filter(
    bars: DataFrame, as_of: datetime, params: ScreenParams = DEFAULTS
) -> DataFrame:
    """Tickers whose last close in the band lookback exceeds the penny limit."""
    last = latest_price(bars, as_of, params.band_days)
    return last.where(F.col("price") > params.penny_limit).withColumnRenamed(
        "price", "last_close"
    )


def _by_time(parts: Sequence[str] = ("ticker",)) -> WindowSpec:
    return Window.partitionBy(*parts).orderBy("ts")


def _within(
    as_of: datetime, days_back: float, parts: Sequence[str] = ("ticker",)
) -> Column:
    """True where this bar and the one before it both lie in the lookback.

    A scan that starts earlier must not lend the first bar of a lookback a predecessor.
    """
    start = moment_literal(lookback_start(as_of, days_back))
    return F.lag("ts").over(_by_time(parts)) >= start


def beta_return(
    as_of: datetime, params: ScreenParams, parts: Sequence[str] = ("ticker",)
) -> Column:
    """Return on the bar before, inside the beta lookback."""
    previous = F.lag("close").over(_by_time(parts))
    ratio = F.try_divide(F.col("close"), previous) - 1
    return F.when(_within(as_of, params.beta_days, parts), ratio)


def last_changes(as_of: datetime, params: ScreenParams) -> Column:
    """Change on the bar before, inside the RSI lookback, for a ticker's last bars only.

    The last RSI needs no frame per bar: with only its ``rsi_bars`` changes left, plain
    sums per ticker give it.
    """
    previous = F.lag("close").over(_by_time())
    is_last = F.lead("ts", params.rsi_bars).over(_by_time()).isNull()
    inside = is_last & _within(as_of, params.rsi_days)
    return F.when(inside, F.col("close") - previous)


def rsi_aggregates() -> list[Column]:
    """Sums of gains and losses and the number of changes, from ``last_chg``."""
    zero = F.lit(0.0)
    return [
        F.sum(F.greatest("last_chg", zero)).alias("gains"),
        F.sum(F.greatest(-F.col("last_chg"), zero)).alias("losses"),
        F.count("last_chg").alias("n_changes"),
    ]


def rsi_value(params: ScreenParams) -> Column:
    """Whole-number RSI from its aggregates; NULL if undefined at the last bar."""
    rsi = F.try_divide(100 * F.col("gains"), F.col("gains") + F.col("losses"))
    return F.when(F.col("n_changes") >= params.rsi_bars, half_even(rsi).cast("int"))


def rsi_latest(
    bars: DataFrame, as_of: datetime, params: ScreenParams = DEFAULTS
) -> DataFrame:
    """RSI of each ticker's last bar in the lookback; earlier bars are not consulted."""
    window = bars.where(in_lookback(F.col("ts"), as_of, params.rsi_days))
    return (
        window.withColumn("last_chg", last_changes(as_of, params))
        .groupBy("ticker")
        .agg(*rsi_aggregates())
        .select("ticker", rsi_value(params).alias("rsi"))
    )


def market_days(market: DataFrame, params: ScreenParams = DEFAULTS) -> DataFrame:
    """The market's bars ``(ticker, close, ts)``, one a day.

    A day with more bars fails the job, since leaving any of them out would change every beta;
    ``bar_key_violations`` on the days, or ``intraday_beta``, is for such tables.
    """
    several = F.raise_error(
        F.concat(
            F.lit(f"{params.market} has more than one bar on "),
            F.to_date(F.max("ts")).cast("string"),
            F.lit("; daily measures need daily bars, intraday_beta takes others"),
        )
    ).cast("double")
    return market.groupBy("ticker", F.to_date("ts").alias("day")).agg(
        F.when(F.count("*") > 1, several).otherwise(F.max("close")).alias("close"),
        F.max("ts").alias("ts"),
    )


def market_returns(
    bars: DataFrame, as_of: datetime, params: ScreenParams = DEFAULTS
) -> DataFrame:
    """Returns ``(ts, m_ret)`` of the market ticker's daily bars over the beta lookback.

    One bar a day bounds the result by the days of the lookback, so it may be broadcast.
    """
    market = bars.where(
        (F.col("ticker") == params.market)
        & in_lookback(F.col("ts"), as_of, params.beta_days)
    )
    daily = market_days(market, params)
    return daily.select("ts", beta_return(as_of, params).alias("m_ret")).where(
        F.col("m_ret").isNotNull()
    )


def beta_aggregates() -> list[Column]:
    """Common count, covariance and market variance of ``ret`` and ``m_ret``."""
    common = F.col("ret").isNotNull() & F.col("m_ret").isNotNull()
    return [
        F.count_if(common).alias("n_common"),
        F.covar_samp("ret", "m_ret").alias("cov_market"),
        F.var_samp(F.when(common, F.col("m_ret"))).alias("var_market"),
    ]


def beta_value(params: ScreenParams) -> Column:
    ratio = F.try_divide(F.col("cov_market"), F.col("var_market"))
    return F.when(
        F.col("n_common") >= params.min_common_returns, half_even(ratio, 2)
    )


def market_beta(
    bars: DataFrame,
    as_of: datetime,
    params: ScreenParams = DEFAULTS,
    market_bars: DataFrame | None = None,
) -> DataFrame:
    """Beta of every ticker against the market ticker; NULL with too few common returns."""
    window = bars.where(in_lookback(F.col("ts"), as_of, params.beta_days))
    market = market_returns(bars if market_bars is None else market_bars, as_of, params)
    returns = window.withColumn("ret", beta_return(as_of, params))
    return (
        returns.join(F.broadcast(market), "ts", "left")
        .groupBy("ticker")
        .agg(*beta_aggregates())
        .withColumn("beta", beta_value(params))
    )


def intraday_beta(
    bars: DataFrame,
    as_of: datetime,
    slice_every: str,
    params: ScreenParams = DEFAULTS,
) -> DataFrame:
    """Beta from bars of any frequency, over every timestamp a ticker shares with the market.

    Returns are computed in slices of time, so a long series is spread over tasks. The join
    with the market has no hint: AQE broadcasts its returns if they are small and joins by
    time if they are not.
    """
    window = bars.where(in_lookback(F.col("ts"), as_of, params.beta_days))

    def with_returns(series: DataFrame, parts: list[str]) -> DataFrame:
        return series.withColumn("ret", beta_return(as_of, params, parts))

    returns = over_series(window.select("ticker", "ts", "close"), with_returns, 1, slice_every)
    market = returns.where((F.col("ticker") == params.market) & F.col("ret").isNotNull())
    return (
        returns.join(market.select("ts", F.col("ret").alias("m_ret")), "ts", "left")
        .groupBy("ticker")
        .agg(*beta_aggregates())
        .withColumn("beta", beta_value(params))
    )
