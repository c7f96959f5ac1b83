from dataclasses import replace
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from builders import AS_OF, BAR, bars, daily, values

from tickerloom.operators import daily as measures
from tickerloom.params import DEFAULTS


def band(spark, *series, **overrides):
    params = replace(DEFAULTS, **overrides)
    return values(measures.price_band(bars(spark, *series), AS_OF, params=params))


def walk(seed, count, level=100):
    return level + np.random.default_rng(seed).normal(0, 1, count).cumsum()


def test_band_matches_pandas(spark):
    closes = pd.Series(walk(1, 60))
    row = band(spark, daily("A", closes))["A"]
    lower = closes.mean() - 2 * closes.std()
    assert row["lower_band"] == pytest.approx(lower)
    assert row["pct_below_ci"] == np.round((1 - closes.iloc[-1] / lower) * 100, 2)


def test_band_of_one_bar_is_undefined(spark):
    row = band(spark, daily("A", [10]))["A"]
    assert row["band_bars"] == 1 and row["pct_below_ci"] is None


def test_band_lookback_includes_both_ends(spark):
    closes = [10.0] * 95
    assert band(spark, daily("A", closes))["A"]["band_bars"] == 91


def test_band_zero_lower_bound(spark):
    # mean 1, deviation 0.5 exactly is impossible to rely on; force it with zero sigmas
    row = band(spark, daily("A", [-1, 1]), band_sigmas=0.0)["A"]
    assert row["lower_band"] == 0.0 and row["pct_below_ci"] is None


def test_band_takes_separate_prices(spark):
    frame = bars(spark, daily("A", walk(1, 30)), daily("B", walk(2, 30)))
    prices = spark.createDataFrame([("A", 50.0)], "ticker STRING, price DOUBLE")
    found = values(measures.price_band(frame, AS_OF, prices))
    assert found["A"]["price"] == 50.0 and found["A"]["pct_below_ci"] > 0
    assert found["B"]["price"] is None and found["B"]["pct_below_ci"] is None


def test_penny_limit_is_exclusive(spark):
    frame = bars(spark, daily("A", [9, 5.0]), daily("B", [1, 5.01]))
    assert set(values(measures.penny_filter(frame, AS_OF))) == {"B"}


def betas(spark, *series, **overrides):
    params = replace(DEFAULTS, **overrides)
    return values(measures.market_beta(bars(spark, *series), AS_OF, params))


def test_beta_matches_pandas(spark):
    market, stock = pd.Series(walk(1, 200)), pd.Series(walk(2, 200))
    found = betas(spark, daily("SPY", market), daily("A", stock), daily("B", market))
    m, s = market.pct_change().dropna(), stock.pct_change().dropna()
    assert found["A"]["beta"] == pytest.approx(s.cov(m) / m.var(), abs=0.0051)
    assert found["SPY"]["beta"] == found["B"]["beta"] == 1.0


@pytest.mark.parametrize("count, known", [(30, False), (31, True)])
def test_beta_needs_thirty_common_returns(spark, count, known):
    found = betas(spark, daily("SPY", walk(1, 60)), daily("A", walk(2, count)))
    assert found["A"]["n_common"] == count - 1
    assert (found["A"]["beta"] is not None) is known


def test_beta_of_a_flat_market_is_undefined(spark):
    found = betas(spark, daily("SPY", [10] * 60), daily("A", walk(2, 60)))
    assert found["A"]["n_common"] == 59 and found["A"]["beta"] is None


def test_beta_without_market_is_undefined(spark):
    found = betas(spark, daily("A", walk(2, 60)))
    assert found["A"]["n_common"] == 0 and found["A"]["beta"] is None


def test_beta_uses_common_timestamps_only(spark):
    market = daily("SPY", walk(1, 90))
    shifted = [(t, ts + timedelta(hours=1), c) for t, ts, c in daily("A", walk(2, 90))]
    assert betas(spark, market, shifted)["A"]["n_common"] == 0


def test_no_return_from_before_the_lookback(spark):
    first = AS_OF - timedelta(days=401)
    series = [("A", first, 1.0), ("A", first + timedelta(days=2), 2.0), ("A", AS_OF, 3.0)]
    market = [("SPY", ts, close) for _, ts, close in series]
    assert betas(spark, series, market)["A"]["n_common"] == 1


def test_scaling_changes_no_measure(spark):
    market, stock = walk(1, 120), walk(2, 120)
    found = betas(spark, daily("SPY", market), daily("A", stock), daily("B", stock * 8))
    assert found["A"]["beta"] == found["B"]["beta"]
    bands = band(spark, daily("A", stock), daily("B", stock * 8))
    assert bands["A"]["pct_below_ci"] == bands["B"]["pct_below_ci"]


def twice_a_day(spark, tickers):
    """100 days with two bars each."""
    start = AS_OF - timedelta(days=99)
    rows = [
        (name, start + timedelta(days=d // 2, hours=-6 * (d % 2 == 0)), 100.0 + 7 * ((d * k) % 11))
        for k, name in enumerate(tickers, 3)
        for d in range(200)
    ]
    return spark.createDataFrame(rows, BAR)


def test_two_bars_a_day_fail_loudly_in_daily_measures(spark):
    bars = twice_a_day(spark, ["SPY", "A"])
    with pytest.raises(Exception, match="more than one bar"):
        measures.market_beta(bars, AS_OF).collect()


@pytest.mark.parametrize("every", ["3 days", "400 days"])
def test_intraday_beta_uses_every_common_timestamp(spark, every):
    bars = twice_a_day(spark, ["SPY", "A"])
    found = {r["ticker"]: r for r in measures.intraday_beta(bars, AS_OF, every).collect()}
    assert (found["SPY"]["n_common"], found["SPY"]["beta"]) == (199, 1.0)
    assert found["A"]["n_common"] == 199
