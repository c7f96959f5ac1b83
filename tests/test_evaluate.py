from dataclasses import replace
from datetime import timedelta

import numpy as np
import pytest
from builders import AS_OF, bars, daily, fact, facts, values
from pyspark.sql import functions as F

from tickerloom.operators import daily as measures
from tickerloom.operators import evaluate as ev
from tickerloom.params import DEFAULTS


def walk(seed, count, level=100):
    return level + np.random.default_rng(seed).normal(0, 1, count).cumsum()


def market():
    return daily("SPY", walk(99, 300))


CASES = {
    "GOOD": daily("GOOD", walk(1, 120)),
    "PENNY": daily("PENNY", walk(2, 120, level=500) * 0 + 5.0),
    "STALE": daily("STALE", walk(3, 120), AS_OF - timedelta(days=6)),
    "OLD": daily("OLD", walk(4, 120), AS_OF - timedelta(days=91)),
    "FLAT": daily("FLAT", [50.0] * 60),
    "SHORT": daily("SHORT", walk(5, 14)),
    "FALL": daily("FALL", np.linspace(90, 60, 40)),
}
UNIVERSE = [*CASES, "NONE", "SPY"]
REASONS = {
    "GOOD": None,
    "SPY": None,
    "PENNY": "penny",
    "STALE": "no_price",
    "OLD": "no_bars",
    "NONE": "no_bars",
    "FLAT": "rsi_undefined",
    "SHORT": "rsi_undefined",
    "FALL": "rsi_zero",
}


@pytest.fixture(scope="module")
def table(spark):
    return bars(spark, market(), *CASES.values())


@pytest.fixture(scope="module")
def universe(spark):
    return spark.createDataFrame([(name,) for name in UNIVERSE], "ticker STRING")


@pytest.fixture(scope="module")
def evaluated(spark, table, universe):
    return ev.evaluate(table, AS_OF, universe=universe)


def test_reasons(evaluated):
    assert {k: v["reason"] for k, v in values(evaluated).items()} == REASONS


def test_snapshot_and_rejects(evaluated):
    assert set(values(ev.snapshot(evaluated))) == {"GOOD", "SPY"}
    assert set(values(ev.snapshot(evaluated, drop_zero_rsi=False))) == {"GOOD", "SPY", "FALL"}
    assert set(values(ev.rejects(evaluated))) == set(UNIVERSE) - {"GOOD", "SPY"}


def test_run_counts(evaluated):
    counts = {r["outcome"]: r["n_tickers"] for r in ev.run_counts(evaluated).collect()}
    assert counts == {
        "accepted": 2, "penny": 1, "no_price": 1, "no_bars": 2, "rsi_undefined": 2, "rsi_zero": 1,
    }


def test_without_universe_all_bars_are_evaluated(table):
    found = values(ev.evaluate(table, AS_OF))
    assert set(found) == set(UNIVERSE) - {"NONE"}
    assert {k: v["reason"] for k, v in found.items()} == {
        k: v for k, v in REASONS.items() if k != "NONE"
    }


def test_agrees_with_the_separate_operators(table, evaluated):
    found = values(evaluated)
    bands = values(measures.price_band(table, AS_OF))
    rsi = values(measures.rsi_latest(table, AS_OF))
    beta = values(measures.market_beta(table, AS_OF))
    for ticker in ("GOOD", "SPY", "FALL"):
        assert found[ticker]["pct_below_ci"] == bands[ticker]["pct_below_ci"]
        assert found[ticker]["rsi"] == rsi[ticker]["rsi"]
        assert found[ticker]["beta"] == beta[ticker]["beta"]


def test_other_lookbacks_than_the_longest(table):
    params = replace(DEFAULTS, rsi_days=30, beta_days=100)
    found = values(ev.evaluate(table, AS_OF, params=params))
    rsi = values(measures.rsi_latest(table, AS_OF, params))
    beta = values(measures.market_beta(table, AS_OF, params))
    assert found["GOOD"]["rsi"] == rsi["GOOD"]["rsi"]
    assert found["GOOD"]["beta"] == beta["GOOD"]["beta"]


def test_older_bars_change_nothing(spark, table, evaluated):
    older = bars(spark, daily("GOOD", walk(8, 50), AS_OF - timedelta(days=721)))
    found = values(ev.evaluate(table.unionByName(older), AS_OF))
    assert found["GOOD"] == values(evaluated)["GOOD"]


def test_prices_from_minute_bars(spark, table, universe):
    minutes = bars(
        spark,
        [("GOOD", AS_OF - timedelta(minutes=3), 80.0), ("GOOD", AS_OF, 70.0)],
        [("STALE", AS_OF - timedelta(days=5), 60.0)],
    )
    found = values(ev.evaluate(table, AS_OF, universe=universe, price_bars=minutes))
    assert found["GOOD"]["reason"] is None and found["GOOD"]["pct_below_ci"] > 20
    assert found["STALE"]["reason"] is None
    assert found["SPY"]["reason"] == "no_price"


def test_factors_join_in_upper_case(spark, table):
    lower = table.withColumn("ticker", F.lower("ticker")).where("ticker = 'good'")
    filed = facts(
        spark,
        fact("1", "StockholdersEquity", "2022-12-31", "2023-02-01", 4e9),
        fact("1", "CommonStockSharesOutstanding", "2022-12-31", "2023-02-01", 1e8, unit="shares"),
    )
    cik_map = spark.createDataFrame([("GOOD", "1")], "ticker STRING, cik STRING")
    row = values(ev.evaluate(lower, AS_OF, facts=filed, cik_map=cik_map))["good"]
    price = round(CASES["GOOD"][-1][2] * 1e8 / 1e9, 2)
    assert row["mcap"] == price and row["bm"] == pytest.approx(0.4 / price * 10, rel=0.01)


def test_lookup_status(spark, evaluated):
    found = values(ev.lookup(evaluated))
    assert {k: v["status"] for k, v in found.items()} == {
        "GOOD": "ok",
        "SPY": "ok",
        "FALL": "ok",
        "PENNY": "error",  # its closes are flat, so the RSI fails first
        "STALE": "not_found",
        "OLD": "not_found",
        "NONE": "error",
        "FLAT": "error",
        "SHORT": "error",
    }
    assert found["FALL"]["rsi"] == 0 and found["STALE"]["rsi"] is None


def test_coverage(spark, table, universe):
    covered = ev.coverage(universe, table, AS_OF)
    missing = {k for k, v in values(covered).items() if not v["covered"]}
    assert missing == {"STALE", "OLD", "NONE"}
    counts = {r["covered"]: r["n_tickers"] for r in ev.coverage_counts(covered).collect()}
    assert counts == {True: 6, False: 3}


def test_counts_come_from_the_write_itself(spark, evaluated, tmp_path):
    counts = ev.write_counted(evaluated, f"{tmp_path}/rows")
    want = {r.outcome: r.n_tickers for r in ev.run_counts(evaluated).collect()}
    assert counts == want and sum(counts.values()) == len(UNIVERSE)
    stored = spark.read.parquet(f"{tmp_path}/rows")
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, evaluated.collect()))
    assert ev.write_counted(evaluated.where("false"), f"{tmp_path}/none") == {}
