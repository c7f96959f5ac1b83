"""Monthly summaries against the full evaluation."""

import math
import random
import re
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from builders import BAR
from pyspark.sql import functions as F

from tickerloom.operators import evaluate as ev
from tickerloom.operators import incremental as inc
from tickerloom.params import DEFAULTS
from tickerloom.sources.bars import read_months, write_bars

END = datetime(2024, 6, 28)


def series(rng, ticker, first, last, density):
    """A walk with gaps, and closes that stay equal at times."""
    out, level, day = [], 100.0, first
    while day <= last:
        if rng.random() < density:
            level = level if rng.random() < 0.1 else max(1.0, level + rng.gauss(0, 2))
            out.append((ticker, day, round(level, 4)))
        day += timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    start = datetime(2022, 3, 1)
    out = series(rng, "SPY", start, END, 0.7)
    out += series(rng, "DENSE", start, END, 0.95) + series(rng, "THIN", start, END, 0.08)
    out += series(rng, "NEW", END - timedelta(days=25), END, 0.9)
    out += series(rng, "GONE", start, END - timedelta(days=100), 0.8)
    out += series(rng, "LAPSED", start, END - timedelta(days=500), 0.5)
    out += [("ONE", END - timedelta(days=3), 7.0), ("EDGE", END - timedelta(days=400), 5.0), ("EDGE", END, 6.0)]
    out += [("TWICE", datetime(2024, 5, 31), 9.0), ("TWICE", datetime(2024, 6, 1), 8.0), ("FUTURE", END + timedelta(days=9), 1.0)]
    return out


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('incremental')}/bars"
    write_bars(spark.createDataFrame(rows, BAR).withColumn("freq", F.lit("day")), path)
    return lambda months: read_months(spark, path, months, "day")


MEASURES = ["band_bars", "last_close", "mean_close", "std_close", "price", "n_common", "cov_market", "var_market"]


def close_to(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("as_of", [END, datetime(2024, 6, 1), datetime(2024, 2, 29, 12)])
@pytest.mark.parametrize("behind", [0, 5, 30])
def test_measures_equal_the_full_evaluation(spark, rows, stored, tmp_path, as_of, behind):
    last = inc.month_of(as_of.replace(day=1) - timedelta(days=1 + 30 * behind))
    past, _ = inc.lookback_months(as_of, last)
    store = inc.SummaryStore(spark, f"{tmp_path}/summaries")
    if past:
        earlier = stored([*past, inc.month_of(datetime.fromisoformat(past[0] + "-01") - timedelta(days=1))])
        store.write(inc.month_summaries(earlier.where(F.date_format("ts", "yyyy-MM").isin(past)), earlier))
        summaries = store.read(past)
    else:
        summaries = spark.createDataFrame([], inc.SUMMARY)
    found = inc.measures_from_summaries(summaries, stored, last, as_of)
    frame = spark.createDataFrame(rows, BAR).where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))
    full = {r.ticker: r for r in ev._measures(frame, frame, as_of, DEFAULTS).collect()}
    mine = {r.ticker: r for r in found.collect()}
    assert set(mine) == set(full)
    for ticker, r in mine.items():
        for name in MEASURES:
            assert close_to(r[name], full[ticker][name]), (ticker, name, r, full[ticker])
        assert r.n_changes == full[ticker].n_changes
        if r.n_changes:
            assert close_to(r.gains, full[ticker].gains) and close_to(r.losses, full[ticker].losses)
    rounded = ev.from_measures(found, as_of).collect()
    assert sorted(map(repr, rounded)) == sorted(map(repr, ev.evaluate(frame, as_of).collect()))


def test_only_new_and_beginning_months_are_read(spark, stored):
    last = "2024-05"
    past, raw = inc.lookback_months(END, last)
    assert raw == ["2023-05", "2024-03", "2024-06"]
    assert past[0] == "2022-07" and past[-1] == last and len(past) == 23
    read = []

    def reader(months):
        frame = stored(months)
        read.extend(frame.inputFiles())
        return frame

    earlier = stored(past)
    found = inc.measures_from_summaries(inc.month_summaries(earlier, earlier), reader, last, END)
    assert found.count() > 3
    plan = stored(raw)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2023-05" in plan.split("PartitionFilters")[1]
    pruned = spark.createDataFrame([(f,) for f in {*stored(raw).select(F.input_file_name().alias("f")).distinct().toPandas().f}], "f STRING")
    months = {re.search(r"month=([0-9-]+)", r.f)[1] for r in pruned.collect()}
    assert months == set(raw)


def test_universe_and_short_lookbacks(spark, rows, stored):
    params = replace(DEFAULTS, rsi_days=40, beta_days=20, band_days=10, rsi_bars=3)
    asked = spark.createDataFrame([("DENSE",), ("THIN",), ("NONE",)], "ticker STRING")
    past, _ = inc.lookback_months(END, "2024-05", params)
    earlier = stored(past)
    summaries = inc.month_summaries(earlier, earlier, params)
    found = inc.measures_from_summaries(summaries, stored, "2024-05", END, params, universe=asked)
    frame = spark.createDataFrame(rows, BAR)
    whole = ev.evaluate(frame, END, universe=asked, params=params)
    mine = ev.from_measures(found, END, universe=asked, params=params)
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, whole.collect()))


def test_a_month_written_again_replaces_itself_only(spark, stored, tmp_path):
    store = inc.SummaryStore(spark, f"{tmp_path}/again")
    months = ["2024-04", "2024-05"]
    bars = stored(months)
    summaries = inc.month_summaries(bars, bars)
    store.write(summaries)
    before = sorted(map(repr, store.read(months).collect()))
    store.write(summaries.where("month = '2024-05'"))
    assert sorted(map(repr, store.read(months).collect())) == before and store.months() == months
