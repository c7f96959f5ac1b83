import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from builders import AS_OF, bars, daily, values
from pyspark.sql import functions as F

from tickerloom.operators import daily as measures
from tickerloom.operators import indicators, resample
from tickerloom.operators.slices import with_lead_in


def random_walks(tickers=6, length=120, seed=3, step_minutes=37):
    rng = np.random.default_rng(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for k in range(tickers):
        count = length if k else length * 8  # the first holds most rows
        gaps = rng.integers(1, step_minutes * 20, count).cumsum()
        closes = np.round(50 + rng.normal(0, 1, count).cumsum(), 2)
        rows += [
            (f"T{k}", start + timedelta(minutes=int(g)), float(c))
            for g, c in zip(gaps, closes)
        ]
    return rows


def pandas_rsi(closes):
    change = closes.diff()
    up = change.clip(lower=0).rolling(14).mean()
    down = change.clip(upper=0).rolling(14).mean().abs()
    return 100 * up / (up + down)


def latest(spark, closes):
    frame = measures.rsi_latest(bars(spark, daily("A", closes)), AS_OF)
    return values(frame)["A"]["rsi"]


@pytest.mark.parametrize(
    "closes, expected",
    [
        (range(10, 25), 100),
        (range(25, 10, -1), 0),
        ([7.0] * 15, None),
        (range(10, 24), None),
    ],
)
def test_rsi_edges(spark, closes, expected):
    assert latest(spark, closes) == expected


def test_rsi_rounds_half_to_even(spark):
    # gains 21, losses 19 over 14 changes: 52.5
    steps = [3, -3, 3, -3, 3, -3, 3, -3, 3, -3, 3, -4, 3, 0]
    closes = np.concatenate([[50], 50 + np.cumsum(steps)])
    assert latest(spark, closes) == 52


def test_rsi_uses_only_the_lookback(spark):
    old = daily("A", range(100, 140), AS_OF - timedelta(days=800))
    new = daily("A", range(40, 50))
    assert values(measures.rsi_latest(bars(spark, old, new), AS_OF))["A"]["rsi"] is None


def test_rsi_at_a_date(spark):
    frame = bars(spark, daily("A", range(10, 40)), daily("B", [9.0] * 3))
    day = AS_OF - timedelta(days=1)
    found = values(indicators.rsi_at(frame, day, AS_OF))
    assert found["A"]["rsi"] == 100 and found["B"]["rsi"] is None
    assert indicators.rsi_at(frame, day + timedelta(hours=1), AS_OF).count() == 0


def test_rsi_series_matches_pandas(spark):
    rows = random_walks()
    result = indicators.rsi_series(bars(spark, rows)).toPandas()
    for ticker, part in pd.DataFrame(rows, columns=["ticker", "ts", "close"]).groupby("ticker"):
        mine = result[result.ticker == ticker].sort_values("ts").rsi.to_numpy(float)
        theirs = pandas_rsi(part.sort_values("ts").close).to_numpy()
        np.testing.assert_allclose(mine, theirs, atol=1e-8, equal_nan=True)
        assert np.nanmin(mine) >= 0 and np.nanmax(mine) <= 100


def test_changes_and_returns(spark):
    frame = bars(spark, daily("A", [10, 12, 0, 9]))
    changed = [row["chg"] for row in indicators.changes(frame).orderBy("ts").collect()]
    assert changed == [2.0, -12.0, 9.0]
    returned = [r["ret"] for r in indicators.simple_returns(frame).orderBy("ts").collect()]
    assert returned == [pytest.approx(0.2), -1.0]
    split = indicators.gain_loss(frame).orderBy("ts").collect()
    assert [(r["gain"], r["loss"]) for r in split] == [(2, 0), (0, -12), (9, 0)]


@pytest.mark.parametrize(
    "compute",
    [
        lambda b, every: indicators.changes(b, every),
        lambda b, every: indicators.simple_returns(b, every),
        lambda b, every: indicators.gain_loss(b, every),
        lambda b, every: indicators.moving_average(b, 20, "sma", every),
        lambda b, every: indicators.rsi_series(b, 14, every),
        lambda b, every: indicators.moving_average_signals(b, 3, 8, 30, every),
        lambda b, every: indicators.rsi_accuracy(b, 5, every),
        lambda b, every: indicators.rsi_turnover(b, every),
    ],
)
@pytest.mark.parametrize("every", ["6 hours", "9 days"])
def test_slices_change_nothing(spark, compute, every):
    frame = bars(spark, random_walks(4, 60)).repartition(3)
    whole = sorted(map(repr, compute(frame, None).collect()))
    sliced = sorted(map(repr, compute(frame, every).collect()))
    assert whole == sliced and whole


def test_slices_hand_over_exactly_the_rows_before(spark):
    frame = bars(spark, random_walks(3, 50))
    parts = with_lead_in(frame, 14, "2 days").toPandas()
    own = parts[~parts.lead_in]
    assert len(own) == frame.count()
    for (ticker, piece), group in parts.groupby(["ticker", "slice"]):
        before = own[(own.ticker == ticker) & (own.ts < piece)].sort_values("ts").ts.tail(14)
        assert sorted(group[group.lead_in].ts) == list(before)


def test_slices_bound_the_group_of_a_hot_ticker(spark):
    # one ticker with a tick per second for a day, among quiet ones
    busy = spark.range(86400).selectExpr(
        "'HOT' as ticker",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as ts",
        "50 + pmod(id * 7919, 101) / 100D as close",
    )
    quiet = spark.range(400).selectExpr(
        "concat('Q', id % 40) as ticker",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 216) as ts",
        "10 + id % 7 as close",
    )
    frame = busy.unionByName(quiet.withColumn("close", F.col("close").cast("double")))
    groups = with_lead_in(frame, 14, "1 hour").groupBy("ticker", "slice").count()
    assert groups.agg(F.max("count")).first()[0] == 3600 + 14
    whole = indicators.rsi_series(frame)
    sliced = indicators.rsi_series(frame, slice_every="1 hour")
    assert whole.exceptAll(sliced).isEmpty() and sliced.count() == 86800


def test_moving_average_signals(spark):
    closes = [10, 10, 10, 10, 11, 13, 15, 12, 8, 6, 5, 5]
    frame = bars(spark, daily("A", closes))
    rows = indicators.moving_average_signals(frame, 2, 4, 6).orderBy("ts").collect()
    series = pd.Series(closes, dtype=float)
    side = np.sign(series.rolling(2).mean() - series.rolling(4).mean())
    expected = [
        "up" if b <= 0 < a else "down" if a < 0 <= b else None
        for a, b in zip(side, side.shift())
    ]
    assert [row["cross"] for row in rows] == expected
    assert {"up", "down"} <= set(expected)
    assert rows[-1]["above_6"] is False and rows[0]["above_2"] is None


def test_rsi_accuracy_counts_confirmed_signals(spark):
    # rising throughout: every sell signal is wrong
    frame = bars(spark, daily("A", range(10, 40)))
    row = indicators.rsi_accuracy(frame).first()
    assert row["n_signals"] == 30 - 14 - 5 and row["accuracy"] == 0.0


def test_rsi_turnover_counts_zone_changes(spark):
    closes = [*range(10, 30), *range(29, 5, -1)]
    row = indicators.rsi_turnover(bars(spark, daily("A", closes))).first()
    rsi = pandas_rsi(pd.Series(closes, dtype=float)).dropna()
    zone = rsi.map(lambda x: "buy" if x <= 30 else "sell" if x >= 70 else "neutral")
    assert row["n_changes"] == int((zone != zone.shift()).sum()) - 1 == 2


def test_resample_from_ticks(spark):
    start = datetime(2024, 3, 10, 2, 15)
    data = [
        ("A", start, 5.0, 2),
        ("A", start, 6.0, 1),
        ("A", start + timedelta(minutes=20), 9.0, 3),
        ("A", start + timedelta(minutes=50), 4.0, 4),
        ("A", start + timedelta(minutes=10), None, 5),
        ("B", start, 1.0, 6),
    ]
    ticks = spark.createDataFrame(
        data, "ticker STRING, ts TIMESTAMP_NTZ, price DOUBLE, seq BIGINT"
    )
    hours = resample.resample(ticks, "1H", tie_breaker="seq").orderBy("ticker", "ts").collect()
    assert [tuple(row) for row in hours] == [
        ("A", datetime(2024, 3, 10, 2), 6.0, 9.0, 5.0, 9.0, 3, "hour"),
        ("A", datetime(2024, 3, 10, 3), 4.0, 4.0, 4.0, 4.0, 1, "hour"),
        ("B", datetime(2024, 3, 10, 2), 1.0, 1.0, 1.0, 1.0, 1, "hour"),
    ]
    days = resample.resample(ticks, "weekly", tie_breaker="seq")
    assert {(r["ticker"], r["freq"], r["close"]) for r in days.collect()} == {
        ("A", "day", 4.0),
        ("B", "day", 1.0),
    }


def test_latest_price(spark):
    frame = bars(
        spark,
        daily("A", [1, 2, 3]),
        daily("B", [4], AS_OF - timedelta(days=5)),
        daily("C", [5], AS_OF - timedelta(days=6)),
        daily("D", [5], AS_OF + timedelta(days=1)),
    )
    found = values(resample.latest_price(frame, AS_OF))
    assert {k: v["price"] for k, v in found.items()} == {"A": 3.0, "B": 4.0}


def test_input_order_does_not_matter(spark):
    frame = bars(spark, random_walks(3, 40))
    shuffled = frame.orderBy(F.rand(1))
    as_of = datetime(2024, 2, 1)
    one = sorted(map(repr, measures.rsi_latest(frame, as_of).collect()))
    two = sorted(map(repr, measures.rsi_latest(shuffled, as_of).collect()))
    assert one == two


def test_latest_rsi_is_the_last_of_the_series(spark):
    closes = np.round(50 + np.random.default_rng(4).normal(0, 1, 300).cumsum(), 2)
    for count in (14, 15, 16, 40, 300):
        frame = bars(spark, daily("A", closes[:count]))
        series = indicators.rsi_series(frame).orderBy(F.col("ts").desc()).first()["rsi"]
        latest_rsi = values(measures.rsi_latest(frame, AS_OF))["A"]["rsi"]
        assert latest_rsi == (None if series is None else np.rint(series))


def test_wider_price_windows_are_read_only_for_tickers_without_a_price(spark):
    last = AS_OF
    rows = [("NOW", last, 1.0), ("DAY", last - timedelta(hours=20), 2.0), ("DAY", last - timedelta(days=2), 9.0)]
    old = [("OLD", last - timedelta(days=4), 3.0), ("OLD", last - timedelta(days=5), 4.0), ("GONE", last - timedelta(days=6), 5.0)]
    table = bars(spark, rows, old)
    tickers = spark.createDataFrame([(t,) for t in ("NOW", "DAY", "OLD", "GONE", "NONE", "NOW")], "ticker STRING")
    found = {r.ticker: (r.price, r.window) for r in resample.widening_price(table, AS_OF, tickers).collect()}
    assert found == {"NOW": (1.0, 5 / 1440), "DAY": (2.0, 1.0), "OLD": (3.0, 5.0)}
    latest = {r.ticker: r.price for r in resample.latest_price(table, AS_OF).collect()}
    assert {t: p for t, (p, _) in found.items()} == latest
    # reading anything older than a day fails
    young = F.when(F.col("ts") >= F.lit(AS_OF - timedelta(days=1)).cast("timestamp_ntz"), F.col("close"))
    strict = table.withColumn("close", young.otherwise(F.raise_error(F.lit("read"))))
    asked = tickers.where("ticker in ('NOW', 'DAY')")
    assert resample.widening_price(strict, AS_OF, asked).count() == 2
    with pytest.raises(Exception, match="read"):
        resample.widening_price(strict, AS_OF, tickers).collect()
    assert resample.widening_price(table, AS_OF, tickers.where("false")).count() == 0


@pytest.mark.parametrize("every", ["2 days", "40 days"])
def test_rsi_at_requests_against_brute_force(spark, every):
    rng = np.random.default_rng(21)
    table, closes = [], {}
    for ticker in ("HOT", "A", "FLAT"):
        for i in range(120 if ticker == "HOT" else 40):
            ts = AS_OF - timedelta(days=int(i * (1 if ticker == "HOT" else 2.9)), hours=6)
            close = 5.0 if ticker == "FLAT" else float(round(50 + rng.normal(), 3))
            table.append((ticker, ts, close))
            closes.setdefault(ticker, []).append((ts, close))
    asked = [(t, AS_OF - timedelta(days=int(d), hours=int(h))) for t in ("HOT", "A", "FLAT", "NONE") for d, h in zip(rng.integers(-5, 140, 60), rng.choice([0, 6, 7], 60), strict=True)]
    requests = spark.createDataFrame(asked + asked[:5], "ticker STRING, ts TIMESTAMP_NTZ")
    found = indicators.rsi_at_requests(bars(spark, table), requests, slice_every=every).collect()
    assert len(found) == len(set(asked))
    for r in found:
        known = sorted(x for x in closes.get(r.ticker, []) if x[0] <= r.ts)
        assert r.bar_ts == (known[-1][0] if known else None)
        changes = np.diff([c for _, c in known])[-14:]
        total = np.abs(changes).sum()
        rsi = None
        if len(changes) == 14 and total:
            rsi = round(100 * changes[changes > 0].sum() / total)
        assert r.rsi_as_of == rsi
        assert r.rsi_exact == (rsi if known and known[-1][0] == r.ts else None)


def test_requests_spread_a_hot_ticker(spark):
    requests = spark.createDataFrame([("A", AS_OF)], "ticker STRING, ts TIMESTAMP_NTZ")
    frame = indicators.rsi_at_requests(bars(spark, daily("A", range(40))), requests, slice_every="5 days")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "last(bar" in line]
    assert windows and all(re.search(r"\[ticker#\d+, piece#\d+\]", line) for line in windows)
