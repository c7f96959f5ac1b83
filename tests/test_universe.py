import random
from datetime import datetime

import pytest
from builders import AS_OF, bars, daily, values
from test_evaluate import CASES, market, walk

from tickerloom import ScreenParams, Screener
from tickerloom.operators import ordering, screening
from tickerloom.operators import universe as uni
from tickerloom.schemas import EVALUATION, SNAPSHOT_COLUMNS, UNIVERSE
from tickerloom.sources.universes import SEQ_STRIDE, UniverseStore, UnknownUniverse

OLD = datetime(2024, 1, 1)
REASONS = [None, "penny", "no_bars", "no_price", "rsi_undefined", "rsi_zero"]


def row(ticker, rsi=50, ci=1.0, bm=None, op=None, inv=None, beta=None, mcap=None, seq=0):
    return (ticker, ci, rsi, bm, op, inv, beta, mcap, seq, OLD)


def stored(spark, *rows):
    return spark.createDataFrame(list(rows), UNIVERSE)


def fresh(spark, prefix=""):
    """One evaluated ticker per outcome."""
    rows = []
    for reason in REASONS:
        rsi = {"rsi_zero": 0, "rsi_undefined": None}.get(reason, 33)
        rows.append((f"{prefix}{reason}", 9.0, rsi, None, None, None, None, None, reason))
    return spark.createDataFrame(rows, EVALUATION)


def outcome(frame):
    return {k: (v["rsi"], v["as_of"]) for k, v in values(frame).items()}


def test_refresh_matrix(spark):
    old = stored(spark, *[row(str(reason), seq=i) for i, reason in enumerate(REASONS)])
    assert outcome(uni.refresh(old, fresh(spark), AS_OF)) == {
        "None": (33, AS_OF),
        "no_bars": (50, OLD),
        "no_price": (50, OLD),
        "rsi_undefined": (50, OLD),
    }


def test_refresh_drops_an_old_rsi_of_zero(spark):
    old = stored(spark, *[row(str(reason), rsi=0) for reason in REASONS])
    assert set(values(uni.refresh(old, fresh(spark), AS_OF))) == {"None"}


def test_refresh_replaces_by_null(spark):
    old = stored(spark, row("None", bm=0.5))
    found = values(uni.refresh(old, fresh(spark), AS_OF))["None"]
    assert found["bm"] is None and found["pct_below_ci"] == 9.0


def test_create_matrix(spark):
    unlisted = [row(f"u_{reason}", seq=10 + i) for i, reason in enumerate(REASONS)]
    listed = [row(f"l_{reason}", seq=i) for i, reason in enumerate(REASONS)]
    evaluated = fresh(spark, "u_").union(fresh(spark, "l_")).union(fresh(spark, "n_"))
    names = [f"{p}{reason}" for p in ("n_", "l_") for reason in REASONS]
    listing = spark.createDataFrame(
        [(name, i) for i, name in enumerate([*names, "n_None"])],
        "ticker STRING, ordinal BIGINT",
    )
    result = uni.create(stored(spark, *unlisted, *listed), listing, evaluated, AS_OF, 1000)
    assert outcome(result) == {
        "u_None": (33, AS_OF),
        "u_no_bars": (50, OLD),
        "u_no_price": (50, OLD),
        "u_rsi_undefined": (50, OLD),
        "l_None": (33, AS_OF),
        "n_None": (33, AS_OF),
    }
    assert {k: v["seq"] for k, v in values(result).items() if k.endswith("None")} == {
        "u_None": 10,
        "l_None": 0,
        "n_None": 1000,
    }


def test_add_matrix(spark):
    names = [str(reason) for reason in REASONS]
    candidates = spark.createDataFrame(
        [(name, i) for i, name in enumerate(names)], "ticker STRING, ordinal BIGINT"
    )
    result = uni.add(stored(spark, row("X")), candidates, fresh(spark), AS_OF, 1000)
    assert outcome(result) == {"X": (50, OLD), "None": (33, AS_OF), "rsi_zero": (0, AS_OF)}
    present = uni.add(stored(spark, row("None")), candidates, fresh(spark), AS_OF, 1000)
    assert outcome(present)["None"] == (50, OLD)


def test_remove_and_reset(spark):
    old = stored(spark, row("A"), row("B"))
    gone = spark.createDataFrame([("A",), ("Z",)], "ticker STRING")
    assert set(values(uni.remove(old, gone))) == {"B"}
    assert uni.reset(old).isEmpty() and uni.reset(old).schema == UNIVERSE


def order(spark, choice, **column):
    (name, entries), = column.items()
    rows = [row(f"T{i}", seq=i, **{name: value}) for i, value in enumerate(entries)]
    frame = stored(spark, *rows).repartition(4)
    listed = [r["ticker"] for r in ordering.sort_rows(frame, choice).collect()]
    placed = {r["pos"]: r["ticker"] for r in ordering.numbered(frame, choice).collect()}
    assert [placed[i + 1] for i in range(len(listed))] == listed
    top = [r["ticker"] for r in ordering.top_rows(frame, 2, choice).collect()]
    assert top == listed[:2]
    return [int(ticker[1:]) for ticker in listed]


def test_sort_orders(spark):
    assert order(spark, "bm", bm=[None, 0.2, 0.0, -0.5]) == [1, 3, 0, 2]
    assert order(spark, "op", op=[0.0, None, -0.1]) == [2, 0, 1]
    assert order(spark, "mcap", mcap=[None, 3000.0, 5.0]) == [2, 0, 1]
    assert order(spark, "inv", inv=[None, 0.0, -1.0]) == [2, 1, 0]
    assert order(spark, "beta", beta=[1.0, None, 0.5]) == [2, 0, 1]
    assert order(spark, "rsi", rsi=[10, 90, 90, 50]) == [1, 2, 3, 0]
    assert order(spark, "normal", ci=[None, -1.0, 2.0, 0.0]) == [2, 0, 3, 1]
    assert order(spark, "whatever", ci=[1.0, 3.0, 2.0]) == [1, 2, 0]


def test_numbering_over_many_partitions(spark):
    frame = spark.range(5000).selectExpr(
        "concat('T', id) as ticker", "cast(id % 3 as double) as pct_below_ci",
        "50 as rsi", "id as seq",
    )
    placed = ordering.numbered(frame.repartition(7)).orderBy("pos").toPandas()
    assert list(placed.pos) == list(range(1, 5001))
    wanted = placed.sort_values(["pct_below_ci", "seq"], ascending=[False, True])
    assert list(wanted.seq) == list(placed.seq)


def test_rows_without_ticker_or_rsi_are_not_listed(spark):
    frame = stored(spark, row("A"), row(""), row(None), row("B", rsi=None), row("C", rsi=0))
    assert set(values(ordering.sort_rows(frame))) == {"A", "C"}


def test_screens_and_views(spark):
    good = row("G", beta=0.8, mcap=5.0, bm=0.3, op=0.2, inv=0.05)
    frame = stored(spark, good, row("N"))
    assert set(values(screening.screen_targets(frame))) == {"G"}
    scores = {k: v["n_passed"] for k, v in values(screening.with_target_score(frame)).items()}
    assert scores == {"G": 5, "N": 0}
    report = values(screening.report_view(frame))
    assert report["G"] == {
        "ticker": "G", "pct_below_ci": "1%", "rsi": "50", "beta": "0.80", "mcap": "5.00",
        "bm": "0.300", "op": "20.0%", "inv": "5.0%",
    }
    assert report["N"]["bm"] == "—"
    exported = screening.export_rows(frame).columns
    assert exported == ["Ticker", "% Below 95% CI", "RSI", "BM", "OP", "INV", "BETA", "MCAP"]
    text = values(screening.export_json(frame))["N"]["json"]
    assert '"BM":null' in text and '"% Below 95% CI":1.0' in text


def test_search_list(spark):
    frame = spark.createDataFrame(
        [("A", 1, 10), ("B", 2, 20), ("A", 3, 30)], "ticker STRING, seq BIGINT, rsi INT"
    )
    listed = screening.search_list(frame)
    assert [tuple(r) for r in listed.collect()] == [("A", 3, 30), ("B", 2, 20)]
    assert [r["ticker"] for r in screening.remove_result(listed, "A").collect()] == ["B"]


def test_store_versions(spark, tmp_path):
    store = UniverseStore(spark, str(tmp_path))
    assert store.names().count() == 0
    with pytest.raises(UnknownUniverse):
        store.load("u1")
    rows = stored(spark, row("A"), row("B", seq=1))
    assert store.save(rows, "u1") == 1
    assert store.save(store.load("u1").where("ticker = 'A'"), "u1") == 2
    assert set(values(store.load("u1"))) == {"A"}
    assert store.save(uni.reset(rows), "p_2") == 1
    assert store.load("p_2").isEmpty()
    names = {r["dbname"]: (r["version"], r["is_portfolio"]) for r in store.names().collect()}
    assert names == {"u1": (2, False), "p_2": (1, True)}


def test_store_ignores_an_abandoned_write(spark, tmp_path):
    store = UniverseStore(spark, str(tmp_path))
    store.save(stored(spark, row("A")), "u1")
    torn = tmp_path / "universes" / "dbname=u1" / "version=2"
    stored(spark, row("TORN")).write.parquet(str(torn))
    assert set(values(store.load("u1"))) == {"A"}
    assert store.save(stored(spark, row("B")), "u1") == 2
    assert set(values(store.load("u1"))) == {"B"}


def test_screener_life_cycle(spark, tmp_path):
    table = bars(spark, market(), *CASES.values(), daily("X", walk(11, 100)))
    screener = Screener(spark, str(tmp_path), lambda as_of, days_back: table, params=ScreenParams())
    with pytest.raises(ValueError):
        screener.create("empty", [], AS_OF)
    screener.create("My Watch-List", ["GOOD", "PENNY", "FALL", "NONE", "SPY", "GOOD"], AS_OF)
    assert [r["dbname"] for r in screener.universes().collect()] == ["my_watch_list"]
    name = "my_watch_list"
    first = values(screener.load(name))
    assert set(first) == {"GOOD", "SPY"}
    assert first["GOOD"]["seq"] == SEQ_STRIDE and first["SPY"]["seq"] == SEQ_STRIDE + 4
    assert {r["ticker"] for r in screener.rejects(name).collect()} == {"PENNY", "FALL", "NONE"}
    counts = {r["outcome"]: r["n_tickers"] for r in screener.run_counts(name).collect()}
    assert counts == {"accepted": 2, "penny": 1, "rsi_zero": 1, "no_bars": 1}

    screener.add(name, "FALL", AS_OF)
    screener.add(name, "GOOD", AS_OF)
    assert values(screener.load(name))["FALL"]["rsi"] == 0
    screener.update(name, AS_OF)
    assert set(values(screener.load(name))) == {"GOOD", "SPY"}

    screener.create(name, ["X", "STALE"], AS_OF)
    listed = screener.load(name, "rsi", limit=2)
    assert set(values(screener.load(name))) == {"GOOD", "SPY", "X"} and listed.count() == 2
    screener.remove(name, ["SPY", "UNKNOWN"])
    assert set(values(screener.report(name))) == {"GOOD", "X"}
    assert screener.coverage(name, AS_OF).where("covered").count() == 2
    assert screener.rejects(name).isEmpty()

    found = screener.lookup(" good ", AS_OF).first()
    assert found["status"] == "ok"
    kept = values(screener.load(name))["GOOD"]
    assert all(found[c] == kept[c] for c in SNAPSHOT_COLUMNS)
    screener.reset(name)
    assert screener.load(name).isEmpty() and screener.universes().count() == 1


def test_vacuum_keeps_the_latest(spark, tmp_path):
    store = UniverseStore(spark, str(tmp_path))
    for name in "ABC":
        store.save(stored(spark, row(name)), "u1")
    assert store.vacuum("u1", keep=2) == [1] and store.vacuum("u1", keep=2) == []
    assert set(values(store.load("u1", 2))) == {"B"} and set(values(store.load("u1"))) == {"C"}
    with pytest.raises(ValueError):
        store.vacuum("u1", keep=0)


def test_pages_follow_each_other_by_key(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (f"T{i}", rng.choice([None, 0.0, -0.0, 1.5, 2.0]), rng.choice([0, 30, None, 70]), rng.choice([None, 0.0, 0.2]),
         0.1, rng.choice([None, 0.1, -0.1]), 1.0, rng.choice([None, 3000.0, 5.0]), i * 3)
        for i in range(60)
    ]
    schema = "ticker STRING, pct_below_ci DOUBLE, rsi INT, bm DOUBLE, op DOUBLE, inv DOUBLE, beta DOUBLE, mcap DOUBLE, seq BIGINT"
    table = spark.createDataFrame(rows, schema)
    for choice in ordering.SORT_CHOICES:
        ordering.write_pages(table, f"{tmp_path}/{choice}", choice)
        pages = spark.read.parquet(f"{tmp_path}/{choice}")
        whole = [r.ticker for r in ordering.sort_rows(table, choice).collect()]
        found, after = [], None
        while True:
            page = ordering.page_after(pages, choice, 7, after)
            taken = [r.ticker for r in page.collect()]
            if not taken:
                break
            found += taken
            after = ordering.last_of(page, choice)
        assert found == whole
        assert ordering.last_of(ordering.page_after(pages, choice, 7, after), choice) is None


def test_a_pages_key_reaches_the_files(spark, tmp_path):
    table = spark.range(50).selectExpr(
        "concat('T', id) as ticker", "cast(id as double) as pct_below_ci", "50 as rsi", "0.5D as bm", "0.1D as op",
        "0.1D as inv", "1D as beta", "5D as mcap", "id as seq",
    )
    ordering.write_pages(table, f"{tmp_path}/pages")
    page = ordering.page_after(spark.read.parquet(f"{tmp_path}/pages"), "normal", 5, (-30.0, 30))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key_normal,-30.0)" in plan and "TakeOrderedAndProject" in plan
    assert [r.ticker for r in page.collect()] == [f"T{i}" for i in range(29, 24, -1)]
