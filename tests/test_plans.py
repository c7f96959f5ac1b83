"""Shapes of physical plans: shuffles, pushed filters, what is broadcast, no Python."""

import re

import pytest
from builders import AS_OF, BAR, FACT
from pyspark.sql import functions as F

from tickerloom.functions.moments import moment_literal
from tickerloom.operators import accounting, evaluate as ev, indicators, resample
from tickerloom.plans.queries import QUERIES
from tickerloom.sources.bars import write_bucketed_bars


def plan_of(frame, spark):
    """Initial physical plan, without adaptive changes or size-based broadcasts."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def tables(spark, tmp_path):
    paths = {}
    for name, schema in (("bars", BAR), ("facts", FACT), ("ticks", BAR + ", seq BIGINT")):
        paths[name] = str(tmp_path / name)
        spark.createDataFrame([], schema).coalesce(1).write.parquet(paths[name])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield {name: spark.read.parquet(path) for name, path in paths.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_measures_shuffle_bars_once(spark, tables):
    plan = plan_of(ev._measures(tables["bars"], tables["bars"], AS_OF, ev.DEFAULTS), spark)
    # bars by ticker; the other two are inside the broadcast market branch
    main, broadcast_branch = plan.split("BroadcastExchange")
    assert len(exchanges(main)) == 1 and len(exchanges(broadcast_branch)) == 2
    assert len(re.findall(r"\bSort \[ticker", main)) == 1
    assert "SortMergeJoin" not in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "EqualTo(ticker,SPY)" in plan


def test_evaluation_adds_no_shuffle_of_bars(spark, tables):
    universe = tables["bars"].select("ticker")
    frame = ev.evaluate(
        tables["bars"], AS_OF, universe=universe, price_bars=tables["bars"]
    )
    plan = plan_of(frame, spark)
    # universe, bars and prices by ticker, and the market branch; the universe is reused
    main, broadcast_branch = plan.split("BroadcastExchange")
    assert len(exchanges(broadcast_branch)) <= 3
    assert len(exchanges(main)) <= 4
    assert plan.count("BroadcastExchange") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_resample_is_one_hash_aggregate(spark, tables):
    plan = plan_of(resample.resample(tables["ticks"], "1Min", price="close"), spark)
    assert len(exchanges(plan)) == 1 and "partial_max_by" in plan
    assert "SortAggregate" not in plan


def test_latest_price_pushes_the_window(spark, tables):
    plan = plan_of(resample.latest_price(tables["bars"], AS_OF), spark)
    assert "LessThanOrEqual(ts," in plan and "partial_max_by" in plan
    assert len(exchanges(plan)) == 1


def test_slices_are_cut_to_their_last_bars_before_the_shuffle(spark, tables):
    plan = plan_of(indicators.rsi_series(tables["bars"], slice_every="1 day"), spark)
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits) and any("Final" in line for line in limits)
    partial = next(i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line and "Partial" in line)
    final = next(i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line and "Final" in line)
    # the partial limit stands below the exchange that the final one reads from
    assert any("Exchange" in line for line in plan.splitlines()[final:partial])
    # lists are windows over one row a slice, and none is an aggregate that gathers bars
    lists = [line for line in plan.splitlines() if "collect_list" in line]
    assert all("Window [collect_list(_w0" in line for line in lists) and "close#" not in "".join(lists)


def test_company_values_scan_facts_once(spark, tables):
    plan = plan_of(accounting.company_values(tables["facts"]), spark)
    assert plan.count("FileScan") == 1 and "partial_max_by" in plan.split("Exchange")[-1]
    assert "In(form, [10-K,10-K/A])" in plan and "EqualTo(taxonomy,us-gaap)" in plan
    assert len(exchanges(plan)) == 2


def test_columns_are_pruned(spark, tables):
    wide = tables["ticks"].where(tables["ticks"]["ts"] <= moment_literal(AS_OF))
    plan = plan_of(indicators.changes(wide).select("ticker", "chg"), spark)
    assert "ReadSchema: struct<ticker:string,ts:timestamp_ntz,close:double>" in plan


def test_facts_join_on_the_ticker_and_only_those_asked_for(spark, tables):
    universe = tables["bars"].select("ticker")
    cik_map = tables["facts"].select(F.col("concept").alias("ticker"), "cik")
    frame = ev.evaluate(
        tables["bars"], AS_OF, facts=tables["facts"], cik_map=cik_map, universe=universe
    )
    plan = plan_of(frame, spark)
    main = plan.split("BroadcastExchange")[0]
    # the bars are dealt by ticker once, and nothing deals the evaluation by another spelling
    assert not any("upper(ticker" in keys for keys in exchanges(main))
    assert "LeftSemi" in main and plan.count("BroadcastExchange") == 1


def test_slices_have_no_window_over_a_tickers_bars(spark, tables):
    plan = plan_of(indicators.rsi_series(tables["bars"], slice_every="1 day"), spark)
    over_ticker = [line for line in plan.splitlines() if re.search(r"Window \[.*\], \[ticker#\d+\]", line)]
    # those there are run over one row a slice
    assert all("close#" not in line for line in over_ticker)


def test_small_reductions_hash(spark, sf_dir):
    for name in ("unit_preference", "search_list", "latest_price"):
        assert "SortAggregate" not in plan_of(QUERIES[name](spark, sf_dir), spark)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_runs_python_or_pairs_everything(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir), spark)
    for operator in ("Python", "Pandas", "CartesianProduct", "NestedLoopJoin"):
        assert operator not in plan


def test_bucketed_bars_are_not_shuffled(spark, tables):
    name = "bucketed_bars_of_a_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    write_bucketed_bars(tables["bars"], name, 4)
    try:
        bars = spark.table(name)
        universe = bars.select("ticker").distinct()
        frame = ev.evaluate(bars, AS_OF, universe=universe, market_bars=tables["bars"], complete=False)
        plan = plan_of(frame, spark)
        assert "Bucketed: true" in plan
        main = plan.split("BroadcastExchange")[0]
        assert not exchanges(main)
        assert not [line for line in plan_of(indicators.rsi_series(bars), spark).splitlines() if "Exchange" in line]
    finally:
        spark.sql(f"DROP TABLE {name}")
