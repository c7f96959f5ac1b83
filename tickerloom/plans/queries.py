"""Named queries: each operator applied to the whole test tables.

Every entry takes ``(spark, sf_dir)``. Doubles that are sums in no fixed order are rounded
half to even at nine decimals, to be comparable.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.moments import delayed_as_of, moment_literal
from tickerloom.functions.numeric import half_even
from tickerloom.functions.text import (
    is_portfolio,
    normalize_ticker,
    normalize_universe_name,
    pad_cik,
)
from tickerloom.operators import (
    accounting,
    daily,
    evaluate as ev,
    history,
    incremental,
    indicators,
    ordering,
    resample as rs,
    screening,
    universe as uni,
)
from tickerloom.operators.checkpoints import checkpointed
from tickerloom.plans import views
from tickerloom.plans.views import AS_OF, OLD_AS_OF, PARAMS
from tickerloom.schemas import METRIC_COLUMNS
from tickerloom.sources import bars as bar_source, filings, lists
from tickerloom.sources.universes import UniverseStore

Query = Callable[[SparkSession, str], DataFrame]

RSI_DATE = datetime(2001, 10, 15)
#: Moments of the snapshots over time.
HISTORY = [datetime(1997, 3, 31), datetime(1998, 9, 1), datetime(2000, 6, 30), AS_OF]
SEQ_BASE = 1 << 32
TOP_K = 25
#: Rows of a page, and buckets of the bucketed bars.
PAGE = 3
BUCKETS = 8


def r9(value: Column | str) -> Column:
    return half_even(F.col(value) if isinstance(value, str) else value, 9)


# --- sources -----------------------------------------------------------------------


def bars_scan(spark, sf_dir):
    scanned = bar_source.scan_bars(
        views.bars(spark, sf_dir), AS_OF, 90, tickers=views.universe(spark, sf_dir)
    )
    return scanned.select("ticker", "ts", "close")


def bars_delayed(spark, sf_dir):
    """What a run at ten past the last bar may read of a feed that is twenty minutes late."""
    as_of = delayed_as_of(AS_OF + timedelta(minutes=10))
    return bar_source.scan_bars(views.bars(spark, sf_dir), as_of, 5).select("ticker", "ts", "close")


def bar_keys(spark, sf_dir):
    """Rows per bar key of the raw lines: the keys a raw load would have to merge."""
    raw = views.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.col("l_shipdate").alias("ts")
    )
    return bar_source.bar_key_violations(raw)


def bars_resample(frequency):
    def query(spark, sf_dir):
        return rs.resample(views.ticks(spark, sf_dir), frequency)

    return query


def bars_resample_nan(spark, sf_dir):
    """Day bars of ticks of which every seventh has NaN for a price."""
    price = F.expr("if(seq % 7 = 0, double('NaN'), price)")
    return rs.resample(views.ticks(spark, sf_dir).withColumn("price", price), "1D")


def bars_resample_ties(spark, sf_dir):
    """Hour bars of order prices by status, where many prices share one instant."""
    prices = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("ticker"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.rint(F.col("o_totalprice") * 100).cast("bigint").alias("volume"),
        F.col("o_orderkey").alias("seq"),
    )
    return rs.resample(prices, "1H", volume="volume", tie_breaker="seq")


def latest_price(spark, sf_dir):
    return rs.latest_price(views.bars(spark, sf_dir), AS_OF)


def price_widening(spark, sf_dir):
    """Current prices with the window each was found in."""
    return rs.widening_price(views.bars(spark, sf_dir), AS_OF, views.universe(spark, sf_dir))


def bars_merge(spark, sf_dir):
    """Bars stored by month, after late, corrected and withdrawn ones came in."""
    path = f"{_folder(spark, 'merge')}/bars"
    bar_source.write_bars(views.first_load(spark, sf_dir), path)
    bar_source.merge_bars(spark, path, views.bar_changes(spark, sf_dir))
    return bar_source.read_bars(spark, path)


def list_lines(spark, sf_dir):
    """As ``parse_tickers``, from the lines of the lists."""
    return lists.parse_lines(views.ticker_lines(spark, sf_dir))


def parse_tickers(spark, sf_dir):
    return lists.parse_tickers(views.ticker_texts(spark, sf_dir))


def list_overview(spark, sf_dir):
    return lists.list_overview(views.ticker_texts(spark, sf_dir))


def cik_dim(spark, sf_dir):
    return filings.cik_dimension(views.cik_documents(spark, sf_dir))


def facts_flatten(spark, sf_dir):
    return filings.flatten_facts(views.fact_documents(spark, sf_dir), keep=("doc",))


def facts_variant(spark, sf_dir):
    """The same facts by way of VARIANT."""
    found = filings.facts_and_faults(views.fact_documents(spark, sf_dir))
    return found.where("pos is not null").drop("reason")


def faults_variant(spark, sf_dir):
    """The documents without facts, from the parse that gives the facts of the others."""
    found = filings.facts_and_faults(views.damaged_documents(spark, sf_dir))
    return found.where("reason is not null").select("doc", "reason").distinct()


def facts_unparsed(spark, sf_dir):
    """Filings cut short, emptied or without facts for some orders."""
    return filings.unparsed_documents(views.damaged_documents(spark, sf_dir))


def facts_named(spark, sf_dir):
    """As ``facts_flatten``, with only the concepts of the screen parsed."""
    return filings.flatten_facts(
        views.fact_documents(spark, sf_dir),
        taxonomy=accounting.TAXONOMY,
        concepts=accounting.ACCOUNTING_CONCEPTS,
        keep=("doc",),
    ).drop("cik")


def list_names(spark, sf_dir):
    """Every source of documents as the name of a list."""
    sources = views.table(spark, sf_dir, "documents").selectExpr("source as list")
    return lists.list_names(sources)


def names_normalized(spark, sf_dir):
    """Ticker, universe name, portfolio flag and padded number of every supplier."""
    return views.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        normalize_ticker(F.concat(F.lit(" "), F.lower("s_name"), F.lit(" "))).alias("ticker"),
        normalize_universe_name(F.col("s_name")).alias("universe"),
        is_portfolio(
            F.concat(
                F.when(F.col("s_acctbal") < 2000, "p_")
                .when(F.col("s_acctbal") < 5000, "portfolio")
                .otherwise("px_"),
                "s_suppkey",
            )
        ).alias("is_portfolio"),
        pad_cik(F.col("s_suppkey")).alias("cik"),
    )


# --- series ------------------------------------------------------------------------


def close_diff(spark, sf_dir):
    return indicators.changes(views.bars(spark, sf_dir)).select(
        "ticker", "ts", r9("chg").alias("chg")
    )


def simple_returns(spark, sf_dir):
    return indicators.simple_returns(views.bars(spark, sf_dir)).select(
        "ticker", "ts", r9("ret").alias("ret")
    )


def gain_loss(spark, sf_dir):
    return indicators.gain_loss(views.bars(spark, sf_dir)).select(
        "ticker", "ts", r9("gain").alias("gain"), r9("loss").alias("loss")
    )


def sma_14(spark, sf_dir):
    return indicators.moving_average(views.bars(spark, sf_dir), 14, "sma_14").select(
        "ticker", "ts", r9("sma_14").alias("sma_14")
    )


def rsi_series(spark, sf_dir):
    return indicators.rsi_series(views.bars(spark, sf_dir)).select(
        "ticker", "ts", r9("rsi").alias("rsi")
    )


def rsi_series_intraday(spark, sf_dir):
    """RSI over ticks, computed in slices of three days."""
    return indicators.rsi_series(
        views.tick_bars(spark, sf_dir), slice_every="3 days"
    ).select("ticker", "ts", r9("rsi").alias("rsi"))


def sma_intraday(spark, sf_dir):
    return indicators.moving_average(
        views.tick_bars(spark, sf_dir), 20, "sma_20", slice_every="3 days"
    ).select("ticker", "ts", r9("sma_20").alias("sma_20"))


def rsi_latest(spark, sf_dir):
    return daily.rsi_latest(views.bars(spark, sf_dir), AS_OF)


def rsi_at_date(spark, sf_dir):
    return indicators.rsi_at(views.bars(spark, sf_dir), RSI_DATE, AS_OF)


def rsi_at_requests(spark, sf_dir):
    return indicators.rsi_at_requests(views.bars(spark, sf_dir), views.rsi_requests(spark, sf_dir))


def ma_cross(spark, sf_dir):
    signals = indicators.moving_average_signals(views.bars(spark, sf_dir))
    return signals.select(
        "ticker",
        "ts",
        *[r9(f"sma_{n}").alias(f"sma_{n}") for n in (20, 50, 200)],
        *[F.col(f"above_{n}").cast("string").alias(f"above_{n}") for n in (20, 50, 200)],
        "cross",
    )


def rsi_accuracy(spark, sf_dir):
    return indicators.rsi_accuracy(views.bars(spark, sf_dir)).select(
        "ticker", "n_signals", r9("accuracy").alias("accuracy")
    )


def rsi_turnover(spark, sf_dir):
    return indicators.rsi_turnover(views.bars(spark, sf_dir))


# --- daily measures ----------------------------------------------------------------


def ci_distance(spark, sf_dir):
    return daily.price_band(views.bars(spark, sf_dir), AS_OF, params=PARAMS).select(
        "ticker",
        "band_bars",
        r9("mean_close").alias("mean_close"),
        r9("std_close").alias("std_close"),
        r9("lower_band").alias("lower_band"),
        "price",
        "pct_below_ci",
    )


def penny_filter(spark, sf_dir):
    return daily.penny_filter(views.bars(spark, sf_dir), AS_OF, PARAMS)


def _betas(spark, sf_dir):
    suppliers = views.supplier_bars(spark, sf_dir)
    market = views.market_bars(spark, sf_dir, suppliers)
    return daily.market_beta(
        suppliers.unionByName(market), AS_OF, PARAMS, market_bars=market
    )


def beta(spark, sf_dir):
    return _betas(spark, sf_dir).select("ticker", "beta")


def beta_intraday(spark, sf_dir):
    """Ticks of every hour as bars, against the mean tick of each instant as the market."""
    return daily.intraday_beta(
        views.hour_bars(spark, sf_dir), views.TICKS_END, "30 days", PARAMS
    ).select("ticker", "n_common", "beta")


def return_overlap(spark, sf_dir):
    return _betas(spark, sf_dir).select("ticker", "n_common")


# --- filings -----------------------------------------------------------------------


def facts_dedup(spark, sf_dir):
    return accounting.latest_filings(accounting.annual_facts(views.facts(spark, sf_dir)))


def latest_annual(spark, sf_dir):
    return accounting.latest_annual(accounting.annual_facts(views.facts(spark, sf_dir)))


def unit_preference(spark, sf_dir):
    return accounting.preferred_unit(accounting.annual_facts(views.facts(spark, sf_dir)))


def two_annual(spark, sf_dir):
    return accounting.two_latest_annual(accounting.annual_facts(views.facts(spark, sf_dir)))


def concept_fallback(spark, sf_dir):
    return accounting.company_values(views.facts(spark, sf_dir))


def filing_intervals(spark, sf_dir):
    annual = accounting.annual_facts(views.facts(spark, sf_dir))
    return history.filing_intervals(annual)


def facts_as_of(spark, sf_dir):
    """The filings known at the start of every quarter."""
    annual = accounting.annual_facts(views.facts(spark, sf_dir))
    return history.facts_as_of(history.filing_intervals(annual), views.filing_quarters(spark, sf_dir))


def company_values_as_of(spark, sf_dir):
    """Company values on days that each company asks for itself."""
    return history.company_values_as_of(views.facts(spark, sf_dir), views.company_years(spark, sf_dir))


def _factors(spark, sf_dir):
    return accounting.factor_record(
        _betas(spark, sf_dir),
        rs.latest_price(views.bars(spark, sf_dir), AS_OF),
        views.facts(spark, sf_dir),
        views.cik_map(spark, sf_dir),
    )


def ratio(name, needs_price):
    def query(spark, sf_dir):
        values = accounting.values_by_ticker(
            views.facts(spark, sf_dir), views.cik_map(spark, sf_dir)
        )
        if needs_price:
            prices = rs.latest_price(views.bars(spark, sf_dir), AS_OF)
            values = values.join(prices, "ticker", "left")
        else:
            values = values.withColumn("price", F.lit(None).cast("double"))
        return values.select("ticker", accounting.factor_columns()[name].alias(name))

    return query


# --- evaluation --------------------------------------------------------------------


def evaluated(spark, sf_dir, as_of=AS_OF, universe=None, price_bars=None, complete=True):
    """The evaluation of a universe, by default of all suppliers and the market."""
    suppliers = views.supplier_bars(spark, sf_dir)
    market = views.market_bars(spark, sf_dir, suppliers)
    return ev.evaluate(
        suppliers.unionByName(market),
        as_of,
        facts=views.facts(spark, sf_dir),
        cik_map=views.cik_map(spark, sf_dir),
        universe=views.universe(spark, sf_dir) if universe is None else universe,
        price_bars=price_bars,
        market_bars=market,
        params=PARAMS,
        complete=complete,
    )


def snapshot(spark, sf_dir):
    return ev.snapshot(evaluated(spark, sf_dir))


def snapshot_minute_price(spark, sf_dir):
    """The snapshot with current prices from minute bars of the raw lines."""
    lines = views.line_ticks(spark, sf_dir)
    minutes = rs.resample(lines, "1Min", tie_breaker="seq")
    return ev.snapshot(evaluated(spark, sf_dir, price_bars=minutes))


def snapshot_as_of(spark, sf_dir):
    """Snapshots at four moments, three of them before the last filings came in."""
    return history.snapshots_as_of(lambda moment: evaluated(spark, sf_dir, moment), HISTORY)


def snapshot_rejects(spark, sf_dir):
    return ev.rejects(evaluated(spark, sf_dir))


def run_counts(spark, sf_dir):
    return ev.run_counts(evaluated(spark, sf_dir))


def run_counts_written(spark, sf_dir):
    """Counts gathered while the evaluation was stored."""
    counts = ev.write_counted(evaluated(spark, sf_dir), f"{_folder(spark, 'evaluated')}/rows")
    rows = F.array(*(F.struct(F.lit(name).alias("outcome"), F.lit(n).cast("bigint").alias("n_tickers")) for name, n in counts.items()))
    return spark.range(1).select(F.explode(rows).alias("row")).select("row.*")


def snapshot_bucketed(spark, sf_dir):
    """The snapshot from a table of bars bucketed by ticker."""
    suppliers = views.supplier_bars(spark, sf_dir)
    market = views.market_bars(spark, sf_dir, suppliers)
    name = f"bars_{uuid4().hex}"
    bar_source.write_bucketed_bars(suppliers.unionByName(market), name, BUCKETS)
    return ev.snapshot(
        ev.evaluate(
            spark.table(name), AS_OF, facts=views.facts(spark, sf_dir), cik_map=views.cik_map(spark, sf_dir),
            universe=views.universe(spark, sf_dir), params=PARAMS,
        )
    )


def ticker_lookup(spark, sf_dir):
    """A request per supplier, typed in lower case with blanks, and unknown tickers."""
    typed = views.listing(spark, sf_dir).select(
        F.concat(F.lit(" "), F.lower("ticker")).alias("typed")
    )
    requests = typed.select(normalize_ticker(F.col("typed")).alias("ticker"))
    answers = ev.lookup(evaluated(spark, sf_dir, universe=requests))
    return answers.withColumn("rsi", F.col("rsi").cast("double"))


def coverage_report(spark, sf_dir):
    return ev.coverage(views.universe(spark, sf_dir), views.bars(spark, sf_dir), AS_OF)


def coverage_counts(spark, sf_dir):
    return ev.coverage_counts(coverage_report(spark, sf_dir))


# --- listings ----------------------------------------------------------------------


def stored_rows(spark, sf_dir):
    """The snapshot as a stored universe."""
    return views.with_insertion_order(snapshot(spark, sf_dir))


def sort_query(choice):
    def query(spark, sf_dir):
        placed = ordering.numbered(stored_rows(spark, sf_dir), choice)
        key, _ = ordering.sort_key(choice)
        return placed.select("ticker", key.alias("sort_key"), "seq", "pos")

    return query


def pages_by_key(spark, sf_dir):
    """The third page of every order, each found by the last row of the page before."""
    root = _folder(spark, "pages")
    rows = stored_rows(spark, sf_dir)
    taken = []
    for choice in ordering.SORT_CHOICES:
        path = f"{root}/{choice}"
        ordering.write_pages(rows if not taken else spark.read.parquet(f"{root}/normal"), path, choice)
        pages = spark.read.parquet(path)
        after = None
        for _ in range(2):
            after = ordering.last_of(ordering.page_after(pages, choice, PAGE, after), choice) or after
        page = ordering.page_after(pages, choice, PAGE, after)
        taken.append(page.select(F.lit(choice).alias("choice"), "ticker", "seq"))
    return reduce(DataFrame.unionByName, taken)


def topk_ci(spark, sf_dir):
    return ordering.top_rows(stored_rows(spark, sf_dir), TOP_K)


def screen_targets(spark, sf_dir):
    """Rows within every target range."""
    return screening.screen_targets(snapshot(spark, sf_dir))


def screen_value(spark, sf_dir):
    """Rows within the size, value and profitability ranges."""
    return screening.screen_targets(snapshot(spark, sf_dir), ["mcap", "bm", "op"])


def target_score(spark, sf_dir):
    return screening.with_target_score(snapshot(spark, sf_dir)).drop(*METRIC_COLUMNS)


def factor_bands(spark, sf_dir):
    return screening.with_factor_bands(snapshot(spark, sf_dir)).drop(*METRIC_COLUMNS)


def report_view(spark, sf_dir):
    return screening.report_view(snapshot(spark, sf_dir))


def export_json(spark, sf_dir):
    return screening.export_json(snapshot(spark, sf_dir))


def search_list(spark, sf_dir):
    """Every event as a search; the newest per ticker remains."""
    results = views.ticks(spark, sf_dir).select("ticker", "seq", "ts", "price")
    return screening.search_list(results)


def search_remove(spark, sf_dir):
    """The search list without one of its tickers."""
    return screening.remove_result(search_list(spark, sf_dir), "U1")


# --- universes ---------------------------------------------------------------------


def earlier_universe(spark, sf_dir):
    """The universe at an earlier time, as it would be stored."""
    rows = ev.snapshot(evaluated(spark, sf_dir, OLD_AS_OF))
    return views.with_insertion_order(rows).withColumn("as_of", moment_literal(OLD_AS_OF))


def old_universe(spark, sf_dir):
    """``earlier_universe``, checkpointed like a stored table: plans read it several times."""
    return checkpointed(earlier_universe(spark, sf_dir))


def universe_create(spark, sf_dir):
    stored = old_universe(spark, sf_dir)
    listing = views.listing(spark, sf_dir)
    wanted = uni.tickers_to_evaluate(stored, listing)
    fresh = evaluated(spark, sf_dir, universe=wanted, complete=False)
    return uni.create(stored, listing, fresh, AS_OF, SEQ_BASE)


def universe_refresh(spark, sf_dir):
    stored = old_universe(spark, sf_dir)
    fresh = evaluated(spark, sf_dir, universe=stored, complete=False)
    return uni.refresh(stored, fresh, AS_OF)


def refresh_incremental(spark, sf_dir):
    """The refresh from summaries of the months before, and bars of the others.

    Bars and summaries are stored as a run at the earlier time would have left them.
    """
    stored = old_universe(spark, sf_dir)
    root = _folder(spark, "refresh")
    bar_source.write_bars(views.bars(spark, sf_dir).withColumn("freq", F.lit("day")), f"{root}/bars")

    def read(months):
        return bar_source.read_months(spark, f"{root}/bars", months, "day")

    last = incremental.month_of(OLD_AS_OF - timedelta(days=1))
    past, _ = incremental.lookback_months(AS_OF, last, PARAMS)
    summaries = incremental.SummaryStore(spark, f"{root}/summaries")
    earlier = read(past)
    summaries.write(incremental.month_summaries(earlier, earlier, PARAMS))
    measured = incremental.measures_from_summaries(
        summaries.read(past), read, last, AS_OF, PARAMS, universe=stored
    )
    facts, cik_map = views.facts(spark, sf_dir), views.cik_map(spark, sf_dir)
    fresh = ev.from_measures(measured, AS_OF, facts, cik_map, stored, PARAMS, complete=False)
    return uni.refresh(stored, fresh, AS_OF)


def universe_add(spark, sf_dir):
    stored = old_universe(spark, sf_dir)
    candidates = views.listing(spark, sf_dir)
    fresh = evaluated(spark, sf_dir, universe=candidates, complete=False)
    return uni.add(stored, candidates, fresh, AS_OF, SEQ_BASE)


def universe_remove(spark, sf_dir):
    return uni.remove(earlier_universe(spark, sf_dir), views.listing(spark, sf_dir))


def _folder(spark, name):
    """A folder of its own below the session's warehouse, which a cluster shares."""
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{root}/{name}-{uuid4().hex}"


def _store(spark):
    """A universe store of its own."""
    return UniverseStore(spark, _folder(spark, "universe-store"))


def store_round_trip(spark, sf_dir):
    """The earlier universe saved, listed, replaced and loaded again."""
    store = _store(spark)
    store.save(earlier_universe(spark, sf_dir), "round_trip")
    loaded = store.load("round_trip")
    version = store.save(uni.remove(loaded, views.listing(spark, sf_dir)), "round_trip")
    return store.load("round_trip").withColumn("version", F.lit(version).cast("bigint"))


def store_reset(spark, sf_dir):
    """How many rows a universe has before and after it is emptied, and its versions."""
    store = _store(spark)
    store.save(earlier_universe(spark, sf_dir), "p_reset")
    before = store.load("p_reset")
    store.save(uni.reset(before), "p_reset")

    def counted(rows, stage):
        return rows.agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "n")

    after = store.load("p_reset")
    names = store.names().select("dbname", F.col("version"))
    return counted(before, "before").union(counted(after, "after")).union(names)


def flagship(spark, sf_dir):
    """The snapshot with factor bands, in the default order."""
    rows = ordering.sort_rows(stored_rows(spark, sf_dir))
    return screening.with_factor_bands(rows)


QUERIES: dict[str, Query] = {
    "bars_scan": bars_scan,
    "bars_delayed": bars_delayed,
    "bar_keys": bar_keys,
    "bars_resample_day": bars_resample("daily"),
    "bars_resample_hour": bars_resample("1H"),
    "bars_resample_minute": bars_resample("1Min"),
    "bars_resample_ties": bars_resample_ties,
    "bars_resample_nan": bars_resample_nan,
    "latest_price": latest_price,
    "price_widening": price_widening,
    "bars_merge": bars_merge,
    "list_lines": list_lines,
    "parse_tickers": parse_tickers,
    "list_overview": list_overview,
    "list_names": list_names,
    "cik_dim": cik_dim,
    "facts_flatten": facts_flatten,
    "facts_named": facts_named,
    "facts_variant": facts_variant,
    "faults_variant": faults_variant,
    "facts_unparsed": facts_unparsed,
    "names_normalized": names_normalized,
    "close_diff": close_diff,
    "simple_returns": simple_returns,
    "gain_loss": gain_loss,
    "sma_14": sma_14,
    "sma_intraday": sma_intraday,
    "rsi_series": rsi_series,
    "rsi_series_intraday": rsi_series_intraday,
    "rsi_latest": rsi_latest,
    "rsi_at_date": rsi_at_date,
    "rsi_at_requests": rsi_at_requests,
    "ma_cross": ma_cross,
    "rsi_accuracy": rsi_accuracy,
    "rsi_turnover": rsi_turnover,
    "ci_distance": ci_distance,
    "penny_filter": penny_filter,
    "beta": beta,
    "beta_intraday": beta_intraday,
    "return_overlap": return_overlap,
    "facts_dedup": facts_dedup,
    "latest_annual": latest_annual,
    "unit_preference": unit_preference,
    "two_annual": two_annual,
    "concept_fallback": concept_fallback,
    "filing_intervals": filing_intervals,
    "facts_as_of": facts_as_of,
    "company_values_as_of": company_values_as_of,
    "ratio_bm": ratio("bm", True),
    "ratio_mcap": ratio("mcap", True),
    "ratio_op": ratio("op", False),
    "ratio_inv": ratio("inv", False),
    "factor_record": _factors,
    "snapshot": snapshot,
    "snapshot_minute_price": snapshot_minute_price,
    "snapshot_as_of": snapshot_as_of,
    "snapshot_rejects": snapshot_rejects,
    "run_counts": run_counts,
    "run_counts_written": run_counts_written,
    "snapshot_bucketed": snapshot_bucketed,
    "ticker_lookup": ticker_lookup,
    "coverage_report": coverage_report,
    "coverage_counts": coverage_counts,
    "sort_ci": sort_query("normal"),
    "sort_rsi": sort_query("rsi"),
    "sort_bm": sort_query("bm"),
    "sort_op": sort_query("op"),
    "sort_inv": sort_query("inv"),
    "sort_beta": sort_query("beta"),
    "sort_mcap": sort_query("mcap"),
    "pages_by_key": pages_by_key,
    "topk_ci": topk_ci,
    "screen_targets": screen_targets,
    "screen_value": screen_value,
    "target_score": target_score,
    "factor_bands": factor_bands,
    "report_view": report_view,
    "export_json": export_json,
    "search_list": search_list,
    "search_remove": search_remove,
    "universe_create": universe_create,
    "universe_refresh": universe_refresh,
    "refresh_incremental": refresh_incremental,
    "universe_add": universe_add,
    "universe_remove": universe_remove,
    "store_round_trip": store_round_trip,
    "store_reset": store_reset,
}
