"""Bars, ticks, filings and lists derived from the order-processing test tables.

Each view is a lazy DataFrame over the whole tables. Prices are summed as whole numbers, so
that the same closes come out in whatever order rows are added up (see FIXTURES.md).
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.moments import bucket_start
from tickerloom.params import DEFAULTS

AS_OF = datetime(2001, 11, 4)
OLD_AS_OF = datetime(2001, 8, 1)
MARKET = "MKT"
PARAMS = replace(DEFAULTS, market=MARKET)

TABLE_SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_suppkey BIGINT,"
    " l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING,"
    " o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, value DOUBLE",
    "documents": "doc_id BIGINT, text STRING, source STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; known schemas spare the job that would infer them from the files."""
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily bar per supplier and ship date; every tenth supplier is a penny stock."""
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_shipdate")
        .agg(
            F.expr("sum(cast(rint(l_extendedprice * 100) as bigint))").alias("cents"),
            F.count("*").alias("n"),
        )
    )
    factor = "if(l_suppkey % 10 = 7, 0.03D, 1D)"
    level = f"(100 + (cents / n) / 100000D) * {factor}"
    return daily.selectExpr(
        "concat('S', l_suppkey) as ticker",
        "l_shipdate as ts",
        f"cast(rint({level} * 10000) as bigint) / 10000D as close",
    )


def market_bars(
    spark: SparkSession, sf_dir: str, suppliers: DataFrame | None = None
) -> DataFrame:
    """Mean close of all suppliers per day under the market ticker."""
    suppliers = supplier_bars(spark, sf_dir) if suppliers is None else suppliers
    mean = "rint(sum(cast(rint(close * 10000) as bigint)) / count(*)) / 10000D"
    # not a plain literal: a join on a constant key has no key to hash by
    name = f"if(close is null, null, '{MARKET}') as ticker"
    daily = suppliers.groupBy("ts").agg(F.expr(mean).alias("close"))
    return daily.selectExpr(name, "ts", "close")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = supplier_bars(spark, sf_dir)
    return suppliers.unionByName(market_bars(spark, sf_dir, suppliers))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier and the market as a ticker."""
    listed = table(spark, sf_dir, "supplier").selectExpr("concat('S', s_suppkey) as ticker")
    return listed.union(spark.range(1).selectExpr(f"'{MARKET}' as ticker"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('U', user_id) as ticker", "ts", "value as price", "event_id as seq"
    )


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks as an intraday series of closes."""
    return ticks(spark, sf_dir).selectExpr("ticker", "ts", "price as close")


#: After the last tick.
TICKS_END = datetime(2024, 2, 1)


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tick of every hour, and the mean of these under the market ticker."""
    hours = ticks(spark, sf_dir).withColumn("ts", bucket_start(F.col("ts"), "1H"))
    closes = hours.groupBy("ticker", "ts").agg(F.max_by("price", "seq").alias("close"))
    mean = "rint(sum(cast(rint(close * 10000) as bigint)) / count(*)) / 10000D as close"
    market = closes.groupBy("ts").agg(F.expr(mean))
    return closes.unionByName(
        market.selectExpr(f"if(close is null, null, '{MARKET}') as ticker", "ts", "close")
    )


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a tick of its supplier, at the level of the daily bars."""
    factor = "if(l_suppkey % 10 = 7, 0.03D, 1D)"
    level = f"(100 + rint(l_extendedprice * 100) / 100000D) * {factor}"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('S', l_suppkey) as ticker",
        "l_shipdate as ts",
        f"cast(rint({level} * 10000) as bigint) / 10000D as price",
        "l_orderkey * 10 + l_linenumber as seq",
    )


CONCEPT = """
case o_orderpriority
  when '1-URGENT' then 'StockholdersEquity'
  when '2-HIGH' then 'CommonStockSharesOutstanding'
  when '3-MEDIUM' then 'OperatingIncomeLoss'
  when '4-NOT SPECIFIED' then 'Assets'
  else 'StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest' end"""

UNIT = """
if(o_orderpriority <> '2-HIGH' or (o_orderkey % 17 = 0 and o_custkey % 2 = 0),
   'USD', 'shares')"""

FORM = "case o_orderstatus when 'F' then '10-K' when 'O' then '10-K/A' else '10-Q' end"

FILED = "date_format(o_orderdate, 'yyyy-MM-dd')"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings derived from orders, a hundred companies.

    Dollar values and share counts are scaled to give ratios and sizes of every band.
    """
    amount = "o_totalprice * if(o_orderpriority = '2-HIGH', 100D, 10000D)"
    return table(spark, sf_dir, "orders").selectExpr(
        "lpad(cast(o_custkey % 100 as string), 10, '0') as cik",
        "'us-gaap' as taxonomy",
        f"{CONCEPT} as concept",
        f"{UNIT} as unit",
        "o_orderkey as pos",
        "concat(year(o_orderdate), '-12-31') as end",
        f"{FILED} as filed",
        f"{FORM} as form",
        f"""case when o_orderkey % 11 = 0 then 0D
                 when o_orderkey % 13 = 0 then -{amount}
                 else {amount} end as val""",
    )


def filing_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day of every quarter in which anything was filed."""
    day = "date_format(trunc(o_orderdate, 'quarter'), 'yyyy-MM-dd') as as_of"
    return table(spark, sf_dir, "orders").selectExpr(day).distinct()


def company_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company with a day of its own in each year it filed in."""
    return table(spark, sf_dir, "orders").selectExpr(
        "lpad(cast(o_custkey % 100 as string), 10, '0') as cik",
        "date_format(make_date(year(o_orderdate), o_custkey % 100 % 12 + 1, 15), 'yyyy-MM-dd') as as_of",
    ).distinct()


def cik_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under a hundred companies; those with a negative balance have no CIK."""
    registered = table(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    return registered.selectExpr(
        "concat('S', s_suppkey) as ticker",
        "lpad(cast(s_suppkey % 100 as string), 10, '0') as cik",
    )


def fact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per order: a reported value, its amendment, and other concepts."""
    year = "year(o_orderdate)"

    def entry(year_of: str, form: str, value: str) -> str:
        return (
            f"named_struct('end', concat({year_of}, '-12-31'), 'filed', {FILED},"
            f" 'form', {form}, 'val', {value})"
        )

    def body(unit: str, entries: str) -> str:
        return f"named_struct('units', map({unit}, {entries}))"

    reported = (
        f"array({entry(year, FORM, 'o_totalprice')},"
        f" {entry(f'{year} - 1', repr('10-K/A'), '-o_totalprice')})"
    )
    other = f"array({entry(year, repr('8-K'), 'cast(o_custkey as double)')})"
    gaap = (
        f"map({CONCEPT}, {body(UNIT, reported)},"
        f" 'Liabilities', {body(repr('USD'), other)})"
    )
    dei = f"map('EntityPublicFloat', {body(repr('pure'), other)})"
    document = (
        f"named_struct('cik', o_custkey, 'facts', map('us-gaap', {gaap}, 'dei', {dei}))"
    )
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as doc", f"to_json({document}) as json"
    )


def damaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings with some cut short, emptied, without facts or without a number."""
    return fact_documents(spark, sf_dir).selectExpr(
        "doc",
        """case doc % 10 when 3 then left(json, 60) when 4 then null
           when 5 then '{"cik": 5}' when 6 then regexp_replace(json, '"cik":[0-9]+,', '')
           else json end as json""",
    )


def cik_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per supplier: its own ticker, and one its nation shares."""
    own = "named_struct('cik_str', s_suppkey, 'ticker', concat('s', s_suppkey))"
    shared = "named_struct('cik_str', s_suppkey * 7, 'ticker', concat('n', s_nationkey))"
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as doc", f"to_json(map('0', {own}, '1', {shared})) as json"
    )


def ticker_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every document, read as a ticker list."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("list"), F.col("text").alias("content")
    )


def ticker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document line by line."""
    lines = F.posexplode(F.split("content", "\n")).alias("line_no", "line")
    return ticker_texts(spark, sf_dir).select("list", lines)


def rsi_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every order: the RSI of one of ten suppliers on the day."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('S', o_custkey % 10 + 1) as ticker", "o_orderdate as ts"
    )


def first_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars as first loaded: those of every fifth supplier are late from autumn 2001 on."""
    late = "ts >= timestamp_ntz'2001-09-01' and try_cast(substring(ticker, 2) as bigint) % 5 = 0"
    return bars(spark, sf_dir).where(f"not coalesce({late}, false)").withColumn("freq", F.lit("day"))


def bar_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late bars, two corrections for some, and bars withdrawn later."""
    number = "try_cast(substring(ticker, 2) as bigint)"
    given = bars(spark, sf_dir).withColumn("freq", F.lit("day"))

    def load(at: int, where: str, close: str) -> DataFrame:
        rows = given.where(where)
        return rows.selectExpr("ticker", "freq", "ts", f"cast({close} as double) as close", f"{at} as load")

    loads = [
        load(2, f"ts >= timestamp_ntz'2001-09-01' and {number} % 5 = 0", "close"),
        load(4, f"ts >= timestamp_ntz'2001-06-01' and {number} % 3 = 0", "close + 2"),
        load(3, f"ts >= timestamp_ntz'2001-06-01' and {number} % 3 = 0", "close + 1"),
        load(5, f"ts >= timestamp_ntz'2001-10-01' and {number} % 4 = 0", "null"),
    ]
    return reduce(DataFrame.unionByName, loads)


def with_insertion_order(rows: DataFrame) -> DataFrame:
    """Number stored rows by supplier; the market comes first."""
    number = F.expr("coalesce(try_cast(substring(ticker, 2) as bigint), -1)")
    return rows.withColumn("seq", number)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticker list with every supplier twice; low balances under an unknown ticker."""
    known = F.col("s_acctbal") >= 4000
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.when(known, "S").otherwise("X"), "s_suppkey").alias("ticker"),
        F.explode(
            F.array(F.col("s_suppkey") * 2 + 1, F.col("s_suppkey") * 2)
        ).alias("ordinal"),
    )
