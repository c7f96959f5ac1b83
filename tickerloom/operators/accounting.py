"""Annual values and factor ratios from the long facts table.

Facts are ``(cik, taxonomy, concept, unit, pos, end, filed, form, val)``. Periods and
filing dates are ISO texts and compare as such. Every reduction is an aggregate with
map-side partials, so a company or concept with a large share of the rows shrinks before it
is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.moments import naive_utc
from tickerloom.functions.numeric import null_if_zero, safe_round

# Form types of annual reports, units in order of preference, and the
# reported concepts each measure is read from, in order of preference.
ANNUAL_FORMS = ["10-K", "10-K/A"]
UNIT_PREFERENCE = ["USD", "shares", "pure"]
TAXONOMY = "us-gaap"
EQUITY = [
    "StockholdersEquity",
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
]
SHARES = [
    "CommonStockSharesOutstanding",
    "CommonStockSharesOutstandingIncludingTreasuryShares",
]
OPERATING_INCOME = [
    "OperatingIncomeLoss",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
]
ASSETS = "Assets"
ACCOUNTING_CONCEPTS = [*EQUITY, *SHARES, *OPERATING_INCOME, ASSETS]

PERIOD_KEY = ["cik", "taxonomy", "concept", "unit", "end"]


def annual_facts(facts: DataFrame, concepts: Sequence[str] | None = None) -> DataFrame:
    """Values from annual reports, in one of the accepted units, with a period."""
    annual = facts.where(
        F.col("form").isin(ANNUAL_FORMS)
        & F.col("unit").isin(UNIT_PREFERENCE)
        & F.col("end").isNotNull()
    )
    if concepts is not None:
        annual = annual.where(
            (F.col("taxonomy") == TAXONOMY) & F.col("concept").isin(list(concepts))
        )
    return annual


def filed_by(facts: DataFrame, as_of: datetime) -> DataFrame:
    """Values whose filing was in by the day of ``as_of``; those without a date always were."""
    day = f"{naive_utc(as_of):%Y-%m-%d}"
    return facts.where(F.col("filed").isNull() | (F.col("filed") <= day))


def _filing_order() -> Column:
    """Later filings win; among equal dates the first value of the document."""
    return F.struct(F.coalesce("filed", F.lit("")), -F.col("pos"))


def unit_rank(unit: Column | None = None) -> Column:
    unit = F.col("unit") if unit is None else unit
    rank = F.when(unit == UNIT_PREFERENCE[0], 0)
    for place, name in enumerate(UNIT_PREFERENCE[1:], start=1):
        rank = rank.when(unit == name, place)
    return rank


def latest_filings(annual: DataFrame) -> DataFrame:
    """One row per reported period: the value of the filing that supersedes the others."""
    winner = F.max_by(F.struct("pos", "filed", "form", "val"), _filing_order())
    return (
        annual.groupBy(*PERIOD_KEY)
        .agg(winner.alias("winner"))
        .select(*PERIOD_KEY, "winner.*")
    )


def latest_annual(annual: DataFrame) -> DataFrame:
    """Most recent annual value per company and concept, in the preferred unit.

    Preferred unit, then latest period, then superseding filing: their order is
    lexicographic, so the winner is a single aggregate.
    """
    order = F.struct(
        -unit_rank(), F.col("end"), F.coalesce("filed", F.lit("")), -F.col("pos")
    )
    return (
        annual.groupBy("cik", "taxonomy", "concept")
        .agg(F.max_by(F.struct("unit", "end", "val"), order).alias("latest"))
        .select("cik", "taxonomy", "concept", "latest.*")
    )


def preferred_unit(annual: DataFrame) -> DataFrame:
    """The unit each company's concept is read in."""
    return annual.groupBy("cik", "taxonomy", "concept").agg(
        F.min(unit_rank()).alias("rank")
    ).select(
        "cik",
        "taxonomy",
        "concept",
        F.get(F.lit(UNIT_PREFERENCE), F.col("rank")).alias("unit"),
    )


def two_latest_annual(annual: DataFrame, concept: str = ASSETS) -> DataFrame:
    """Latest two annual USD values per company; both NULL with a single period."""
    periods = latest_filings(
        annual.where(
            (F.col("taxonomy") == TAXONOMY)
            & (F.col("concept") == concept)
            & (F.col("unit") == "USD")
        )
    )
    newest_first = Window.partitionBy("cik").orderBy(F.col("end").desc())
    ranked = periods.withColumn("rank", F.row_number().over(newest_first)).where(
        F.col("rank") <= 2
    )
    pair = ranked.groupBy("cik").agg(
        F.max(F.when(F.col("rank") == 1, F.col("val"))).alias("curr"),
        F.max(F.when(F.col("rank") == 2, F.col("val"))).alias("prev"),
        F.max("rank").alias("n_periods"),
    )
    two = F.col("n_periods") == 2
    return pair.select(
        "cik",
        F.when(two, F.col("curr")).alias("curr"),
        F.when(two, F.col("prev")).alias("prev"),
    )


def _first_nonzero(concepts: Sequence[str]) -> Column:
    """First value that is neither NULL nor zero; the last one is taken as it is."""
    columns = [F.col(f"`{name}`") for name in concepts]
    return F.coalesce(*[null_if_zero(c) for c in columns[:-1]], columns[-1])


def company_values(facts: DataFrame, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Equity, shares, operating income and the two latest assets per company.

    One scan; one shuffle of the partially aggregated periods on their full key, then one
    of the few remaining rows by company that serves the window and the final aggregate.
    ``keys`` with ``as_of`` keeps the facts known at different times apart.
    """
    periods = (
        annual_facts(facts, ACCOUNTING_CONCEPTS)
        .withColumn("unit_rank", unit_rank())
        .groupBy(*keys, "concept", "unit_rank", "end")
        .agg(F.max_by("val", _filing_order()).alias("val"))
    )
    by_period = Window.partitionBy(*keys, "concept", "unit_rank").orderBy("end")
    steps = (
        periods.repartition(*keys)
        .withColumn("before", F.lag("val").over(by_period))
        .withColumn("n_before", F.lag("end").over(by_period).isNotNull())
    )
    order = F.struct(-F.col("unit_rank"), F.col("end"))
    latest = []
    for name in [*EQUITY, *SHARES, *OPERATING_INCOME]:
        mine = F.col("concept") == name
        latest.append(
            F.max_by(F.when(mine, F.col("val")), F.when(mine, order)).alias(name)
        )
    assets = (F.col("concept") == ASSETS) & (F.col("unit_rank") == 0)
    step = F.max_by(
        F.when(assets, F.struct("val", "before", "n_before")),
        F.when(assets, F.col("end")),
    )
    wide = steps.groupBy(*keys).agg(*latest, step.alias("step"))
    return wide.select(
        *keys,
        _first_nonzero(EQUITY).alias("equity"),
        _first_nonzero(SHARES).alias("shares"),
        _first_nonzero(OPERATING_INCOME).alias("op_income"),
        F.when(F.col("step.n_before"), F.col("step.val")).alias("assets"),
        F.when(F.col("step.n_before"), F.col("step.before")).alias("prior_assets"),
    )


def values_by_ticker(facts: DataFrame, cik_map: DataFrame) -> DataFrame:
    """Company values under each ticker of the company.

    Joined on the CIK before anything is joined on the ticker, so that tickers without a
    CIK never meet in one partition of NULL keys.
    """
    return cik_map.join(company_values(facts), "cik", "left")


def values_of(universe: DataFrame, facts: DataFrame, cik_map: DataFrame) -> DataFrame:
    """Company values under the tickers of ``universe``, in their own spelling.

    The universe cuts the map down first, and the map the facts, so that companies nobody
    asked for are not reduced. Rows without a CIK are not returned.
    """
    asked = universe.select("ticker").distinct()
    spelled = asked.select("ticker", F.upper("ticker").alias("listed"))
    listed = cik_map.select(F.col("ticker").alias("listed"), "cik")
    companies = spelled.join(listed, "listed").select("ticker", "cik")
    wanted = facts.join(companies.select("cik").distinct(), "cik", "left_semi")
    return companies.join(company_values(wanted), "cik").drop("cik")


def factor_columns(price: str = "price") -> dict[str, Column]:
    """BM, OP, INV and MCAP from company values and a price.

    A ratio is NULL where its divisor is zero or missing, and the price ratios need
    positive shares and price. The market capitalisation is in billions.
    """
    priced = f"shares > 0 and {price} > 0"
    formulas = {
        "bm": (f"if(equity <> 0 and {priced}, try_divide(equity, shares * {price}), null)", 3),
        "op": ("if(equity <> 0, op_income / abs(equity), null)", 3),
        "inv": (
            "if(prior_assets <> 0, (assets - prior_assets) / abs(prior_assets), null)",
            3,
        ),
        "mcap": (f"if({priced}, shares * {price} / 1e9D, null)", 2),
    }
    return {
        name: safe_round(F.expr(formula), digits)
        for name, (formula, digits) in formulas.items()
    }


def factor_record(
    betas: DataFrame, prices: DataFrame, facts: DataFrame, cik_map: DataFrame
) -> DataFrame:
    """All five factors per ticker of ``betas``; without a CIK only the beta is set."""
    values = values_by_ticker(facts, cik_map)
    joined = (
        betas.select(F.col("ticker"), "beta")
        .join(prices, "ticker", "left")
        .join(values, F.upper(betas["ticker"]) == values["ticker"], "left")
        .drop(values["ticker"])
    )
    return joined.withColumns(factor_columns()).select(
        "ticker", "bm", "op", "inv", "beta", "mcap"
    )
