"""Filings as they were known: superseded values as intervals, and values at many dates.

A value is known from the day its filing came in until the day another filing for the same period
supersedes it. Days are ISO texts like those in the filings; a value filed on a day is known on that
day. Values without a filing date have always been known, until a dated one supersedes them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.moments import moment_literal
from tickerloom.operators.accounting import ACCOUNTING_CONCEPTS, PERIOD_KEY, annual_facts, company_values
from tickerloom.operators.evaluate import snapshot

#: Days of a bucket of the interval join.
BUCKET_DAYS = 91


def filing_intervals(annual: DataFrame) -> DataFrame:
    """Every value of a period with the days it was the known one.

    ``known_to`` is the first day it no longer is, NULL for the latest value; ``known_from`` is
    empty without a filing date. Of values filed on one day the first of the document counts. The
    reduction to one value a day has map-side partials; the window then sees the days on which a
    single period was filed.
    """
    first = F.max_by(F.struct("pos", "filed", "form", "val"), -F.col("pos")).alias("first")
    days = annual.groupBy(*PERIOD_KEY, F.coalesce("filed", F.lit("")).alias("known_from")).agg(first)
    following = F.lead("known_from").over(Window.partitionBy(*PERIOD_KEY).orderBy("known_from"))
    return days.withColumn("known_to", following).select(*PERIOD_KEY, "first.*", "known_from", "known_to")


def _bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day.cast("date")) / BUCKET_DAYS)


def facts_as_of(intervals: DataFrame, requests: DataFrame) -> DataFrame:
    """The value of every period known at each ``as_of`` of ``requests``.

    ``requests`` has distinct ISO days ``as_of``, or distinct ``(cik, as_of)`` where companies ask
    for days of their own. Intervals are dealt to the buckets of days they overlap, of those in which
    anything is asked, and meet the requests of their bucket; the days are compared there. So the
    join is on equal keys, and no interval goes where it cannot match.
    """
    keys = [name for name in ("cik",) if name in requests.columns]
    asked = requests.select(*keys, "as_of", _bucket(F.col("as_of")).alias("bucket"))
    span = asked.agg(F.min("bucket").alias("first"), F.max("bucket").alias("last")).first()
    if span["first"] is None:
        asked, span = asked.where(F.lit(False)), {"first": 0, "last": 0}
    first = F.greatest(_bucket(F.nullif(F.col("known_from"), F.lit(""))), F.lit(span["first"]))
    last = F.least(F.coalesce(_bucket(F.col("known_to")), F.lit(span["last"])), F.lit(span["last"]))
    dealt = intervals.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    dealt = dealt.withColumn("bucket", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    filled = asked.select(*keys, "bucket").distinct()
    within = (F.col("known_from") <= F.col("as_of")) & (F.col("known_to").isNull() | (F.col("as_of") < F.col("known_to")))
    met = dealt.join(filled, [*keys, "bucket"], "left_semi").join(asked, [*keys, "bucket"]).where(within)
    return met.select("as_of", *PERIOD_KEY, "pos", "filed", "form", "val")


def company_values_as_of(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``company_values`` as they stood at each ``as_of`` of ``requests``."""
    annual = annual_facts(facts, ACCOUNTING_CONCEPTS)
    known = facts_as_of(filing_intervals(annual), requests)
    return company_values(known, ["cik", "as_of"])


def snapshots_as_of(
    evaluate_at: Callable[[datetime], DataFrame], moments: Sequence[datetime], drop_zero_rsi: bool = True
) -> DataFrame:
    """The snapshots at several moments, each from the bars and filings known by then.

    ``evaluate_at`` gives the evaluation at a moment. Each reads the months of its own lookback.
    """
    taken = [
        snapshot(evaluate_at(moment), drop_zero_rsi).withColumn("as_of", moment_literal(moment)) for moment in moments
    ]
    return reduce(DataFrame.unionByName, taken)
