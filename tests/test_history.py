"""Filings and snapshots as they were known, against brute force."""

import random
from datetime import timedelta

import numpy as np
import pytest
from builders import AS_OF, bars, daily, fact, facts, values

from tickerloom.operators import accounting as acc
from tickerloom.operators import evaluate as ev
from tickerloom.operators import history

EQ, SH, ASSETS = "StockholdersEquity", "CommonStockSharesOutstanding", "Assets"


@pytest.fixture(scope="module")
def rows():
    """Periods filed again and again, on the same day too, and some without a day."""
    rng = random.Random(9)
    out = []
    for pos in range(400):
        filed = None if rng.random() < 0.05 else f"{rng.randint(2010, 2016)}-{rng.randint(1, 12):02d}-{rng.choice([1, 15]):02d}"
        out.append(
            fact(
                rng.choice(["1", "2"]), rng.choice([EQ, SH, ASSETS]), f"{rng.randint(2009, 2014)}-12-31",
                filed, rng.randint(0, 5), rng.choice(["USD", "shares"]), pos, rng.choice(["10-K", "10-K/A", "10-Q"]),
            )
        )
    return out


def known(rows, day):
    """The value of every period known on a day: the last filed, of one day the first."""
    best = {}
    for row in rows:
        cik, taxonomy, concept, unit, pos, end, filed, form, val = row
        if form == "10-Q" or (filed or "") > day:
            continue
        key = (cik, taxonomy, concept, unit, end)
        if key not in best or ((filed or ""), -pos) > best[key][0]:
            best[key] = (((filed or ""), -pos), (pos, filed, form, val))
    return {key: value for key, (_, value) in best.items()}


DAYS = ["2009-01-01", "2010-01-15", "2012-06-30", "2013-03-01", "2013-03-02", "2016-12-15", "2030-01-01"]


@pytest.mark.parametrize("shuffled", [False, True])
def test_every_day_against_brute_force(spark, rows, shuffled):
    given = random.Random(1).sample(rows, len(rows)) if shuffled else rows
    intervals = history.filing_intervals(acc.annual_facts(facts(spark, *given)))
    requests = spark.createDataFrame([(d,) for d in DAYS], "as_of STRING")
    found = history.facts_as_of(intervals, requests).collect()
    for day in DAYS:
        mine = {
            (r.cik, r.taxonomy, r.concept, r.unit, r.end): (r.pos, r.filed, r.form, r.val) for r in found if r.as_of == day
        }
        assert mine == known(rows, day)
    assert len(found) == sum(len(known(rows, day)) for day in DAYS)


def test_intervals_of_a_period_meet_without_gaps(spark, rows):
    found = history.filing_intervals(acc.annual_facts(facts(spark, *rows))).collect()
    by_period = {}
    for r in found:
        by_period.setdefault((r.cik, r.concept, r.unit, r.end), []).append((r.known_from, r.known_to))
    for spans in by_period.values():
        spans.sort()
        assert [b for _, b in spans[:-1]] == [a for a, _ in spans[1:]] and spans[-1][1] is None


def test_companies_ask_for_days_of_their_own(spark, rows):
    table = facts(spark, *rows)
    asked = [("1", "2012-06-30"), ("1", "2016-12-15"), ("2", "2013-03-01"), ("3", "2013-03-01")]
    requests = spark.createDataFrame(asked, "cik STRING, as_of STRING")
    found = {(r.cik, r.as_of): r for r in history.company_values_as_of(table, requests).collect()}
    assert set(found) == {x for x in asked if x[0] != "3"}
    for cik, day in found:
        then = [r for r in rows if r[0] == cik and (r[6] or "") <= day]
        plain = acc.company_values(facts(spark, *then)).first()
        assert found[cik, day].asDict() == {**plain.asDict(), "as_of": day}


def test_nothing_asked_and_nothing_filed(spark, rows):
    none = spark.createDataFrame([], "as_of STRING")
    intervals = history.filing_intervals(acc.annual_facts(facts(spark, *rows)))
    assert history.facts_as_of(intervals, none).count() == 0
    one = spark.createDataFrame([("2012-01-01",)], "as_of STRING")
    assert history.company_values_as_of(facts(spark, *rows).where("false"), one).count() == 0


def test_days_are_joined_on_their_bucket(spark, rows):
    intervals = history.filing_intervals(acc.annual_facts(facts(spark, *rows)))
    requests = spark.createDataFrame([(d,) for d in DAYS], "as_of STRING")
    plan = history.facts_as_of(intervals, requests)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_later_filing_never_changes_an_earlier_snapshot(spark):
    walk = 100 + np.random.default_rng(4).normal(0, 1, 300).cumsum()
    table = bars(spark, daily("SPY", walk), daily("AAA", walk[::-1]))
    early = [
        fact("1", EQ, "2022-12-31", "2023-02-01", 50),
        fact("1", SH, "2022-12-31", "2023-02-01", 10, unit="shares"),
        fact("1", ASSETS, "2021-12-31", None, 90),
        fact("1", ASSETS, "2022-12-31", "2023-02-01", 100),
    ]
    middle = AS_OF - timedelta(days=30)
    late = [
        fact("1", EQ, "2022-12-31", f"{middle:%Y-%m-%d}", 70, form="10-K/A"),
        fact("1", EQ, "2023-12-31", f"{AS_OF + timedelta(days=1):%Y-%m-%d}", 80),
        fact("1", ASSETS, "2023-12-31", f"{AS_OF:%Y-%m-%d}", 300),
    ]
    cik_map = spark.createDataFrame([("AAA", "1")], "ticker STRING, cik STRING")

    def at(moment, filed):
        return ev.evaluate(table, moment, facts=facts(spark, *filed), cik_map=cik_map)

    before = middle - timedelta(days=1)
    moments = [before, AS_OF]
    found = history.snapshots_as_of(lambda m: at(m, early + late), moments)
    taken = {r.as_of: r for r in found.where("ticker = 'AAA'").collect()}
    alone = values(ev.snapshot(at(before, early)))["AAA"]
    assert {k: taken[before][k] for k in alone} == alone
    assert taken[before].inv == round(10 / 90, 3) and taken[AS_OF].inv == 2.0
    # the value filed the day after is not known yet, the amendment is
    now = values(ev.snapshot(at(AS_OF, early + [late[0], late[2]])))["AAA"]
    assert {k: taken[AS_OF][k] for k in now} == now and now["bm"] != alone["bm"]
