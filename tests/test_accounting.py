import random
from types import SimpleNamespace

import pytest
from builders import fact, facts, values

from tickerloom.operators import accounting as acc

EQ, EQ2 = acc.EQUITY
SH, SH2 = acc.SHARES
OI, OI2 = acc.OPERATING_INCOME


def company(spark, *rows):
    found = values(acc.company_values(facts(spark, *rows)), "cik")
    return SimpleNamespace(**found["1"]) if "1" in found else None


def test_later_filing_wins_for_the_same_period(spark):
    rows = [
        fact("1", EQ, "2022-12-31", "2023-02-01", 5),
        fact("1", EQ, "2022-12-31", "2023-06-01", 6, pos=1, form="10-K/A"),
        fact("1", EQ, "2021-12-31", "2024-01-01", 7, pos=2),
    ]
    assert company(spark, *rows).equity == 6
    kept = acc.latest_filings(acc.annual_facts(facts(spark, *rows))).collect()
    assert {(r["end"], r["val"]) for r in kept} == {("2022-12-31", 6.0), ("2021-12-31", 7.0)}


def test_first_of_equal_filings_wins(spark):
    rows = [
        fact("1", EQ, "2022-12-31", "2023-02-01", 9, pos=4),
        fact("1", EQ, "2022-12-31", "2023-02-01", 8, pos=2),
        fact("1", EQ, "2022-12-31", None, 7, pos=0),
    ]
    assert company(spark, *rows).equity == 8


def test_only_annual_forms_count(spark):
    rows = [
        fact("1", EQ, "2023-03-31", "2023-04-01", 9, form="10-Q"),
        fact("1", EQ, "2022-12-31", "2023-02-01", 8),
    ]
    assert company(spark, *rows).equity == 8


def test_preferred_unit_with_annual_values(spark):
    rows = [
        fact("1", SH, "2023-12-31", "2024-02-01", 1, unit="USD", form="10-Q"),
        fact("1", SH, "2022-12-31", "2023-02-01", 2, unit="shares"),
        fact("1", SH, "2023-12-31", "2024-02-01", 3, unit="pure"),
        fact("1", SH, "2023-12-31", "2024-02-01", 4, unit="EUR"),
    ]
    assert company(spark, *rows).shares == 2
    annual = acc.annual_facts(facts(spark, *rows))
    assert acc.preferred_unit(annual).first()["unit"] == "shares"
    assert acc.latest_annual(annual).first()["val"] == 2


@pytest.mark.parametrize(
    "first, second, expected",
    [(0, 7, 7), (None, 7, 7), (3, 7, 3), (0, None, None), (None, 0, 0), (0, 0, 0)],
)
def test_fallback_skips_zero_and_missing(spark, first, second, expected):
    rows = [fact("1", "Assets", "2022-12-31", "2023-02-01", 1)]
    for name, value in ((OI, first), (OI2, second)):
        if value is not None:
            rows.append(fact("1", name, "2022-12-31", "2023-02-01", value))
    assert company(spark, *rows).op_income == expected


@pytest.mark.parametrize(
    "ends, expected",
    [
        (["2022-12-31"], (None, None)),
        (["2022-12-31", "2019-12-31"], (2022.0, 2019.0)),
        (["2020-12-31", "2022-12-31", "2021-06-30"], (2022.0, 2021.0)),
    ],
)
def test_two_latest_periods(spark, ends, expected):
    rows = [fact("1", "Assets", end, "2023-02-01", int(end[:4])) for end in ends]
    found = company(spark, *rows)
    assert (found.assets, found.prior_assets) == expected
    pair = acc.two_latest_annual(acc.annual_facts(facts(spark, *rows))).first()
    assert (pair["curr"], pair["prev"]) == expected


def test_growth_reads_dollars_only(spark):
    rows = [
        fact("1", "Assets", "2021-12-31", "2022-02-01", 1, unit="pure"),
        fact("1", "Assets", "2022-12-31", "2023-02-01", 2),
    ]
    assert company(spark, *rows).prior_assets is None


def factors(spark, price, **company_values):
    fields = {"equity", "shares", "op_income", "assets", "prior_assets"}
    row = {name: None for name in fields} | company_values | {"price": price}
    schema = ", ".join(f"{name} DOUBLE" for name in row)
    frame = spark.createDataFrame([tuple(row.values())], schema)
    return SimpleNamespace(**frame.select(
        *[c.alias(n) for n, c in acc.factor_columns().items()]
    ).first().asDict())


def test_ratios(spark):
    f = factors(
        spark, 10.0, equity=500.0, shares=100.0, op_income=50.0, assets=110.0, prior_assets=100.0
    )
    assert (f.bm, f.mcap, f.op, f.inv) == (0.5, 0.0, 0.1, 0.1)
    f = factors(spark, 10.0, equity=-10.0, shares=2e8, op_income=5.0, assets=1.0, prior_assets=-2.0)
    assert (f.bm, f.mcap, f.op, f.inv) == (0.0, 2.0, 0.5, 1.5)


@pytest.mark.parametrize("price", [None, 0.0, -1.0])
def test_ratios_need_a_price(spark, price):
    f = factors(spark, price, equity=5.0, shares=2.0, op_income=0.0, prior_assets=0.0, assets=1.0)
    assert (f.bm, f.mcap, f.op, f.inv) == (None, None, 0.0, None)


@pytest.mark.parametrize("shares", [None, 0.0, -3.0])
def test_ratios_need_shares(spark, shares):
    f = factors(spark, 5.0, equity=5.0, shares=shares)
    assert (f.bm, f.mcap) == (None, None)


def test_zero_equity_has_no_ratio(spark):
    f = factors(spark, 5.0, equity=0.0, shares=1.0, op_income=4.0)
    assert (f.bm, f.op) == (None, None)


def test_factor_record_without_cik_keeps_beta(spark):
    betas = spark.createDataFrame([("brk.b", 0.9), ("B", 0.8)], "ticker STRING, beta DOUBLE")
    prices = spark.createDataFrame([("brk.b", 10.0)], "ticker STRING, price DOUBLE")
    cik_map = spark.createDataFrame([("BRK.B", "1")], "ticker STRING, cik STRING")
    filed = facts(
        spark,
        fact("1", EQ, "2022-12-31", "2023-02-01", 50),
        fact("1", SH, "2022-12-31", "2023-02-01", 10, unit="shares"),
    )
    found = values(acc.factor_record(betas, prices, filed, cik_map))
    assert found["brk.b"] == {
        "ticker": "brk.b", "bm": 0.5, "op": None, "inv": None, "beta": 0.9, "mcap": 0.0,
    }
    assert found["B"] == {
        "ticker": "B", "bm": None, "op": None, "inv": None, "beta": 0.8, "mcap": None,
    }


def plain_annual_value(rows, concept):
    """Brute force over one company's rows in document order."""
    for unit in ("USD", "shares", "pure"):
        best = {}
        for row in rows:
            _, _, name, row_unit, pos, end, filed, form, val = row
            if name != concept or row_unit != unit or form not in ("10-K", "10-K/A"):
                continue
            if end not in best or filed > best[end][0]:
                best[end] = (filed, val)
        if best:
            return best[max(best)][1]
    return None


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for cik in ("1", "2", "3"):
        for pos in range(300 if cik == "1" else 40):
            rows.append(
                fact(
                    cik,
                    rng.choice([EQ, EQ2, SH, OI, "Assets"]),
                    f"{rng.randint(2015, 2020)}-12-31",
                    f"2021-0{rng.randint(1, 4)}-01",
                    rng.choice([0, 1, 2, 3]) * 1.5,
                    rng.choice(["USD", "shares", "pure", "EUR"]),
                    pos,
                    rng.choice(["10-K", "10-K/A", "10-Q"]),
                )
            )
    shuffled = rows[:]
    rng.shuffle(shuffled)
    found = values(acc.company_values(facts(spark, *shuffled)), "cik")
    for cik in ("1", "2", "3"):
        mine = [row for row in rows if row[0] == cik]
        equity = plain_annual_value(mine, EQ) or plain_annual_value(mine, EQ2)
        assert found[cik]["equity"] == equity
        assert found[cik]["op_income"] == (
            plain_annual_value(mine, OI) or plain_annual_value(mine, OI2)
        )
