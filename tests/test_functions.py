import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickerloom.functions import labels, moments, numeric, text


def one(spark, column, **inputs):
    literals = [F.lit(value).alias(name) for name, value in inputs.items()]
    return spark.range(1).select(*literals).select(column.alias("out")).first()["out"]


def test_half_even_matches_numpy(spark):
    rng = np.random.default_rng(7)
    numbers = [*rng.normal(0, 500, 2000), *[n + 0.125 for n in range(50)], 0.5, 1.5, -2.5]
    frame = spark.createDataFrame([(float(n),) for n in numbers], "x DOUBLE")
    rows = frame.select(
        "x",
        numeric.half_even(F.col("x"), 2).alias("two"),
        numeric.half_even(F.col("x")).alias("whole"),
    ).collect()
    assert all(row["two"] == np.round(row["x"], 2) for row in rows)
    assert all(row["whole"] == np.rint(row["x"]) for row in rows)


def test_half_even_has_no_negative_zero(spark):
    assert str(one(spark, numeric.half_even(F.col("x"), 2), x=-0.001)) == "0.0"


@pytest.mark.parametrize(
    "value, expected",
    [("2.3456", 2.346), ("n/a", None), ("NaN", None), ("Infinity", None), (None, None)],
)
def test_safe_round(spark, value, expected):
    column = numeric.safe_round(F.lit(value).cast("string"))
    assert one(spark, column) == expected


def test_ticker_tokens(spark):
    content = "AAPL\nbrk.b, MS FT;T1\tBRK-B\n\n,;AAPL"
    tokens = one(spark, text.ticker_tokens(F.col("x")), x=content)
    assert tokens == ["AAPL", "BRK.B", "MSFT", "T", "BRKB", "AAPL"]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="abZ9.-,;\t\n é", max_size=40))
def test_ticker_tokens_property(spark, content):
    import re

    pieces = re.split("[\n,;\t]+", content)
    wanted = [re.sub("[^A-Z.]", "", piece.upper()) for piece in pieces]
    tokens = one(spark, text.ticker_tokens(F.col("x")), x=content)
    assert tokens == [ticker for ticker in wanted if ticker]


def test_names(spark):
    assert one(spark, text.normalize_universe_name(F.col("x")), x=" My List-1 ") == "my_list_1"
    assert one(spark, text.normalize_ticker(F.col("x")), x=" brk.b ") == "BRK.B"
    for name, expected in [("p_x", True), ("portfolio", True), ("px", False), ("ap_", False)]:
        assert one(spark, text.is_portfolio(F.col("x")), x=name) is expected


def test_pad_cik(spark):
    assert one(spark, text.pad_cik(F.col("x")), x=320193) == "0000320193"
    assert one(spark, text.pad_cik(F.col("x")), x="123456789012") == "123456789012"


@pytest.mark.parametrize(
    "factor, value, label",
    [
        ("bm", 0.049, "expensive growth"),
        ("bm", 0.05, "growth/blend"),
        ("bm", 0.5, "deep value"),
        ("bm", 1.2, "below book"),
        ("op", 0.03, "unlabelled"),
        ("op", -0.1, "operating loss"),
        ("inv", 0.17, "unlabelled"),
        ("beta", 1.45, "unlabelled"),
        ("beta", 0.6, "below market"),
        ("mcap", 100.0, "mega cap"),
        ("mcap", None, None),
    ],
)
def test_factor_bands(spark, factor, value, label):
    column = labels.band_label(factor, F.lit(value).cast("double"))
    assert one(spark, column) == label


@pytest.mark.parametrize(
    "factor, value, met",
    [
        ("beta", 0.6, True),
        ("beta", 1.01, False),
        ("mcap", 10.0, True),
        ("bm", 0.2, False),
        ("op", 0.151, True),
        ("inv", 0.1, False),
        ("inv", None, False),
    ],
)
def test_target_ranges(spark, factor, value, met):
    assert one(spark, labels.meets_target(factor, F.lit(value).cast("double"))) is met


@pytest.mark.parametrize(
    "value, shown",
    [(12.5, "12.5%"), (12.0, "12%"), (-0.07, "-0.07%"), (100.0, "100%"), (None, "—")],
)
def test_band_text(spark, value, shown):
    assert one(spark, labels.band_text(F.lit(value).cast("double"))) == shown


def test_number_texts(spark):
    assert one(spark, labels.percent_text(F.lit(0.1234))) == "12.3%"
    assert one(spark, labels.number_text(F.lit(1.2), 3)) == "1.200"
    assert one(spark, labels.number_text(F.lit(None).cast("double"), 3)) == "—"


def test_frequencies():
    assert [moments.canonical_frequency(n) for n in ("daily", "1D", "1H", "1Min", "x", None)] == [
        "day",
        "day",
        "hour",
        "minute",
        "day",
        "day",
    ]
