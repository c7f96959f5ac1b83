"""Factor bands, target ranges and display texts of a snapshot row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "—"
UNLABELLED = "unlabelled"

# Guidance bands per factor as (from, below, label). Bands are half-open;
# what lies in no band is "unlabelled".
FACTOR_BANDS = {
    "bm": [
        (None, 0.05, "expensive growth"),
        (0.05, 0.2, "growth/blend"),
        (0.2, 0.5, "value tilt"),
        (0.5, 1.0, "deep value"),
        (1.0, None, "below book"),
    ],
    "op": [
        (None, 0.0, "operating loss"),
        (0.05, 0.15, "mediocre"),
        (0.15, 0.25, "solid"),
        (0.25, None, "high quality"),
    ],
    "inv": [
        (None, 0.0, "shrinking"),
        (0.0, 0.05, "conservative"),
        (0.05, 0.15, "moderate growth"),
        (0.20, None, "aggressive expansion"),
    ],
    "beta": [
        (None, 0.6, "defensive"),
        (0.6, 1.0, "below market"),
        (1.0, 1.4, "above market"),
        (1.5, None, "high volatility"),
    ],
    "mcap": [
        (None, 2.0, "small cap"),
        (2.0, 10.0, "mid cap"),
        (10.0, 100.0, "large cap"),
        (100.0, None, "mega cap"),
    ],
}

# Target range per factor as (from, to, ends included).
TARGET_RANGES = {
    "beta": (0.6, 1.0, True),
    "mcap": (2.0, 10.0, True),
    "bm": (0.20, None, False),
    "op": (0.15, None, False),
    "inv": (None, 0.10, False),
}


def band_label(factor: str, value: Column | None = None) -> Column:
    """The guidance band ``value`` lies in; NULL stays NULL."""
    value = F.col(factor) if value is None else value
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for low, high, name in FACTOR_BANDS[factor]:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value < high)
        label = label.when(inside, name)
    return label.otherwise(UNLABELLED)


def meets_target(factor: str, value: Column | None = None) -> Column:
    """True when ``value`` lies in the factor's target range; NULL does not."""
    value = F.col(factor) if value is None else value
    low, high, inclusive = TARGET_RANGES[factor]
    passed = F.lit(True)
    if low is not None:
        passed = passed & (value >= low if inclusive else value > low)
    if high is not None:
        passed = passed & (value <= high if inclusive else value < high)
    return F.coalesce(passed, F.lit(False))


def percent_text(fraction: Column) -> Column:
    """A fraction as a percentage with one decimal."""
    return _or_mark(fraction, F.format_string("%.1f%%", fraction * 100))


def band_text(percent: Column) -> Column:
    """A percentage of at most two decimals, without trailing zeros."""
    plain = F.regexp_replace(F.format_string("%.2f", percent), "\\.?0+$", "")
    return _or_mark(percent, F.concat(plain, F.lit("%")))


def number_text(value: Column, digits: int) -> Column:
    return _or_mark(value, F.format_string(f"%.{digits}f", value))


def whole_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NULL_MARK))


def _or_mark(value: Column, text: Column) -> Column:
    # format_string prints NULL as "null", hence the explicit test
    return F.when(value.isNull(), NULL_MARK).otherwise(text)
