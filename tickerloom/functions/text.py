"""Ticker and universe-name normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates tickers in a list, and what a ticker may contain.
TICKER_SEPARATORS = "[\n,;\t]+"
NOT_TICKER_CHARACTER = "[^A-Z.]"
NOT_UNIVERSE_CHARACTER = "[^a-z0-9_]"
PORTFOLIO_NAME = "^(p_|portfolio)"


def normalize_ticker(text: Column) -> Column:
    return F.upper(F.trim(text))


def normalize_universe_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), NOT_UNIVERSE_CHARACTER, "_")


def is_portfolio(universe: Column) -> Column:
    return universe.rlike(PORTFOLIO_NAME)


def ticker_tokens(text: Column) -> Column:
    """Array of the tickers in a list text, in order, duplicates kept."""
    pieces = F.split(text, TICKER_SEPARATORS)
    cleaned = F.transform(
        pieces, lambda piece: F.regexp_replace(F.upper(piece), NOT_TICKER_CHARACTER, "")
    )
    return F.filter(cleaned, lambda ticker: F.length(ticker) > 0)


def pad_cik(number: Column) -> Column:
    """Zero-pad to ten characters; longer values stay whole."""
    text = F.trim(number.cast("string"))
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))
