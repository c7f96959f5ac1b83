"""Equity screening on Spark: DataFrame operators over price bars and company filings."""

from tickerloom.params import DEFAULTS, ScreenParams
from tickerloom.plans.screener import Screener

__all__ = ["DEFAULTS", "ScreenParams", "Screener"]
