"""Thresholds and lookbacks of the screen, in one immutable place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScreenParams:
    """Defaults of every screening operator; override per call.

    The lookbacks are calendar days counted back from ``as_of`` and may be fractional.
    """

    # Fixed values of the screen

    band_days: float = 90
    rsi_days: float = 720
    beta_days: float = 400
    price_days: float = 5
    rsi_bars: int = 14
    min_common_returns: int = 30
    penny_limit: float = 5.0
    band_sigmas: float = 2.0
    market: str = "SPY"


DEFAULTS = ScreenParams()
