"""The screener: look up tickers and keep named universes up to date."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.text import NOT_UNIVERSE_CHARACTER
from tickerloom.operators import evaluate as ev
from tickerloom.operators import ordering, screening
from tickerloom.operators import universe as uni
from tickerloom.params import DEFAULTS, ScreenParams
from tickerloom.schemas import UNIVERSE
from tickerloom.sources.bars import BarReader
from tickerloom.sources.universes import SEQ_STRIDE, UniverseStore

LISTING = "ticker STRING, ordinal BIGINT"


def universe_name(text: str) -> str:
    return re.sub(NOT_UNIVERSE_CHARACTER, "_", text.strip().lower())


class Screener:
    """Operations on universes stored under ``root``.

    ``bars`` reads daily bars and ``price_bars`` minute bars for current prices (the daily
    bars if not given): functions ``(as_of, days_back)``, such as ``bar_reader`` makes. Each
    call reads the lookback of its own ``as_of``, so that no result depends on what an
    earlier one has read. ``facts`` and ``cik_map`` are the filings. A maintenance call
    evaluates its tickers in one job, saves a new version and returns its number.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        bars: BarReader,
        facts: DataFrame | None = None,
        cik_map: DataFrame | None = None,
        price_bars: BarReader | None = None,
        params: ScreenParams = DEFAULTS,
    ) -> None:
        self.spark = spark
        self.store = UniverseStore(spark, root)
        self.bars = bars
        self.facts = facts
        self.cik_map = cik_map
        self.price_bars = price_bars
        self.params = params

    def _bars(self, as_of: datetime) -> DataFrame:
        p = self.params
        return self.bars(as_of, max(p.rsi_days, p.beta_days, p.band_days, p.price_days))

    def _price_bars(self, as_of: datetime) -> DataFrame | None:
        return None if self.price_bars is None else self.price_bars(as_of, self.params.price_days)

    def evaluate(
        self, universe: DataFrame | None, as_of: datetime, complete: bool = True
    ) -> DataFrame:
        return ev.evaluate(
            self._bars(as_of),
            as_of,
            facts=self.facts,
            cik_map=self.cik_map,
            universe=universe,
            price_bars=self._price_bars(as_of),
            params=self.params,
            complete=complete,
        )

    def _listing(self, tickers: DataFrame | Sequence[str]) -> DataFrame:
        if isinstance(tickers, DataFrame):
            return tickers.select("ticker", "ordinal")
        numbered = [(ticker, place) for place, ticker in enumerate(tickers)]
        return self.spark.createDataFrame(numbered, LISTING)

    def snapshot(self, as_of: datetime, universe: DataFrame | None = None) -> DataFrame:
        return ev.snapshot(self.evaluate(universe, as_of))

    def lookup(self, ticker: str, as_of: datetime) -> DataFrame:
        """Status and measures of one ticker, from its own bars and the market's."""
        name = ticker.strip().upper()
        wanted = F.col("ticker").isin(name, self.params.market)
        prices = self._price_bars(as_of)
        evaluated = ev.evaluate(
            self._bars(as_of).where(wanted),
            as_of,
            facts=self.facts,
            cik_map=self.cik_map,
            universe=self.spark.createDataFrame([(name,)], "ticker STRING"),
            price_bars=None if prices is None else prices.where(wanted),
            params=self.params,
        )
        return ev.lookup(evaluated)

    def create(
        self, dbname: str, tickers: DataFrame | Sequence[str], as_of: datetime
    ) -> int:
        """Create or extend a universe by ``tickers``, names or ``(ticker, ordinal)``."""
        name = universe_name(dbname)
        listing = self._listing(tickers)
        if listing.isEmpty():
            raise ValueError("no tickers given")
        old = self.store.version(name)
        stored = self._no_rows() if old is None else self.store.load(name, old)
        new = (old or 0) + 1
        wanted = uni.tickers_to_evaluate(stored, listing)
        fresh = self.store.stage_evaluation(self.evaluate(wanted, as_of), name, new)
        rows = uni.create(stored, listing, fresh, as_of, new * SEQ_STRIDE)
        return self.store.save(rows, name, new)

    def update(self, dbname: str, as_of: datetime) -> int:
        """Recompute every row of a universe."""
        name = universe_name(dbname)
        old = self.store.latest(name)
        stored = self.store.load(name, old)
        fresh = self.store.stage_evaluation(self.evaluate(stored, as_of), name, old + 1)
        return self.store.save(uni.refresh(stored, fresh, as_of), name, old + 1)

    def add(
        self, dbname: str, tickers: str | DataFrame | Sequence[str], as_of: datetime
    ) -> int:
        """Add tickers that are not there yet; what is there stays as it is."""
        name = universe_name(dbname)
        old = self.store.latest(name)
        stored = self.store.load(name, old)
        candidates = self._listing([tickers] if isinstance(tickers, str) else tickers)
        new = candidates.join(stored, "ticker", "left_anti")
        fresh = self.store.stage_evaluation(self.evaluate(new, as_of), name, old + 1)
        rows = uni.add(stored, candidates, fresh, as_of, (old + 1) * SEQ_STRIDE)
        return self.store.save(rows, name, old + 1)

    def remove(self, dbname: str, tickers: str | DataFrame | Sequence[str]) -> int:
        name = universe_name(dbname)
        gone = self._listing([tickers] if isinstance(tickers, str) else tickers)
        old = self.store.latest(name)
        return self.store.save(uni.remove(self.store.load(name, old), gone), name, old + 1)

    def reset(self, dbname: str) -> int:
        """Empty a universe but keep its name."""
        name = universe_name(dbname)
        old = self.store.latest(name)
        return self.store.save(uni.reset(self.store.load(name, old)), name, old + 1)

    def load(self, dbname: str, sort: str = "normal", limit: int | None = None) -> DataFrame:
        """Rows of a universe in one of the sort orders, or the first ``limit`` of them."""
        rows = self.store.load(universe_name(dbname))
        if limit is None:
            return ordering.sort_rows(rows, sort)
        return ordering.top_rows(rows, limit, sort)

    def report(self, dbname: str, sort: str = "normal") -> DataFrame:
        return screening.report_view(self.load(dbname, sort))

    def universes(self) -> DataFrame:
        return self.store.names()

    def rejects(self, dbname: str) -> DataFrame:
        """Tickers the last run rejected, with the reason."""
        return ev.rejects(self.store.evaluation(universe_name(dbname)))

    def run_counts(self, dbname: str) -> DataFrame:
        return ev.run_counts(self.store.evaluation(universe_name(dbname)))

    def coverage(self, dbname: str, as_of: datetime, days_back: float = 5) -> DataFrame:
        """Which tickers of a universe have recent bars."""
        rows = self.store.load(universe_name(dbname))
        return ev.coverage(rows, self.bars(as_of, days_back), as_of, days_back)

    def _no_rows(self) -> DataFrame:
        return self.spark.createDataFrame([], UNIVERSE)
