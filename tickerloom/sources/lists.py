"""Ticker lists: text files of tickers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.text import ticker_tokens

#: Lines of a block whose tokens are counted together, where a table of lines has no blocks.
BLOCK_LINES = 4096


def read_ticker_lists(
    spark: SparkSession, paths: str | Sequence[str], recursive: bool = True
) -> DataFrame:
    """Raw text of every list file, named by its file name; ``path`` tells equal names apart."""
    path = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive)
    return files.select(
        F.col("_metadata.file_name").alias("list"),
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("content"),
    )


def read_list_lines(
    spark: SparkSession, paths: str | Sequence[str], recursive: bool = True
) -> DataFrame:
    """``(list, path, block, line_no, line)`` of every list file, for files of any size.

    A large file is read in several splits; ``block`` is where a line's split starts in its file and
    ``line_no`` grows within it, so both together are the order of lines.
    """
    path = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.text(path, recursiveFileLookup=recursive, lineSep="\n")
    return files.select(
        F.col("_metadata.file_name").alias("list"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def parse_lines(lines: DataFrame, keys: Sequence[str] = ("list",)) -> DataFrame:
    """``(*keys, ordinal, ticker)``: what ``parse_tickers`` gives, from the lines of the lists.

    ``lines`` has ``line_no``, ``line`` and, where it was read from files, ``block``. A ticker's place
    is the number of tickers in the blocks before, from one row a block, plus its place in the block.
    So no task sees more than a block of a list, however long that is. Separators end at lines, so
    lines can be taken apart one by one.
    """
    block = F.col("block") if "block" in lines.columns else F.floor(F.col("line_no") / BLOCK_LINES)
    parsed = lines.select(*keys, block.alias("_block"), "line_no", ticker_tokens(F.col("line")).alias("_tickers"))
    parsed = parsed.where(F.size("_tickers") > 0)
    by_list = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        parsed.groupBy(*keys, "_block")
        .agg(F.sum(F.size("_tickers")).alias("_n"))
        .select(*keys, "_block", F.coalesce(F.sum("_n").over(by_list), F.lit(0)).alias("_before"))
    )
    in_block = Window.partitionBy(*keys, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = parsed.withColumn("_inside", F.coalesce(F.sum(F.size("_tickers")).over(in_block), F.lit(0)))
    return (
        placed.join(before, [*keys, "_block"])
        .select(*keys, "_before", "_inside", F.posexplode("_tickers").alias("_at", "ticker"))
        .select(*keys, (F.col("_before") + F.col("_inside") + F.col("_at")).cast("bigint").alias("ordinal"), "ticker")
    )


def parse_tickers(lists: DataFrame, content: str = "content") -> DataFrame:
    """One row per ticker of each list, with its place; duplicates are kept."""
    others = [name for name in lists.columns if name != content]
    return lists.select(
        *others, F.posexplode(ticker_tokens(F.col(content))).alias("ordinal", "ticker")
    ).withColumn("ordinal", F.col("ordinal").cast("bigint"))


def list_names(lists: DataFrame) -> DataFrame:
    """The lists there are; with ``path``, lists of one name in several folders are several."""
    return lists.select([name for name in ("list", "path") if name in lists.columns]).distinct()


def list_overview(lists: DataFrame, content: str = "content", preview: int = 12) -> DataFrame:
    """Size of each list, its first tickers as text, and how many more there are.

    Works inside the array of each list, so no row is exploded or shuffled.
    """
    others = [name for name in lists.columns if name != content]
    tickers = ticker_tokens(F.col(content))
    sized = lists.select(*others, tickers.alias("tickers"))
    return sized.select(
        *others,
        F.size("tickers").cast("bigint").alias("n_tickers"),
        F.array_join(F.slice("tickers", 1, preview), ", ").alias("first_tickers"),
        F.greatest(F.size("tickers") - preview, F.lit(0)).cast("bigint").alias("n_more"),
    )
