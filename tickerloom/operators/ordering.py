"""Sort orders of a stored universe.

All orders end with ``seq``, the insertion order, so equal keys keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import null_if_zero
from tickerloom.operators.checkpoints import checkpointed

# What a missing factor counts as when sorting.
MISSING_LOW = -999.0
MISSING_HIGH = 999.0

SORT_CHOICES = ["normal", "rsi", "bm", "op", "inv", "beta", "mcap"]


def sort_key(choice: str) -> tuple[Column, bool]:
    """Key of a sort choice and whether it descends; unknown choices sort by the band."""
    if choice == "rsi":
        return F.coalesce(F.col("rsi").cast("double"), F.lit(0.0)), True
    if choice in ("bm", "op"):
        # zero counts as missing here, and only here
        return F.coalesce(null_if_zero(F.col(choice)), F.lit(MISSING_LOW)), True
    if choice in ("inv", "beta", "mcap"):
        return F.coalesce(F.col(choice), F.lit(MISSING_HIGH)), False
    return F.coalesce(F.col("pct_below_ci"), F.lit(0.0)), True


def sort_columns(choice: str) -> list[Column]:
    key, descending = sort_key(choice)
    return [key.desc() if descending else key.asc(), F.col("seq").asc()]


def listable(rows: DataFrame) -> DataFrame:
    """Rows that can be listed: with a ticker and an RSI."""
    return rows.where(
        F.col("ticker").isNotNull() & (F.col("ticker") != "") & F.col("rsi").isNotNull()
    )


def sort_rows(rows: DataFrame, choice: str = "normal") -> DataFrame:
    return listable(rows).orderBy(*sort_columns(choice))


def top_rows(rows: DataFrame, k: int, choice: str = "normal") -> DataFrame:
    """First ``k`` rows of an order, without sorting the rest."""
    return sort_rows(rows, choice).limit(k)


def numbered(rows: DataFrame, choice: str = "normal") -> DataFrame:
    """Rows in order with their place, without passing them through one task.

    The range-partitioned sort is checkpointed, which fixes partitions and their order.
    Places then need one count per partition: as many rows as there are partitions.
    """
    ordered = checkpointed(sort_rows(rows, choice))
    tagged = ordered.withColumns(
        {
            "_part": F.spark_partition_id(),
            "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
        }
    )
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offsets = sizes.select(
        "_part", (F.sum("_size").over(earlier) - F.col("_size")).alias("_offset")
    )
    place = F.col("_offset") + F.col("_row") + 1
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn("pos", place)
        .drop("_part", "_row", "_offset")
    )


def sort_key_column(choice: str) -> str:
    return f"key_{choice}"


def with_sort_keys(rows: DataFrame) -> DataFrame:
    """Rows that can be listed, with a column for each order that ascends as the order goes."""
    keys = {}
    for choice in SORT_CHOICES:
        key, descending = sort_key(choice)
        # a negative zero would be told apart from zero by nothing but its sign
        keys[sort_key_column(choice)] = (-key if descending else key) + F.lit(0.0)
    return listable(rows).withColumns(keys)


def write_pages(rows: DataFrame, path: str, choice: str = "normal", mode: str = "error") -> None:
    """Store a universe clustered by an order, so that the files of a page are found by its key.

    Ranges are of the order's key and ``seq``, which no two rows share, so equal keys split too.
    """
    order = [sort_key_column(choice), "seq"]
    sorted_rows = with_sort_keys(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.mode(mode).parquet(path)


def page_after(
    pages: DataFrame, choice: str, size: int, after: tuple[float, int] | None = None
) -> DataFrame:
    """The next ``size`` rows of an order behind the row with key and ``seq`` of ``after``.

    ``pages`` is what ``write_pages`` stored, or any rows ``with_sort_keys``. A page is found by
    its key and not by counting the rows before it: the condition reaches the files, whose
    statistics leave out those of earlier pages, and rows that come or go before it move nothing.
    """
    key = F.col(sort_key_column(choice))
    if after is not None:
        value, seq = F.lit(float(after[0])), F.lit(after[1])
        pages = pages.where((key >= value) & ((key > value) | (F.col("seq") > seq)))
    return pages.orderBy(key, "seq").limit(size)


def last_of(page: DataFrame, choice: str) -> tuple[float, int] | None:
    """What ``page_after`` wants for the page behind this one; None behind an empty page."""
    key = sort_key_column(choice)
    row = page.agg(F.max(F.struct(key, "seq")).alias("last")).first()["last"]
    return None if row is None else (row[0], row[1])
