"""Helpers shared by the operators: table access, shared storage, words, crc32 folds."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all machines share.

    Without that setting this fails: a local folder would hold a part of the rows on each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid4().hex}"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows``, computed once, written as Parquet to the shared folder and read again.

    The written table cuts the lineage: a lost executor costs the rereading of files only.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, label)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def words(text: Column) -> Column:
    """The words of a text, in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``place`` in the group, from 0, in the order of some columns.

    A range-partitioned sort is written; places are counted inside its partitions and shifted by
    one number a partition, so that no task needs a whole group. Rows without a group are a group.
    """
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    spread = stored(spread.withColumns({"_part": F.spark_partition_id(), "_at": inside}), "numbered")
    counts = sorted(spread.groupBy("_part").agg(F.max("_at")).collect())  # a row a partition
    before, shifts = 0, []
    for part, last in counts:
        shifts += [0] * (part - len(shifts)) + [before]
        before += last + 1
    known = F.split(F.lit(",".join(map(str, shifts)) or "0"), ",").cast("array<bigint>")
    placed = spread.withColumn("_at", F.col("_at") + F.get(known, F.col("_part"))).drop("_part")
    first = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_first"))
    joined = placed.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("place", F.col("_at") - F.col("_first")).drop("_at", "_first", "_group")
