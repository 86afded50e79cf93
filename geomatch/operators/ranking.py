"""Ranks inside groups that may be very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomatch.storage import stored

def top_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """First ``k`` rows of each group. Spark limits each group to ``k`` rows in every map task before
    the shuffle, so group size does not matter."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str) -> DataFrame:
    """Add ``rank`` (1-based, bigint) by ``order``, a total order inside each group.

    Rows are cut into range slices by group and order, so a group of any size is shared by as many tasks as its rows need: each slice
    ranks its own rows and adds the row counts of the slices before it.
    """
    keys = list(keys)
    # The slice numbers must be the same wherever they are used, so they are written down first.
    sliced = stored(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where("_before > 0")
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    # Only groups that are cut have offsets: at most one for each slice.
    return (
        sliced.withColumn("_local", local)
        .join(offsets, [*keys, "_slice"], "left")
        .withColumn(rank, F.col("_local").cast("bigint") + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, rank)
    )
