"""Ranks without a window over all rows, or over a large group, in one task; and rows dealt by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import shared_dir


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by their keys over as many partitions as the session has for a shuffle. Adaptive execution would merge these by their compressed size, a tenth of what sorts and hash tables need for them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with a rank from 1 in ``order``, which must tell rows apart. They are range-partitioned and sorted there; only a count for each partition
    meets in one place. The sorted rows are checkpointed, since the ranges of a second run may differ."""
    shared_dir(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).checkpoint()
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")  # a row for each partition
    return out.withColumn(name, F.col("_before") + F.col("_seq") + 1).select(*rows.columns, name)


def with_group_rank(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The same from 1 in each group of ``by``: the rank over all, less that of the group's first row."""
    ranked = with_rank(rows, [*(F.col(c) for c in by), *order], "_rank")
    first = ranked.groupBy(*by).agg(F.min("_rank").alias("_first"))
    on = [F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in by]
    out = ranked.alias("_a").join(first.alias("_b"), on).withColumn(name, F.col("_rank") - F.col("_first") + 1)
    return out.select(*(F.col(f"_a.{c}") for c in rows.columns), name)
