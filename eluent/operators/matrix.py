"""Cells of an ion-by-sample matrix, kept long: rows (ion_id, sample_id, area). Wide only at the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def widen(cells: DataFrame, samples: list, prefix: str = "s", keys: tuple[str, ...] = ("ion_id",), value: str = "area") -> DataFrame:
    """A column for each of ``samples``; of several rows of a cell one alone may have a value, else it is an error."""
    one = F.when(F.count(value) > 1, F.raise_error(F.concat(F.lit("several values in a cell of "), F.to_json(F.struct(*keys, "sample_id"))))).otherwise(F.max(value))
    one = cells.groupBy(*keys, "sample_id").agg(one.alias("_value"))
    wide = one.groupBy(*keys).pivot("sample_id", samples).agg(F.max("_value"))
    return wide.select(*keys, *(F.col(f"`{s}`").alias(f"{prefix}{s}") for s in samples))


def melt(matrix: DataFrame, keys: list[str], samples: list[str], value: str = "area") -> DataFrame:
    return matrix.unpivot(keys, samples, "sample_id", value)


def grid(ions: DataFrame, samples: DataFrame) -> DataFrame:
    """Every cell. The samples of a study are few: they ride along as one array."""
    listed = samples.agg(F.array_sort(F.collect_set("sample_id")).alias("_all"))
    return ions.select("ion_id").join(F.broadcast(listed)).select("ion_id", F.explode("_all").alias("sample_id"))


def upsert(cells: DataFrame, newer: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Newer values over older ones; cells of either side stay."""
    n = newer.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    return cells.join(n, keys, "full_outer").select(*keys, *(F.coalesce(f"_{v}", v).alias(v) for v in values))


def fill(cells: DataFrame, info: DataFrame, keys: list[str], value: str = "area") -> DataFrame:
    """Missing cells from ``info``; others stay."""
    i = info.select(*keys, F.col(value).alias("_info"))
    return ranks.dealt(cells, *keys).join(i, keys, "left").withColumn(value, F.coalesce(value, "_info")).drop("_info")


def enough_present(cells: DataFrame, key: str, most_missing: Column) -> DataFrame:
    """Cells of the keys whose missing cells are at most ``most_missing`` (of the number of cells, ``n``)."""
    of = Window.partitionBy(key)  # the samples of one row
    n = cells.where(F.col(key).isNotNull()).select(F.struct("*").alias("_cell"), F.col(key).alias(key), F.count("*").over(of).alias("n"), F.count(F.when(F.col("area").isNull(), 1)).over(of).alias("missing"))
    return n.where(F.col("missing") <= most_missing).select("_cell.*")


def mix_rows(cells: DataFrame, key: str = "ion_id", sample: str = "sample_id") -> DataFrame:
    """Cells of the keys present in at least half of the samples named ``mix``; all if there are none."""
    mix = F.col(sample).contains("mix")
    of = Window.partitionBy(key)
    here, present = F.count(F.when(mix, 1)).over(of), F.count(F.when(mix & F.col("area").isNotNull(), 1)).over(of)
    return cells.where(F.col(key).isNotNull()).withColumn("_kept", present * 2 >= here).where("_kept").drop("_kept")
