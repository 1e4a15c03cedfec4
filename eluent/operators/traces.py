"""Mass traces: centroids of neighbouring scans and masses, chained into regions of interest.

A trace is cut where masses, in their order, leave a gap of more than ``ppm`` of the lower one, then where scans leave a gap of more than ``gap`` scans, and
both once more for what has fallen apart (``ROUNDS``). A sample's masses are cut in buckets of their logarithm, so that no task holds a sample: each
bucket learns the last mass of the one before, and a trace that goes on across buckets takes its start from a row for each bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

ROUNDS = 2
#: Tolerances in a bucket.
WIDE = 256


def cut(rows: DataFrame, keys: list[str], order: str, far: Column, name: str) -> DataFrame:
    """``rows`` with the number of cuts before each in its key; ``far`` compares ``order`` with ``_before``."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("_before", F.lag(order).over(by)).withColumn("_cut", F.coalesce(far, F.lit(False)).cast("int"))
    return rows.withColumn(name, F.sum("_cut").over(by.rangeBetween(Window.unboundedPreceding, 0))).drop("_before", "_cut")


def mass_islands(rows: DataFrame, ppm: float, key: str = "sample_id", mz: str = "mz", name: str = "island") -> DataFrame:
    """``rows`` with the smallest mass of the run of masses, each within ``ppm`` of the next lower one, that they are part of."""
    far = F.col(mz) - F.col("_before") > F.col("_before") * (ppm * 1e-6)
    rows = ranks.dealt(rows.withColumn("_bucket", F.floor(F.log(mz) / (WIDE * math.log1p(ppm * 1e-6)))), key, "_bucket")
    inside = Window.partitionBy(key, "_bucket").orderBy(mz)
    last = rows.groupBy(key, "_bucket").agg(F.max(mz).alias("_last")).withColumn("_bucket", F.col("_bucket") + 1)
    rows = rows.join(last, [key, "_bucket"], "left").withColumn("_before", F.coalesce(F.lag(mz).over(inside), "_last"))
    rows = rows.withColumn("_start", F.when(F.col("_before").isNull() | far, F.col(mz)))
    begun = rows.groupBy(key, "_bucket").agg(F.max("_start").alias("_begun"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    begun = begun.select(key, "_bucket", F.last("_begun", ignorenulls=True).over(earlier).alias("_carried"))
    rows = rows.withColumn(name, F.max("_start").over(inside.rangeBetween(Window.unboundedPreceding, 0))).join(begun, [key, "_bucket"])
    return rows.withColumn(name, F.coalesce(name, "_carried")).drop("_bucket", "_last", "_before", "_start", "_carried")


def labelled(centroids: DataFrame, ppm: float, gap: int = 1, rounds: int = ROUNDS) -> tuple[DataFrame, list[str]]:
    """Centroids (sample_id, scan, rt, mz, intensity) of positive mass and finite values with the columns that name their trace."""
    plain = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = mass_islands(centroids.where(plain("mz") & plain("intensity") & (F.col("mz") > 0)), ppm)
    rows = ranks.dealt(rows.withColumn("_place", F.xxhash64("island")), "sample_id", "_place")  # a mass is no key for what follows to find its rows dealt by
    names = ["_place", "island"]
    mass, scan = F.col("mz") - F.col("_before") > F.col("_before") * (ppm * 1e-6), F.col("scan") - F.col("_before") > gap
    for i in range(rounds):
        if i:
            rows = cut(rows, ["sample_id", *names], "mz", mass, f"mass_{i}")
            names.append(f"mass_{i}")
        rows = cut(rows, ["sample_id", *names], "scan", scan, f"run_{i}")
        names.append(f"run_{i}")
    return rows, names


def mass_traces(centroids: DataFrame, ppm: float, gap: int = 1, least: int = 3, strong: float = 100.0, rounds: int = ROUNDS) -> DataFrame:
    """sample_id, mz (weighted by intensity), mz_min, mz_max, scan_min, scan_max, rt_min, rt_max, n, scans, intensity, points (rt and summed intensity of each scan) of the traces of
    at least ``least`` scans and as many centroids of an intensity of ``strong``."""
    rows, names = labelled(centroids, ppm, gap, rounds)
    scans = rows.groupBy("sample_id", *names, "scan").agg(
        F.min("rt").alias("rt"), F.sum("intensity").alias("y"), F.sum(F.col("mz") * F.col("intensity")).alias("my"), F.min("mz").alias("low"), F.max("mz").alias("high"), F.count("*").alias("n"), F.count(F.when(F.col("intensity") >= strong, 1)).alias("strong"),
    )
    out = scans.groupBy("sample_id", *names).agg(
        (F.sum("my") / F.nullif(F.sum("y"), F.lit(0.0))).alias("mz"), F.min("low").alias("mz_min"), F.max("high").alias("mz_max"), F.min("scan").alias("scan_min"), F.max("scan").alias("scan_max"), F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"),
        F.sum("n").alias("n"), F.count("*").alias("scans"), F.sum("y").alias("intensity"), F.sum("strong").alias("_strong"), F.array_sort(F.collect_list(F.struct(F.col("rt"), F.col("y").alias("intensity")))).alias("points"),
    )
    return out.where((F.col("scans") >= least) & (F.col("_strong") >= least)).drop("_strong", *names)
