"""Grouping of peaks across samples by the density of their times.

The density is a Gaussian kernel over counts in cells of a quarter of its bandwidth, with whole-number weights, so that it is exact. It is worked out for many ions at a time from
their cells, which are as many as a run is long. Cells between two valleys are one region; a region with peaks in enough samples of one group is a feature, any other peak a feature of
its own. Peaks are dealt once, by ion; what an ion's cells and regions tell comes back as one row for each ion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

STEPS, REACH = 4, 16
#: exp(-x^2 / 2) at quarters of the bandwidth, in millionths.
WEIGHTS = [round(1_000_000 * math.exp(-0.5 * (k / STEPS) ** 2)) for k in range(-REACH, REACH + 1)]


def valleys(ion: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(place of the ion, cell) of each cell where a region begins, but the first of an ion, from occupied cells ordered by ion and cell."""
    if not len(ion):
        return np.zeros((0, 2), dtype=np.int64)
    other = np.diff(ion, prepend=ion[0] - 1) != 0
    begins = other | (np.diff(cell, prepend=cell[0]) > 2 * REACH + 1)  # stretches of cells within reach of a peak
    stretch = np.cumsum(begins) - 1
    first, last = cell[begins], cell[np.append(begins[1:], True)]
    start = np.concatenate([[0], np.cumsum(last - first + 2 * REACH + 1)])
    at = start[stretch] + cell - first[stretch] + REACH
    density = np.zeros(start[-1], dtype=np.int64)
    for k, w in zip(range(-REACH, REACH + 1), WEIGHTS, strict=True):
        density[at + k] += n * w  # each cell once
    step = np.sign(np.diff(density, prepend=0))
    step[start[:-1]] = 0
    place = np.arange(len(density))
    turn = np.maximum.accumulate(np.where(step != 0, place, 0))
    was = np.concatenate([[0], step[turn[:-1]]])
    head = np.repeat(start[:-1], np.diff(start))
    was[np.concatenate([[0], turn[:-1]]) < head] = 0  # a stretch begins anew
    cut = (step > 0) & (was < 0)
    cut[start[:-1]] = ~other[begins]
    where = np.flatnonzero(cut)
    s = np.searchsorted(start, where, side="right") - 1
    return np.column_stack([ion[begins][s], first[s] - REACH + where - start[s]])


def regions(peaks: DataFrame, bandwidth: float, key: str = "ion_id", rt: str = "rt") -> DataFrame:
    """key, cuts, peaks: the cells where regions of an ion begin, but its first, and the number of its peaks."""
    cell = F.floor(F.col(rt) / (bandwidth / STEPS))
    counts = peaks.where(F.col(rt).isNotNull()).groupBy(key, cell.alias("cell")).agg(F.count("*").alias("n"))
    cells = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("_cells"))

    @F.pandas_udf("array<long>")
    def cuts(cell: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for c, n in cell:
            ion = np.repeat(np.arange(len(c)), c.map(len)) if len(c) else np.zeros(0, dtype=np.int64)
            flat = lambda x: np.concatenate([*x.tolist(), np.zeros(0, dtype=np.int64)]).astype(np.int64)
            found = valleys(ion, flat(c), flat(n))
            ends = np.searchsorted(found[:, 0], np.arange(len(c) + 1))
            yield pd.Series([found[a:b, 1] for a, b in zip(ends, ends[1:], strict=False)], dtype=object)

    return cells.select(key, cuts(F.col("_cells.cell"), F.col("_cells.n")).alias("cuts"), F.aggregate("_cells.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("peaks"))


def density_groups(peaks: DataFrame, bandwidth: float, samples: DataFrame, min_fraction: float = 0.5, min_samples: int = 1, key: str = "ion_id") -> DataFrame:
    """``peaks`` (peak_id, key, sample_id, rt) with ``feature_id``, ``<key>__G`` and a number of three digits in order of the features' median times (groups before single peaks), and
    ``group_source``. ``samples``: sample_id and grp; a region needs peaks in ``min_fraction`` of a group's samples, at least ``min_samples``. An ion of one peak is a feature as it is."""
    cell = F.floor(F.col("rt") / (bandwidth / STEPS))
    dealt = ranks.dealt(peaks.where(F.col("rt").isNotNull() & F.col(key).isNotNull()), key)
    rows = dealt.join(regions(dealt, bandwidth, key), key)
    rows = rows.withColumn("region", F.size(F.filter("cuts", lambda x: x <= cell))).withColumn("_alone", F.col("peaks") == 1).select(*peaks.columns, "region", "_alone")
    sizes = samples.groupBy("grp").agg(F.countDistinct("sample_id").alias("_size"))
    held = rows.select(key, "region", "sample_id").distinct().join(F.broadcast(samples), "sample_id").groupBy(key, "region", "grp").agg(F.count("*").alias("_n")).join(F.broadcast(sizes), "grp")  # of one study
    enough = held.where((F.col("_n") >= F.col("_size") * min_fraction) & (F.col("_n") >= min_samples)).groupBy(key).agg(F.collect_set("region").alias("_enough"))
    rows = rows.join(enough, key, "left").withColumn("_group", F.coalesce(F.array_contains("_enough", F.col("region")), F.lit(False)) & ~F.col("_alone")).drop("_enough")
    rows = rows.withColumn("_own", F.when(~F.col("_group"), F.col("peak_id")))
    place = Window.partitionBy(key, "region", "_group", "_own")
    rows = rows.withColumns({"_i": F.row_number().over(place.orderBy("rt")), "_n": F.count("*").over(place)})
    middle = F.when((2 * F.col("_i") - F.col("_n") >= 0) & (2 * F.col("_i") - F.col("_n") <= 2) & ((F.col("_n") % 2 == 0) | (2 * F.col("_i") == F.col("_n") + 1)), F.col("rt"))
    rows = rows.withColumn("_at", F.avg(middle).over(place))  # the median
    number = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("_group"), "_at", "region", "_own"))
    source = F.when(F.col("_group"), "density_group").when(F.col("_alone"), "manual_singleton").otherwise("unassigned_singleton")
    return rows.select(*peaks.columns, F.concat(F.col(key).cast("string"), F.lit("__G"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))).alias("feature_id"), source.alias("group_source"))


def _median(values: Column) -> Column:
    """Of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def features(assigned: DataFrame, n_samples: int, key: str = "ion_id") -> DataFrame:
    """A row for each feature of ``assigned`` (feature_id, key, group_source, peak_id, sample_id, mz, rt in seconds): medians and extremes of mass and time, also in minutes, numbers of peaks and
    samples, the share of samples without, and the ids of its peaks and samples."""
    own = assigned.groupBy("feature_id", key, "group_source").agg(F.collect_list(F.struct("mz", "rt", F.col("peak_id").cast("string").alias("peak_id"), F.col("sample_id").cast("string").alias("sample_id"))).alias("_p"))
    there = lambda c: F.filter(F.col(f"_p.{c}"), lambda x: x.isNotNull())
    own = own.withColumns({"_mz": F.sort_array(there("mz")), "_rt": F.sort_array(there("rt")), "_peaks": F.sort_array(F.array_distinct(there("peak_id"))), "_samples": F.sort_array(F.array_distinct(there("sample_id")))})
    parts = (("med", _median), ("min", F.array_min), ("max", F.array_max))
    found = F.size("_samples").cast("long")
    return own.select(
        "feature_id", key, "group_source", *(f(F.col(f"_{c}")).alias(c + name) for c in ("mz", "rt") for name, f in parts), *((f(F.col("_rt")) / 60).alias(f"rt{name}_min") for name, f in parts),
        F.size("_p").cast("long").alias("npeaks"), found.alias("n_detected"), (1 - found / n_samples).alias("missing_rate"), F.array_join("_peaks", ";").alias("peak_ids"), F.array_join("_samples", ";").alias("sample_ids"),
    )
