"""Clustering of peaks by retention time, and keep-first rules. Peaks are rows (sample_id, ion_id, rt, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def rt_gap_clusters(peaks: DataFrame, eps: float, key: str = "ion_id", rt: str = "rt") -> DataFrame:
    """``peaks`` with ``label``: within a key, a new cluster begins where the gap to the next smaller rt is over ``eps`` population
    deviations (one that is 0 counts as 1). Equal to density clustering in one dimension with single points allowed."""
    by = Window.partitionBy(key)
    sd = F.stddev_pop(rt).over(by)
    gap = F.col(rt) - F.lag(rt).over(by.orderBy(rt))
    out = peaks.withColumn("_cut", (gap > eps * F.when(sd == 0, F.lit(1.0)).otherwise(sd)).cast("int"))
    return out.withColumn("label", F.coalesce(F.sum("_cut").over(by.orderBy(rt).rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long")).drop("_cut")


def summaries(labelled: DataFrame, key: str = "ion_id", seq: str | None = None) -> DataFrame:
    """A row for each cluster: n_peaks, n_samples, mean_rt, rt_min, rt_max; and first_seq, its smallest ``seq``, where peaks have such a number."""
    first = [F.min(seq).alias("first_seq")] if seq else []
    return labelled.groupBy(key, "label").agg(F.count("*").alias("n_peaks"), F.countDistinct("sample_id").alias("n_samples"), F.avg("rt").alias("mean_rt"), F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"), *first)


def in_sequence(peaks: DataFrame, order: list[Column | str], key: str = "ion_id") -> DataFrame:
    """``peaks`` with ``seq``, their place among those of their key."""
    return ranks.dealt(peaks, key).withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def merged_labels(labels: list, means: list[float], close: float) -> list[tuple]:
    """(label, new label, new mean): pairs of means within ``close`` are merged in order of the first and then the second. A merge gives
    what carries the later cluster's original label and mean those of the earlier, so that chains do not close."""
    label_of, mean_of = list(labels), list(means)
    for i in range(len(means)):
        for j in range(i + 1, len(means)):
            if abs(means[i] - means[j]) <= close:
                label_of = [labels[i] if x == labels[j] else x for x in label_of]
                mean_of = [means[i] if x == means[j] else x for x in mean_of]
    return list(zip(labels, label_of, mean_of, strict=True))


def merge_close(clusters: DataFrame, close: float = 0.04, key: str = "ion_id", order: str = "label") -> DataFrame:
    """key, label, merged, merged_rt; clusters of a key are met in the order of ``order``, which is that of first appearance with ``first_seq``. A key has
    few clusters; its row of them is one of many in an Arrow batch."""

    @F.pandas_udf("merged array<long>, merged_rt array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for labels, means in batches:
            rows = [merged_labels(a.tolist(), b.tolist(), close) for a, b in zip(labels, means, strict=True)]
            yield pd.DataFrame({"merged": pd.Series([[r[1] for r in x] for x in rows], dtype=object), "merged_rt": pd.Series([[r[2] for r in x] for x in rows], dtype=object)})

    own = clusters.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), F.col("label").cast("long").alias("label"), "mean_rt"))).alias("_c"))
    rows = own.select(key, F.col("_c.label").alias("label"), run(F.col("_c.label"), F.col("_c.mean_rt")).alias("m"))
    return rows.select(key, F.inline(F.arrays_zip("label", F.col("m.merged").alias("merged"), F.col("m.merged_rt").alias("merged_rt"))))


def select_best(clusters: DataFrame, theory: Column, key: str = "ion_id", most_error: float | None = None, epsilon: float = 1e-6) -> DataFrame:
    """The best cluster of each key: 0.3 for its share of the most samples, 0.7 for a small rt error; the smaller label of equals.
    ``epsilon`` is added to the largest error; with 0, one of 0 counts as 1. Errors over ``most_error`` are cut before."""
    out = clusters.withColumn("rt_error", F.abs(F.col("mean_rt") - theory))
    if most_error is not None:
        out = out.where(F.col("rt_error") <= most_error)
    by = Window.partitionBy(key)
    worst = F.max("rt_error").over(by)
    worst = worst + epsilon if epsilon else F.when(worst == 0, F.lit(1.0)).otherwise(worst)
    out = out.withColumn("score", 0.3 * F.col("n_samples") / F.max("n_samples").over(by) + 0.7 * (1 - F.col("rt_error") / worst))
    best = F.row_number().over(by.orderBy(F.desc("score"), "label"))
    return out.withColumn("_best", best).where("_best = 1").drop("_best")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first in ``order``, which must tell rows apart."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")


def class_a_dedup(peaks: DataFrame, order: list[Column | str], keys: tuple[str, ...] = ("rt",)) -> DataFrame:
    """Of class A peaks with equal ``keys``, whatever their sample or ion, the narrowest; other classes stay."""
    return keep_first(peaks.where("class = 'A'"), list(keys), ["width", *order]).unionByName(peaks.where("class <> 'A' or class is null"))


def best_peak(peaks: DataFrame, keys: list[str], tie: list[Column | str]) -> DataFrame:
    """The peak of the largest area, then the better class, the higher confidence, the smaller rt distance."""
    rank = F.when(F.col("class") == "A", 1).when(F.col("class") == "B", 2).when(F.col("class") == "C", 3).otherwise(4)
    return keep_first(peaks, keys, [F.desc("area"), rank, F.desc("conf"), F.col("rt_distance"), *tie])


def used_flags(peaks: DataFrame, used: DataFrame, peak_key: list[str], cell: list[str]) -> DataFrame:
    """``used_in_matrix`` and ``duplicate_within_feature_sample``."""
    mark = used.select(*peak_key, F.lit(True).alias("_used"))
    out = peaks.join(mark, peak_key, "left").withColumn("used_in_matrix", F.coalesce("_used", F.lit(False))).drop("_used")
    return out.withColumn("duplicate_within_feature_sample", F.count("*").over(Window.partitionBy(*cell)) > 1)
