"""Tables of an external peak picker as peak list and result table, and the way back to its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import cluster
from . import tables

# The columns of each table, and those of the result table that a picked peak has no value for.
REQUIRED = {"features": ["feature_id", "mzmed", "rtmed", "rtmin", "rtmax"], "peaks": ["peak_index", "sampleID", "mz", "rt", "rtmin", "rtmax", "into"], "assignments": ["feature_id", "peak_index"]}
FILLED = {"sn_2": 0.0, "sn_3": 0.0, "sn_5": 0.0, "points": 0, "signal_points": 0, "class": "A", "conf": 1.0, "lr_diff": 0.0}
NEEDED = ["sampleID", "mw ID", "mz", "rt", "rtmin", "rtmax", "area", "int"]


def read(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The tables features, peaks and assignments, or an error where columns are missing or a table is empty."""
    out = {}
    for name, columns in REQUIRED.items():
        df = tables.read(spark, paths[name])
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lack the columns {missing}")
        if df.isEmpty():
            raise ValueError(f"{name} have no rows")
        out[name] = df
    return out


def checked(features: DataFrame) -> DataFrame:
    """``features``, or an error where m/z or times are not finite, m/z not above 0, or windows reversed."""
    number = lambda c: stats.finite(stats.number(F.col(c)))
    bad = number("mzmed").isNull() | number("rtmed").isNull() | (number("mzmed") <= 0) | F.coalesce(number("rtmin") > number("rtmax"), F.lit(False))
    if {"mzmin", "mzmax"} <= set(features.columns):
        bad = bad | F.coalesce(number("mzmin") > number("mzmax"), F.lit(False))
    odd = features.where(bad).select("feature_id").limit(3).collect()
    if odd:
        raise ValueError(f"features with values out of their domain: {[r[0] for r in odd]}")
    return features


def peak_list(features: DataFrame) -> DataFrame:
    """Compound Name, mz, RT (minutes) of features (feature_id, mzmed, rtmed in seconds); rows without numbers are left out, an error if none is left."""
    rows = features.select(F.col("feature_id").cast("string").alias("Compound Name"), stats.number(F.col("mzmed")).alias("mz"), (stats.number(F.col("rtmed")) / 60).alias("RT")).dropna()
    if rows.isEmpty():
        raise ValueError("no valid features are left")
    return rows


def _of(df: DataFrame, column: str, default: float | None = 0.0) -> Column:
    """A column as numbers, or the default where the table has none."""
    return stats.number(F.col(column), default) if column in df.columns else F.lit(default).cast("double")


def result_table(features: DataFrame, peaks: DataFrame, assignments: DataFrame) -> DataFrame:
    """A row for each feature and sample: assignments with their peaks (inner) and features (left), times in minutes, the height or where it is missing the
    area as intensity; infinite values are null, rows that lack needed values or have reversed bounds are left out, and of several peaks of one
    cell the one of the largest area, then signal-to-noise stays. The sample is the peak's; an error if no row is left."""
    named = peaks.select("peak_index", *(c for c in peaks.columns if c == "sampleID" or c not in assignments.columns))
    assignments = assignments.drop("sampleID")
    window = features.select("feature_id", *(F.col(c).alias(f"_f_{c}") for c in ("rtmed", "rtmin", "rtmax")))
    rows = assignments.join(named, "peak_index").join(window, "feature_id", "left")
    minutes = lambda c: _of(rows, c) / 60
    area = _of(rows, "into")
    values = {
        "mz": _of(rows, "mz"), "rt": minutes("rt"), "rtmin": minutes("rtmin"), "rtmax": minutes("rtmax"), "Width": minutes("rtmax") - minutes("rtmin"), "int": F.coalesce(_of(rows, "maxo", None), area), "area": area,
        "sn": _of(rows, "sn"), "baseline": _of(rows, "intb"), "min_rt": minutes("_f_rtmin"), "max_rt": minutes("_f_rtmax"), "rt_theoretic": minutes("_f_rtmed"),
    }
    out = rows.select(F.col("sampleID").cast("string").alias("sampleID"), F.col("feature_id").cast("string").alias("mw ID"), *(stats.finite(v).alias(k) for k, v in values.items()), *(F.lit(v).alias(k) for k, v in FILLED.items()), F.col("peak_index").alias("_i"))
    out = out.dropna(subset=NEEDED).where("rtmin <= rtmax")
    out = cluster.keep_first(out, ["`mw ID`", "sampleID"], [F.desc("area"), F.desc("sn"), F.col("_i")]).drop("_i")
    if out.isEmpty():
        raise ValueError("no assigned peak has all the values that are needed")
    return out


def feature_rows(assigned: DataFrame, samples: int) -> DataFrame:
    """feature_id, medians and extremes of m/z and times, npeaks, n_detected samples, missing_rate and the peaks' ids, from (feature_id, peak_index, sampleID, mz, rt)."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("peak_index")), lambda x: x.cast("string")), ";")
    found = F.countDistinct("sampleID")
    return assigned.groupBy("feature_id").agg(
        F.median("mz").alias("mzmed"), F.min("mz").alias("mzmin"), F.max("mz").alias("mzmax"), F.median("rt").alias("rtmed"), F.min("rt").alias("rtmin"), F.max("rt").alias("rtmax"),
        F.count("*").alias("npeaks"), found.alias("n_detected"), (1 - found / samples).alias("missing_rate"), ids.alias("peak_ids"),
    )


def all_ions(peaks: DataFrame) -> DataFrame:
    """RT (min) and mw ID of a peak list, as the ion table lists them."""
    return peaks.select(F.col("RT").alias("RT (min)"), F.col("`Compound Name`").alias("mw ID"))


def intensities(picked: DataFrame, key: str = ".mzML") -> DataFrame:
    """mz, rt, rt_start, rt_end (minutes) and the columns of samples (those whose name holds ``key``) of a picker's wide list; missing intensities are 0."""
    samples = [c for c in picked.columns if key in c]
    return picked.select(F.col("mzmed").alias("mz"), (F.col("rtmed") / 60).alias("rt"), (F.col("rtmin") / 60).alias("rt_start"), (F.col("rtmax") / 60).alias("rt_end"), *(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in samples))
