"""mzML as DataFrames, by Spark's XML reader.

Binary arrays are base64 of little-endian floats of 32 or 64 bits, as their parameters say, zlib-compressed or not. An array is found by its
parameter (time, m/z, intensity), or by its place where it has none. Intensities of chromatograms are raised by 50 once, here.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions.signal import INTENSITY_OFFSET
from ..operators import joins

_PARAM = T.ArrayType(T.StructType([T.StructField("_name", T.StringType()), T.StructField("_value", T.StringType()), T.StructField("_unitName", T.StringType())]))
_ARRAYS = T.StructType([T.StructField("binaryDataArray", T.ArrayType(T.StructType([T.StructField("cvParam", _PARAM), T.StructField("binary", T.StringType())])))])
CHROMATOGRAM = T.StructType([T.StructField("_id", T.StringType()), T.StructField("binaryDataArrayList", _ARRAYS)])
_SCANS = T.StructType([T.StructField("scan", T.ArrayType(T.StructType([T.StructField("cvParam", _PARAM)])))])
SPECTRUM = T.StructType([T.StructField("_index", T.LongType()), T.StructField("cvParam", _PARAM), T.StructField("scanList", _SCANS), T.StructField("binaryDataArrayList", _ARRAYS)])
MZML = "*.[mM][zZ][mM][lL]"


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decoded(binary: pd.Series, bits: pd.Series, packed: pd.Series) -> pd.Series:
    def one(b, k, z):
        if b is None:
            return None
        return np.frombuffer(zlib.decompress(b) if z and len(b) else b, "<f4" if k == 32 else "<f8").astype(float)

    return pd.Series([one(*x) for x in zip(binary, bits, packed, strict=True)])


def _has(params: Column, text: str) -> Column:
    return F.coalesce(F.exists(params, lambda p: p["_name"].contains(text)), F.lit(False))


def _array(arrays: Column, name: str, place: int) -> Column:
    """The values of the array with the parameter ``name``, else of the one at ``place``."""
    listed = arrays["binaryDataArray"]
    a = F.coalesce(F.get(F.filter(listed, lambda x: _has(x["cvParam"], name)), 0), F.get(listed, place))
    return decoded(F.unbase64(a["binary"]), F.when(_has(a["cvParam"], "32-bit"), 32).otherwise(64), _has(a["cvParam"], "zlib"))


def _or_empty(values: Column, kind: str) -> Column:
    return F.coalesce(values.cast(kind), F.array().cast(kind))


def _read(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").option("pathGlobFilter", MZML).schema(schema).load(path)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, file, length, modified of the mzML files below ``path``, whatever the case of their suffix; an error if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", MZML).load(path)
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.col("modificationTime").alias("modified")).distinct()
    if files.isEmpty():
        raise FileNotFoundError(f"no mzML files below {path}")
    return files


def chromatograms(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, kind (TIC or SRM), ion_id, win_start, win_end, q1, q3, points. The kinds are those that the id contains, so that one trace may be
    both; SRM traces without times are left out."""
    rows = _read(spark, path, "chromatogram", CHROMATOGRAM)
    arrays, name = F.col("binaryDataArrayList"), F.col("_id")
    kinds = F.array_compact(F.array(F.when(name.contains("TIC"), "TIC"), F.when(name.contains("SRM SIC"), "SRM")))
    rows = rows.where(F.size(kinds) > 0).withColumns({"t": _array(arrays, "time array", 0), "y": _array(arrays, "intensity array", 1)})
    number = lambda k: F.expr(f"try_cast(nullif(regexp_extract(_id, '{k}=([^ ]+)', 1), '') as double)").alias({"start": "win_start", "end": "win_end"}.get(k, k.lower()))
    points = _or_empty(F.zip_with("t", "y", lambda t, y: F.struct(t.alias("rt"), (y + INTENSITY_OFFSET).alias("intensity"))), "array<struct<rt:double,intensity:double>>")
    out = rows.select(names.sample_of_file(F.col("file")).alias("sample_id"), F.explode(kinds).alias("kind"), F.nullif(names.attribute(name, "name"), F.lit("")).alias("ion_id"), number("start"), number("end"), number("Q1"), number("Q3"), points.alias("points"))
    return out.where("kind = 'TIC' or size(points) > 0")


def spectra(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """sample_id, scan, rt (minutes), peaks (mz, intensity) of the spectra of one level; intensities as they are. Spectra without a time are left out;
    those without arrays have no peaks."""
    rows = _read(spark, path, "spectrum", SPECTRUM)
    value = lambda params, text: F.get(F.filter(params, lambda p: p["_name"] == text), 0)
    time = value(F.get(F.col("scanList")["scan"], 0)["cvParam"], "scan start time")
    rt = time["_value"].try_cast("double") / F.when(F.lower(time["_unitName"]).rlike("^s$|second"), 60.0).otherwise(1.0)
    arrays = F.col("binaryDataArrayList")
    rows = rows.where(value(F.col("cvParam"), "ms level")["_value"].try_cast("int") == level).withColumns({"rt": rt, "m": _array(arrays, "m/z array", 0), "y": _array(arrays, "intensity array", 1)})
    sample = F.regexp_replace("file", r"(?i)\.mzml$", "")
    peaks = _or_empty(F.zip_with("m", "y", lambda m, y: F.struct(m.alias("mz"), y.alias("intensity"))), "array<struct<mz:double,intensity:double>>")
    return rows.where("rt is not null").select(sample.alias("sample_id"), F.col("_index").alias("scan"), "rt", peaks.alias("peaks"))


def rt_ranges(spectra: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """sample_id, rt_min, rt_max, scans; an error if one of ``samples`` has no spectrum."""
    out = spectra.groupBy("sample_id").agg(F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"), F.count("*").alias("scans"))
    if samples is not None:
        without = samples.select("sample_id").distinct().join(out, "sample_id", "left_anti").limit(3).collect()
        if without:
            raise ValueError(f"no spectra in {[r[0] for r in without]}")
    return out


def common_range(rows: DataFrame, ranges: DataFrame, rt: str = "rt", edge: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """The rows inside of what all samples cover (``edge`` from either end, exclusive), and the others with that range and the reason."""
    ends = ranges.agg(F.max("rt_min").alias("common_rt_min"), F.min("rt_max").alias("common_rt_max"))
    first = ends.first()
    if first[0] is None or not first[0] < first[1]:
        raise ValueError(f"the samples have no range in common: {tuple(first)}")
    inside = (F.col(rt) > first[0] + edge) & (F.col(rt) < first[1] - edge)
    dropped = rows.where(~F.coalesce(inside, F.lit(False))).withColumns({"common_rt_min": F.lit(first[0]), "common_rt_max": F.lit(first[1]), "drop_reason": F.lit("feature_RT_outside_common_mzML_RT_range")})
    return rows.where(inside), dropped


def first_signal(spectra: DataFrame) -> DataFrame:
    """mz and rt of the strongest peak of the first spectrum that has any, in order of samples and scans."""
    first = spectra.where(F.size("peaks") > 0).orderBy("sample_id", "scan").limit(1)
    top = F.array_max(F.transform("peaks", lambda p, i: F.struct(p["intensity"].alias("intensity"), (-i).alias("i"), p["mz"].alias("mz"))))
    return first.select(top["mz"].alias("mz"), "rt")


def rejected(spectra: DataFrame, features: DataFrame) -> DataFrame:
    """sample_id, rt_min, rt_max, reason of the files that do not cover the times of all features (strictly): no traces are made of them."""
    ends = features.agg(F.min("rt").alias("least"), F.max("rt").alias("most"))
    out = rt_ranges(spectra).join(F.broadcast(ends)).where("least <= rt_min or most >= rt_max")  # one row
    return out.select("sample_id", "rt_min", "rt_max", F.lit("feature_RT_outside_file_RT_range").alias("reason"))


def ion_traces(spectra: DataFrame, features: DataFrame, ppm: float = 10.0, window: float = 2.0) -> DataFrame:
    """sample_id, ion_id, points: for each feature (ion_id, mz, rt) and each scan in its window, the centroid nearest in m/z if within ``ppm``
    (strictly; the lower of two), else 0; raised by 50. Files named by ``rejected`` are to be left out before.

    Peaks and features meet by an equi join on buckets of the logarithm of m/z as wide as the tolerance; scans and features, rows without peaks, on minutes.
    """
    tolerance, half = ppm * 1e-6, window / 2
    width = -float(np.log1p(-tolerance))
    f = features.select("ion_id", F.col("mz").alias("target"), F.col("rt").alias("at"))
    limits = spectra.groupBy("sample_id").agg(F.max("rt").alias("last"))
    scans = spectra.select("sample_id", "scan", F.col("rt").alias("t")).join(limits, "sample_id")
    inside = (F.col("t") >= F.greatest(F.col("at") - half, F.lit(0.0))) & (F.col("t") <= F.least(F.col("at") + half, F.col("last")))
    minutes = F.explode(F.sequence(F.floor(F.greatest(F.col("at") - half, F.lit(0.0))), F.floor(F.col("at") + half)))
    due = scans.withColumn("minute", F.floor("t")).join(f.withColumn("minute", minutes), "minute").where(inside).select("sample_id", "ion_id", "scan", "t")
    bucket = F.floor(F.log("target") / width)
    near = f.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    peaks = spectra.select("sample_id", "scan", F.col("rt").alias("t"), F.inline("peaks")).withColumn("bucket", F.floor(F.log("mz") / width))
    d = F.abs(F.col("mz") - F.col("target"))
    hits = peaks.join(near, "bucket").where((d < F.col("target") * tolerance) & (F.abs(F.col("t") - F.col("at")) <= half + 1e-9))
    hits = hits.groupBy("sample_id", "ion_id", "scan").agg(F.min(F.struct(d.alias("d"), "mz", "intensity"))["intensity"].alias("y"))
    rows = due.join(hits, ["sample_id", "ion_id", "scan"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)) + INTENSITY_OFFSET)
    return rows.groupBy("sample_id", "ion_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("rt"), F.col("y").alias("intensity")))).alias("points"))


def window_traces(spectra: DataFrame, features: DataFrame, low: str = "mz_low", high: str = "mz_high", mode: str = "sum") -> DataFrame:
    """sample_id, ion_id, points: for each feature (ion_id, m/z and time windows, both inclusive) and scan in its time window the sum or maximum of the
    intensities in its m/z window, 0 without any. Centroids and features meet on cells over m/z and time."""
    if mode not in ("sum", "max"):
        raise ValueError(f"mode is sum or max, not {mode}")
    f = features.select("ion_id", F.col(low).alias("low"), F.col(high).alias("high"), "rt_low", "rt_high")
    minutes = F.explode(F.sequence(F.floor(F.greatest("rt_low", F.lit(0.0))), F.floor("rt_high")))
    scans = spectra.select("sample_id", "scan", F.col("rt").alias("t"))
    inside = (F.col("t") >= F.col("rt_low")) & (F.col("t") <= F.col("rt_high"))
    due = scans.withColumn("minute", F.floor("t")).join(f.withColumn("minute", minutes), "minute").where(inside).select("sample_id", "ion_id", "scan", "t")
    peaks = spectra.select("sample_id", "scan", "rt", F.inline("peaks"))
    boxes = f.select("ion_id", F.col("low").alias("mz_low"), F.col("high").alias("mz_high"), "rt_low", "rt_high")
    hits = joins.in_rectangles(peaks, boxes)
    hits = hits.groupBy("sample_id", "ion_id", "scan").agg((F.sum if mode == "sum" else F.max)("intensity").alias("y"))
    rows = due.join(hits, ["sample_id", "ion_id", "scan"], "left").na.fill(0.0, ["y"])
    return rows.groupBy("sample_id", "ion_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("rt"), F.col("y").alias("intensity")))).alias("points"))


def candidates(spectra: DataFrame, true: DataFrame, distance: float = 1.0, most: float = 100_000.0) -> DataFrame:
    """mz, rt, intensity of the centroids that may serve as decoys: finite, of positive m/z, of an intensity from 0 to ``most`` and at least
    ``distance`` from the m/z of every row of ``true``, which must not be empty. With ``sample_id``, ``scan`` and the peak's place in it."""
    if true.isEmpty():
        raise ValueError("there are no true positives")
    peaks = spectra.where("rt >= 0").select("sample_id", "scan", "rt", F.posexplode("peaks").alias("place", "p")).select("sample_id", "scan", "place", "rt", "p.mz", "p.intensity")
    plain = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = peaks.where(plain("rt") & plain("mz") & plain("intensity") & (F.col("mz") > 0) & (F.col("intensity") >= 0) & (F.col("intensity") <= most))
    return joins.away_from(kept, true.select(F.col("mz").alias("true_mz")), "mz", "mz", "true_mz", distance)
