"""Discovery of features without a given list: mass traces, wavelet peaks, grouping, alignment, grouping anew, and filling on the raw spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal, wavelets
from ..operators import alignment, groups, joins, traces
from ..sources.stages import Stages

#: Defaults of the command line. Widths in seconds; ``prefilter``: scans of a trace, with as many centroids of the intensity ``noise``.
PPM, LEAST_WIDTH, MOST_WIDTH, SNR, NOISE, MZ_DIFF, PREFILTER, FRACTION, BANDWIDTH = 10.0, 5.0, 50.0, 5.0, 100.0, 0.015, 3, 0.5, 30.0


def picked(centroids: DataFrame, ppm: float = PPM, least_width: float = LEAST_WIDTH, most_width: float = MOST_WIDTH, snr: float = SNR, noise: float = NOISE, mz_diff: float = MZ_DIFF, prefilter: int = PREFILTER) -> DataFrame:
    """peak_id, sample_id, mz, mz_min, mz_max, rt, rt_min, rt_max (minutes), area, height, snr: the wavelet peaks of all mass traces of centroids (sample_id, scan, rt, mz,
    intensity), of a width within the bounds. Of peaks of a sample whose masses differ by less than ``mz_diff`` and whose apexes share a scan the strongest stays."""
    found = traces.mass_traces(centroids, ppm, least=prefilter, strong=noise)
    found = found.withColumn("p", F.explode(wavelets.peaks(signal.intensities(F.col("points")), least_snr=snr)))
    part = F.slice("points", F.col("p.lo") + 1, F.col("p.hi") - F.col("p.lo") + 1)
    rows = found.select(
        "sample_id", "mz", "mz_min", "mz_max", F.get("points", F.col("p.apex"))["rt"].alias("rt"), F.get("points", F.col("p.lo"))["rt"].alias("rt_min"), F.get("points", F.col("p.hi"))["rt"].alias("rt_max"), signal.peak_area(part).alias("area"),
        F.get("points", F.col("p.apex"))["intensity"].alias("height"), F.col("p.snr").alias("snr"),
    )
    width = (F.col("rt_max") - F.col("rt_min")) * 60
    rows = rows.where((width >= least_width) & (width <= most_width))
    rows = traces.cut(rows, ["sample_id", "rt"], "mz", F.col("mz") - F.col("_before") >= mz_diff, "_near")
    best = F.max(F.struct("height", "snr", "mz", "area", "rt_min", "rt_max", "mz_min", "mz_max")).alias("x")
    rows = rows.groupBy("sample_id", "rt", "_near").agg(best).select("sample_id", "rt", "x.*")
    return rows.withColumn("peak_id", F.concat_ws("@", "sample_id", F.format_string("%.5f", "mz"), F.format_string("%.4f", "rt")))


def mass_keys(peaks: DataFrame, ppm: float = PPM) -> DataFrame:
    """``peaks`` with ``ion_id``: the run of masses, of all samples together, that each is part of, named by its lowest one."""
    return traces.mass_islands(peaks.withColumn("_all", F.lit(0)), ppm, "_all", "mz", "_mass").withColumn("ion_id", F.format_string("M%.4f", "_mass")).drop("_all", "_mass")


def discover(spectra: DataFrame, stages: Stages, samples: DataFrame | None = None, ppm: float = PPM, bandwidth: float = BANDWIDTH, fraction: float = FRACTION, cell: float = alignment.CELL, **picking) -> tuple[DataFrame, DataFrame]:
    """(features, cells). ``spectra``: sample_id, scan, rt (minutes), peaks. ``samples``: sample_id and grp, one group without it. Features have
    median masses and times (aligned, in seconds) and their peaks; cells are feature_id, sample_id, area and ``filled``, integrated on the raw centroids where a sample has no peak."""
    centroids = spectra.select("sample_id", "scan", "rt", F.inline("peaks"))
    peaks = stages.keep("picked", picked(centroids, ppm, **picking))
    samples = stages.keep("samples", samples if samples is not None else spectra.select("sample_id").distinct().withColumn("grp", F.lit("all")))
    keyed = stages.keep("keyed", mass_keys(peaks, ppm))
    warps = stages.keep("warps", alignment.warps(centroids, alignment.centre_of(spectra), cell))
    moved = stages.keep("aligned", alignment.aligned(keyed, warps, cell))
    assigned = stages.keep("grouped", groups.density_groups(moved.withColumn("rt", F.col("rt") * 60), bandwidth, samples, fraction))
    n = samples.select("sample_id").distinct().count()
    features = stages.keep("features", groups.features(assigned.where("group_source = 'density_group'"), n))
    return features, stages.keep("filled", filled(features, assigned, keyed, centroids, samples))


def filled(features: DataFrame, assigned: DataFrame, peaks: DataFrame, centroids: DataFrame, samples: DataFrame) -> DataFrame:
    """feature_id, sample_id, area, filled: of each feature and sample the largest peak's area, or where there is none the integral of the centroids in the feature's rectangle (the
    extremes of its peaks' masses and of their own times); null where no centroid lies there."""
    own = assigned.select("feature_id", "peak_id").join(features.select("feature_id"), "feature_id", "left_semi").join(peaks, "peak_id")
    box = own.groupBy("feature_id").agg(F.min("mz_min").alias("mz_low"), F.max("mz_max").alias("mz_high"), F.min("rt_min").alias("rt_low"), F.max("rt_max").alias("rt_high"))
    area = own.groupBy("feature_id", "sample_id").agg(F.max("area").alias("area"))
    listed = samples.agg(F.array_sort(F.collect_set("sample_id")).alias("_all"))  # of one study
    cells = box.join(F.broadcast(listed)).withColumn("sample_id", F.explode("_all")).drop("_all").join(area, ["feature_id", "sample_id"], "left")
    missing = cells.where("area is null").drop("area")
    scans = joins.in_rectangles(centroids, missing, by=["sample_id"]).groupBy("feature_id", "sample_id", "rt").agg(F.sum("intensity").alias("intensity"))
    points = F.array_sort(F.collect_list(F.struct("rt", "intensity")))
    again = scans.groupBy("feature_id", "sample_id").agg(signal.peak_area(points).alias("again"))
    out = cells.join(again, ["feature_id", "sample_id"], "left")
    return out.select("feature_id", "sample_id", F.coalesce("area", "again").alias("area"), F.col("area").isNull().alias("filled"))


def peak_list(features: DataFrame) -> DataFrame:
    """Compound Name, mz and RT (minutes), as the untargeted pipeline reads them."""
    return features.select(F.col("feature_id").alias("Compound Name"), F.col("mzmed").alias("mz"), F.col("rtmed_min").alias("RT"))
