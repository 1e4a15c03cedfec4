"""From signals to the ion-by-sample matrix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, signal
from ..operators import cluster, matrix, refine
from ..sources import samples
from ..sources.stages import Stages
from . import detect

#: Standard deviations between clusters, rt error allowed, and the least maximum of a refound signal, for each mode.
MODES = {"targeted": (0.2, 0.3, refine.LEAST_TARGETED), "untargeted": (0.4, 0.8, refine.LEAST_UNTARGETED)}
STRONG, BASELINE_TARGETED = 500.0, 0.4
#: What is known of a final peak, beside its sample and ion.
KNOWN = ["rt", "rtmin", "rtmax", "area", "height", "width", "baseline", "points", "sn", "sn_2", "sn_3", "sn_5", "class", "min_rt", "max_rt", "lr_diff"]


def detected(signals: DataFrame, stages: Stages, detector: Callable[[DataFrame], DataFrame] = detect.local_maxima, targeted: bool = False) -> DataFrame:
    """Peaks with their properties and signal-to-noise: boxes but class D, as index pairs, adjusted, measured and accepted. Stages keep the expressions of one from being
    written out in the next."""
    c = F.col
    rows = detector(signals.where(F.array_max(signal.intensities(c("points"))) >= STRONG) if targeted else signals).where("box.class <> 3")
    rows = stages.keep("boxes", rows)
    rows = rows.withColumn("b", signal.box_bounds(c("points"), c("box.x_center"), c("box.width"))).withColumn("class", F.element_at(F.array(*map(F.lit, detect.CLASSES)), c("box.class") + 1))
    rows = rows.withColumn("b", kernels.adjusted(signal.intensities(c("points")), c("b.lo"), c("b.hi"), c("class"), c("box.conf"), targeted)).withColumns({"lo": c("b.lo"), "hi": c("b.hi")})
    rows = stages.keep("adjusted", rows)
    rows = signal.with_snr(rows.withColumn("x", signal.peak_properties(c("points"), c("lo"), c("hi"))))
    rules = refine.peak_rules(c("points"), c("lo"), c("hi"), c("snr.sn_5"), c("sample_id").cast("string"), c("class"))
    y = signal.intensities(c("points"))
    # the targeted mode has a baseline of its own, a larger share of the raw signal
    baseline = F.greatest(signal.order_statistic(y, BASELINE_TARGETED), F.lit(1.0)) if targeted else c("snr.baseline")
    peak = F.slice("points", (c("lo") + 1).cast("int"), (c("hi") - c("lo") + 1).cast("int"))
    rows = rows.select(
        "sample_id", "ion_id", "x.*", "snr.sn", baseline.alias("baseline"), "snr.sn_2", "snr.sn_3", "snr.sn_5", "class", c("box.conf").alias("conf"), (c("hi") - c("lo") + 1).cast("long").alias("points"), F.size("points").cast("long").alias("signal_points"),
        F.array_max(y).alias("max_signal"), c("points")[0]["rt"].alias("min_rt"), F.element_at("points", -1)["rt"].alias("max_rt"), signal.lr_diff(peak, not targeted).alias("lr_diff"), *([rules.alias("_rules")] if targeted else []),
    )
    rows = stages.keep("measured", rows)  # before the filter, which would copy all of its expressions
    rows = (rows.where(refine.edge_rules() & c("_rules")).drop("_rules") if targeted else refine.acceptable(rows)).distinct()
    return cluster.class_a_dedup(rows, ["sample_id", "ion_id", "rtmin", "area"]) if not targeted else rows


def matrix_of(peaks: DataFrame, ions: DataFrame, stages: Stages, eps: float, most_error: float | None, targeted: bool = False) -> DataFrame:
    """(ion_id, sample_id, rt, area): of each ion's best cluster, close clusters merged in order of their first peaks, the first peak of each sample.
    ``ions``: ion_id, rt_theory; peaks of other ions are left out in targeted mode, and have no error to be held to otherwise."""
    rows = stages.keep("labelled", cluster.rt_gap_clusters(cluster.in_sequence(peaks, ["sample_id", "rt", "rtmin", "area"]), eps))
    merged = cluster.merge_close(cluster.summaries(rows, seq="seq"), order="first_seq")
    rows = rows.join(merged, ["ion_id", "label"]).drop("label").withColumnRenamed("merged", "label").join(ions, "ion_id", "inner" if targeted else "left")
    rows = stages.keep("merged", rows)
    best = rows.groupBy("ion_id", "label").agg(F.countDistinct("sample_id").alias("n_samples"), F.min("merged_rt").alias("mean_rt"), F.first("rt_theory").alias("rt_theory"))
    best = cluster.select_best(best, F.col("rt_theory"), most_error=most_error)
    kept = rows.join(best.select("ion_id", "label", F.col("mean_rt").alias("cluster_rt")), ["ion_id", "label"])
    return cluster.keep_first(kept, ["ion_id", "sample_id"], ["rt", "rtmin", "area"])


def run(signals: DataFrame, ions: DataFrame, mode: str = "untargeted", detector: Callable[[DataFrame], DataFrame] = detect.local_maxima, most_error: float | None = None, stages: Stages | None = None, chromatography: str = "rp") -> tuple[DataFrame, DataFrame]:
    """The long matrix (ion_id, sample_id, area) and the peaks behind it: detection, clustering, refinding, two corrections, filling.
    ``stages`` keeps what is finished. Clusters far from their ion's theoretical time are cut in reversed-phase runs (``rp``) alone. A targeted run of one sample is neither refound nor
    corrected. Every ion has a cell in every sample: in targeted mode samples of two polarities take a run each (``run_polarities``)."""
    eps, cut, least = MODES[mode]
    most_error = None if chromatography != "rp" else cut if most_error is None else most_error
    targeted, stages = mode == "targeted", stages or Stages(signals.sparkSession)
    signals = stages.keep("signals", signals)
    found = stages.keep("detected", detected(signals, stages, detector, targeted))
    first = stages.keep("clustered", matrix_of(found, ions, stages, eps, most_error, targeted))
    every = matrix.grid(first.select("ion_id").distinct(), signals.select("sample_id").distinct())
    cells = stages.keep("cells", every.join(first.select("ion_id", "sample_id", "area"), ["ion_id", "sample_id"], "left"))
    columns = ["sample_id", "ion_id", *KNOWN]
    peaks = first.select(*columns)
    if not targeted or signals.select("sample_id").distinct().limit(2).count() > 1:
        cells, again = refine.refind_missing(cells, signals, least)
        peaks = stages.keep("refound", peaks.unionByName(again.select(*columns)))
        for i in range(2):
            peaks = stages.keep(f"corrected-{i}", refine.correct(peaks, signals, targeted, least))
    cells = matrix.fill(cells, peaks, ["ion_id", "sample_id"])
    peaks = peaks.join(ions.select("ion_id", "rt_theory").dropDuplicates(["ion_id"]), "ion_id", "left")
    return (matrix.mix_rows(cells), peaks.where("height > 0 and sn > 6")) if targeted else (cells, peaks)


def run_polarities(signals: DataFrame, ions: DataFrame, stages: Stages, **options) -> tuple[DataFrame, DataFrame]:
    """Targeted runs, one for the samples of each polarity, and the matrix of both with samples named without it."""
    done = {name: run(part, ions, "targeted", stages=stages.below(name), **options) for name, part in samples.by_polarity(stages.keep("both", signals)).items() if not part.isEmpty()}
    if not done:
        raise ValueError("there are no signals")
    cells, peaks = zip(*done.values(), strict=True)
    of = dict(zip(done, cells, strict=True))
    none = cells[0].limit(0)
    every = peaks[0] if len(peaks) == 1 else peaks[0].unionByName(peaks[1])
    return samples.both_polarities(of.get("pos", none), of.get("neg", none)), every
