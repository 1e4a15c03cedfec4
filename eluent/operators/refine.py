"""Refinding missing peaks and correcting inconsistent ones.

The window is the apex of the whole signal and five points to either side; its area is the plain sum of intensities. All signal-to-noise values of such
peaks are 10 by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal
from . import matrix

LEAST_POINTS, REACH, SN = 10, 5, 10.0
LEAST_TARGETED, LEAST_UNTARGETED = 500.0, 100.0


def refound(signals: DataFrame, least: float = LEAST_UNTARGETED, peak_class: Column | None = None) -> DataFrame:
    """A peak for each signal (sample_id, ion_id, points) of at least 10 points and maximum ``least``."""
    y = signal.intensities(F.col("points"))
    strong = signals.where((F.size("points") >= LEAST_POINTS) & (F.array_max(y) >= least))
    rows = strong.withColumns({"win": signal.around_apex(F.col("points"), REACH), "baseline": F.array_min(y), "apex": signal.apex_index(F.col("points"))})
    w = signal.intensities(F.col("win"))
    return rows.select(
        "sample_id", "ion_id", F.get("points", (F.col("apex") - 1).cast("int"))["rt"].alias("rt"), F.col("win")[0]["rt"].alias("rtmin"), F.element_at("win", -1)["rt"].alias("rtmax"),
        F.aggregate(w, F.lit(0.0), lambda a, b: a + b).alias("area"), (F.array_max(w) - F.array_min(w)).alias("height"), "baseline", F.size("win").cast("long").alias("points"),
        F.lit(SN).alias("sn"), (F.lit("D") if peak_class is None else peak_class).alias("class"),
        *(F.lit(SN).alias(c) for c in ("sn_2", "sn_3", "sn_5")), (F.element_at("win", -1)["rt"] - F.col("win")[0]["rt"]).alias("width"),
        F.col("points")[0]["rt"].alias("min_rt"), F.element_at("points", -1)["rt"].alias("max_rt"), signal.lr_diff(F.col("win"), False).alias("lr_diff"),
    )


def anomalies(peaks: DataFrame, off: float = 0.05, by_median: bool = True, key: str = "ion_id") -> DataFrame:
    """``peaks`` with ``anomaly``: rtmin or rtmax further than ``off`` from the ion's. The ion's is the
    median of each, or the quantile 0.3 of rtmin and 0.7 of rtmax."""
    by = Window.partitionBy(key)
    places = {"rtmin": 0.5, "rtmax": 0.5} if by_median else {"rtmin": 0.3, "rtmax": 0.7}
    wrong = [F.abs(F.col(c) - F.percentile(c, q).over(by)) > off for c, q in places.items()]
    return peaks.withColumn("anomaly", wrong[0] | wrong[1])


def refind_missing(cells: DataFrame, signals: DataFrame, least: float = LEAST_UNTARGETED) -> tuple[DataFrame, DataFrame]:
    """Cells with missing ones filled where the signal has a peak, and those peaks."""
    gaps = cells.where("area is null").select("sample_id", "ion_id")
    found = refound(signals.join(gaps, ["sample_id", "ion_id"], "left_semi"), least)
    return matrix.upsert(cells, found, ["ion_id", "sample_id"], ["area"]), found


def correct(peaks: DataFrame, signals: DataFrame, anomalies_only: bool, least: float = LEAST_UNTARGETED) -> DataFrame:
    """``peaks`` with those to correct (anomalies, or all) replaced by the window of their signal; they keep their class."""
    marked = anomalies(peaks) if anomalies_only else peaks.withColumn("anomaly", F.lit(True))
    todo = marked.where("anomaly").select("sample_id", "ion_id", F.col("class").alias("_class"))
    new = refound(signals.join(todo, ["sample_id", "ion_id"]), least, F.col("_class"))
    values = [c for c in peaks.columns if c not in ("sample_id", "ion_id") and c in new.columns]
    rest = [c for c in peaks.columns if c not in ("sample_id", "ion_id", *values)]
    out = matrix.upsert(peaks, new, ["sample_id", "ion_id"], values)
    return out.join(peaks.select("sample_id", "ion_id", *rest), ["sample_id", "ion_id"], "left") if rest else out


def correct_twice(peaks: DataFrame, signals: DataFrame, anomalies_only: bool, least: float = LEAST_UNTARGETED) -> DataFrame:
    return correct(correct(peaks, signals, anomalies_only, least), signals, anomalies_only, least)


def acceptable(peaks: DataFrame) -> DataFrame:
    """Untargeted acceptance: sn >= 5, sn_2 >= 2, and sn >= 6 or sn_5 >= 1.5."""
    return peaks.where("sn >= 5 and (sn >= 6 or sn_5 >= 1.5) and sn_2 >= 2")


def edge_rules(area: str = "area", points: str = "points") -> Column:
    """Targeted acceptance but for ``peak_rules``."""
    return (F.col(area) >= 1000) & (F.col(points) >= 3)


def peak_rules(points: Column, lo: Column, hi: Column, sn_5: Column, sample: Column, peak_class: Column) -> Column:
    """The rest of targeted acceptance, of the peak from ``lo`` to ``hi`` (0-based, inclusive). A peak of a ``mix`` sample is not one that
    leans on an edge of its signal, spans a tenth of it at most, or is weak; a class A or B peak of another sample is not weak, narrow and flat."""
    y = signal.intensities(points)
    p = F.slice(y, (lo + 1).cast("int"), (hi - lo + 1).cast("int"))
    n, first, last, top, low = F.size(points), F.element_at(p, 1), F.element_at(p, -1), F.array_max(p), F.array_min(p)
    rt = lambda i: F.get(points, i.cast("int"))["rt"]
    flat = F.greatest(signal.order_statistic(y, 0.4), F.lit(1.0)) == 50
    leans = ((lo <= 1) & (first - last >= 0.1 * (top - low))) | ((hi >= n - 2) & (last - first >= 0.1 * (top - low)))
    small = (top - low) <= 0.1 * (F.array_max(y) - F.array_min(y))
    mix = sample.contains("mix")
    bad_mix = mix & (leans | small | ((top <= 5000) & flat & (sn_5 <= 1.5)))
    weak = (top <= 5000) & (rt(hi) - rt(lo) <= 0.15) & (hi - lo + 1 < 6) & (low == 50) & (sn_5 < 2) & (first == last) & flat
    return ~bad_mix & ~(peak_class.isin("A", "B") & weak & ~mix)
