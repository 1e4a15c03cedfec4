"""The detector is a plug-in: signals in, boxes out. Trained weights are not part of this repository.

A detector is a DataFrame function from (sample_id, ion_id, points) to the same rows with ``box``: x_center and width in pixels of an image
of 224, a class (0 to 3) and a confidence, one row for each box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal, wavelets

CLASSES = ["A", "B", "C", "D"]


def _pixel(i: Column) -> Column:
    """Where the point of an index lies in the image of its signal."""
    points = F.col("points")
    first, last = points[0]["rt"], F.element_at(points, -1)["rt"]
    return (F.get(points, i.cast("int"))["rt"] - first) / F.nullif(last - first, F.lit(0.0)) * (signal.BOX_RIGHT - signal.BOX_LEFT) + signal.BOX_LEFT


def wavelet(signals: DataFrame, scales: tuple[float, ...] = wavelets.SCALES, least_snr: float = 3.0) -> DataFrame:
    """Boxes of wavelet peaks (``wavelets.find``): class A from a signal-to-noise of 30 on, B from 10, else C; the confidence is its share of itself and 3."""
    c = F.col
    out = signals.where(F.size("points") >= 5).withColumn("_p", F.explode(wavelets.peaks(signal.intensities(c("points")), scales, least_snr)))
    lo, hi, snr = _pixel(c("_p.lo")), _pixel(c("_p.hi")), c("_p.snr")
    box = F.struct(((lo + hi) / 2).alias("x_center"), (hi - lo).alias("width"), F.when(snr >= 30, 0).when(snr >= 10, 1).otherwise(2).alias("class"), (snr / (snr + 3)).alias("conf"))
    return out.where(lo.isNotNull()).withColumn("box", box).select(*signals.columns, "box")


def local_maxima(signals: DataFrame, share: float = 0.3, reach: int = 3) -> DataFrame:
    """A plain detector: maxima of the smoothed signal of at least ``share`` of its range, as boxes of ``reach`` points to either side. Class A from
    0.9 of the range on, B from 0.6, else C; the confidence is that share. It does not stand for a trained one."""
    c = F.col
    out = signals.where(F.size("points") >= 3).withColumn("_m", signal.smoothed(signal.intensities(c("points"))))
    out = out.withColumns({"_n": F.size("points"), "_low": F.array_min("_m"), "_range": F.array_max("_m") - F.array_min("_m")}).where("_range > 0")
    tops = F.filter(F.sequence(F.lit(1), c("_n") - 2), lambda i: (c("_m")[i] > c("_m")[i - 1]) & (c("_m")[i] >= c("_m")[i + 1]) & (c("_m")[i] - c("_low") >= share * c("_range")))
    out = out.withColumn("_i", F.explode(F.when(c("_n") > 2, tops)))
    lo, hi = _pixel(F.greatest(c("_i") - reach, F.lit(0))), _pixel(F.least(c("_i") + reach, c("_n") - 1))
    conf = (c("_m")[c("_i")] - c("_low")) / c("_range")
    box = F.struct(((lo + hi) / 2).alias("x_center"), (hi - lo).alias("width"), F.when(conf >= 0.9, 0).when(conf >= 0.6, 1).otherwise(2).alias("class"), conf.alias("conf"))
    return out.where(lo.isNotNull()).withColumn("box", box).select(*signals.columns, "box")
