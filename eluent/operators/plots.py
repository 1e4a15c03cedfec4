"""Tables that figures are drawn from: exact distribution curves, traces as thin as their pixels, and what is filled below a peak."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from . import ranks


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, share: the vertices of each group's distribution curve, the share of its values up to each. Ranks are counted by range partitions, so that no task holds a group."""
    ranked = ranks.with_group_rank(rows.where(F.col(value).isNotNull()).select(*by, value), by, [F.col(value)], "_rank")
    sizes = ranked.groupBy(*by).agg(F.max("_rank").alias("_n"))
    out = ranked.groupBy(*by, value).agg(F.max("_rank").alias("_rank")).join(sizes, by)
    return out.select(*by, value, (F.col("_rank") / F.col("_n")).alias("share"))


def thinned(signals: DataFrame, pixels: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """sample_id, ion_id, pixel, place, rt, intensity: of each of ``pixels`` equal parts of a trace (or of the times from ``low`` to ``high``) the first, the last, the lowest and
    the highest point, each once: drawn as a line they look as all do."""
    rows = signals.select("sample_id", "ion_id", F.col("points")[0]["rt"].alias("a"), F.element_at("points", -1)["rt"].alias("b"), F.posexplode("points").alias("place", "p"))
    a, b = (F.col("a") if low is None else F.lit(float(low))), (F.col("b") if high is None else F.lit(float(high)))
    rows = rows.select("sample_id", "ion_id", "place", "p.*", a.alias("a"), b.alias("b")).where("rt >= a and rt <= b")
    pixel = F.least(F.floor(F.coalesce(F.try_divide(F.col("rt") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0)) * pixels), F.lit(pixels - 1)).cast("int")
    point = F.struct("place", "rt", "intensity")
    kept = rows.withColumn("pixel", pixel).groupBy("sample_id", "ion_id", "pixel").agg(
        F.min(point).alias("first"), F.max(point).alias("last"), F.min(F.struct("intensity", "place", "rt")).alias("lowest"), F.max(F.struct("intensity", (-F.col("place")).alias("back"), "rt")).alias("highest"),
    )
    every = F.array_distinct(F.array("first", "last", F.struct("lowest.place", "lowest.rt", "lowest.intensity"), F.struct((-F.col("highest.back")).alias("place"), "highest.rt", "highest.intensity")))
    return kept.select("sample_id", "ion_id", "pixel", F.explode(every).alias("x")).select("sample_id", "ion_id", "pixel", "x.*")


def fills(signals: DataFrame, peaks: DataFrame) -> DataFrame:
    """sample_id, ion_id, points, fill_lo_idx, fill_hi_idx: the traces with the places (from 0) of the points nearest to their peak's bounds, null where they have no peak."""
    rows = signals.join(peaks.select("sample_id", "ion_id", "rtmin", "rtmax"), ["sample_id", "ion_id"], "left")
    at = lambda c: F.when(F.col(c).isNotNull(), signal.nearest_index(signal.times(F.col("points")), F.col(c)))
    return rows.select("sample_id", "ion_id", "points", at("rtmin").alias("fill_lo_idx"), at("rtmax").alias("fill_hi_idx"))
