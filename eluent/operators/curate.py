"""Manual curation as data: edits are rows, and integration is applied to all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal


def default_bounds(features: DataFrame, reach: float = 0.12) -> DataFrame:
    """rt_left and rt_right: given rtmin and rtmax, else ``reach`` minutes to either side."""
    return features.withColumns({"rt_left": F.coalesce("rtmin", F.col("rt") - reach), "rt_right": F.coalesce("rtmax", F.col("rt") + reach)})


def display_bounds(features: DataFrame, share: float = 0.5, least: float = 0.15) -> DataFrame:
    """view_left and view_right around rt_left and rt_right: padded by a share of the width, ``least`` minutes at the least, from time 0 on."""
    pad = F.greatest(F.abs(F.col("rt_right") - F.col("rt_left")) * share, F.lit(least))
    return features.withColumns({"view_left": F.greatest(F.least("rt_left", "rt_right") - pad, F.lit(0.0)), "view_right": F.greatest("rt_left", "rt_right") + pad})


def latest(edits: DataFrame) -> DataFrame:
    """The last edit (highest ``seq``) of each feature and sample; an edit with a null sample is one of all samples."""
    return edits.withColumn("_k", F.row_number().over(Window.partitionBy("feature_id", "sample_id").orderBy(F.desc("seq")))).where("_k = 1").drop("_k")


def curated(signals: DataFrame, features: DataFrame, edits: DataFrame, baseline: str = "linear") -> DataFrame:
    """feature_id, sample_id, rt_left, rt_right, area, height, apex_rt, points, edited. The later of an edit of the sample and one of all samples holds;
    reversed bounds are swapped. Areas are intensity-minutes."""
    last = latest(edits)
    own = last.where("sample_id is not null").select("feature_id", "sample_id", F.struct("seq", "rt_left", "rt_right").alias("own"))
    every = last.where("sample_id is null").select("feature_id", F.struct("seq", "rt_left", "rt_right").alias("every"))
    rows = signals.join(default_bounds(features).select("feature_id", F.struct(F.lit(-1).cast("long").alias("seq"), "rt_left", "rt_right").alias("given")), "feature_id")
    rows = rows.join(own, ["feature_id", "sample_id"], "left").join(every, "feature_id", "left").withColumn("e", F.greatest("given", "own", "every"))
    left, right = F.least("e.rt_left", "e.rt_right"), F.greatest("e.rt_left", "e.rt_right")
    return rows.select("feature_id", "sample_id", left.alias("rt_left"), right.alias("rt_right"), signal.integrate(F.col("points"), left, right, baseline).alias("x"), (F.col("e.seq") >= 0).alias("edited")).select("feature_id", "sample_id", "rt_left", "rt_right", "x.*", "edited")
