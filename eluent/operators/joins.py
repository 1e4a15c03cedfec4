"""Joins on numeric distance, as equi joins on buckets that no pair within the tolerance can miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(targets: DataFrame, rows: DataFrame, target: str, value: str, width: float) -> DataFrame:
    """Each target with the rows of its own bucket and those next to it: the tolerance must not exceed ``width``."""
    at = F.floor(F.col(target) / width)
    near = targets.withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1)))
    return near.join(rows.withColumn("_bucket", F.floor(F.col(value) / width)), "_bucket")


def nearest(targets: DataFrame, rows: DataFrame, key: str, target: str, value: str, tolerance: Column, width: float, payload: list[str]) -> DataFrame:
    """For each target the nearest row, the smaller value of two equally near, if nearer than ``tolerance`` (strictly).

    No pairs are made: in each bucket targets and distinct values are walked in order, both ways, and a target takes the last value on either side. The values next to a bucket are those
    at the ends of its neighbours.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    found = F.struct(F.col(value).alias("v"), *payload)
    values = rows.where(finite(value)).groupBy(F.floor(F.col(value) / width).alias("_bucket"), F.col(value).alias("_at")).agg(F.min(found).alias("_row"))
    ends = values.groupBy("_bucket").agg(F.max(F.struct("_at", "_row")).alias("last"), F.min(F.struct("_at", "_row")).alias("first"))  # a row for each bucket
    ends = ends.select(F.explode(F.array(F.struct((F.col("_bucket") + 1).alias("_bucket"), F.col("last").alias("x")), F.struct((F.col("_bucket") - 1).alias("_bucket"), F.col("first").alias("x")))).alias("e"))
    sought = targets.where(finite(target)).select(F.floor(F.col(target) / width).alias("_bucket"), F.col(target).alias("_at"), F.struct(key, target).alias("_target"))
    both = values.unionByName(ends.select("e._bucket", "e.x.*")).unionByName(sought, allowMissingColumns=True)
    side = lambda order: F.last("_row", ignorenulls=True).over(Window.partitionBy("_bucket").orderBy(order, F.col("_target").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"_below": side(F.col("_at")), "_above": side(F.desc("_at"))}).where("_target is not null").select("_target.*", F.explode(F.array("_below", "_above")).alias("_row"))
    d = F.abs(F.col("_row.v") - F.col(target))
    best = both.where(d < tolerance).groupBy(key).agg(F.min(F.struct(d.alias("d"), "_row.v", *(F.col(f"_row.{p}").alias(p) for p in payload))).alias("x"))
    return best.select(key, F.col("x.v").alias(value), F.col("x.d").alias("distance"), *(F.col(f"x.{p}").alias(p) for p in payload))


def window_reduce(targets: DataFrame, rows: DataFrame, key: str, target: str, value: str, low: Column, high: Column, width: float, measure: str, mode: str = "sum") -> DataFrame:
    """For each target the sum or maximum of ``measure`` over rows with ``low <= value <= high``; 0 where there are none. Equal windows and equal values meet once."""
    if mode not in ("sum", "max"):
        raise ValueError(f"mode is sum or max, not {mode}")
    reduce = F.sum if mode == "sum" else F.max
    at = [target, "_low", "_high"]
    placed = targets.withColumns({"_low": low, "_high": high})
    summed = rows.groupBy(value).agg(reduce(measure).alias(measure), F.count("*").alias("n"))
    pairs = _bucketed(placed.select(*at).distinct(), summed, target, value, width).where((F.col(value) >= F.col("_low")) & (F.col(value) <= F.col("_high")))
    got = pairs.groupBy(*at).agg(reduce(measure).alias(measure), F.sum("n").alias("n"))
    return placed.select(key, *at).join(got, at, "left").select(key, target, measure, "n").na.fill(0, [measure, "n"])


def away_from(rows: DataFrame, targets: DataFrame, key: str, value: str, target: str, distance: float) -> DataFrame:
    """Rows whose value is at least ``distance`` from every target: an anti join on buckets of that width."""
    at = F.floor(F.col(target) / distance)
    near = targets.select(target).distinct().withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1)))
    tagged = rows.withColumn("_bucket", F.floor(F.col(value) / distance))
    hit = tagged.join(near, (tagged["_bucket"] == near["_bucket"]) & (F.abs(tagged[value] - near[target]) < distance), "left_anti")
    return hit.drop("_bucket")


def in_rectangles(points: DataFrame, boxes: DataFrame, x: str = "mz", y: str = "rt", by: list[str] | None = None) -> DataFrame:
    """Points (positive ``x``, ``y``) with the columns of each box (``x_low``, ``x_high``, ``y_low``, ``y_high``, inclusive) that holds them, and with equal values in ``by``.

    Both meet on cells of a grid over the logarithm of ``x`` and ``y``, as wide as the boxes are on average, so that a box covers a few cells and a point lies in one.
    """
    low, high, first, last = f"{x}_low", f"{x}_high", f"{y}_low", f"{y}_high"
    whole = boxes.where((F.col(low) <= F.col(high)) & (F.col(first) <= F.col(last)) & (F.col(high) > 0))
    wide, tall = whole.agg(F.avg(F.log(high) - F.log(F.greatest(low, F.lit(1e-12)))), F.avg(F.col(last) - F.col(first))).first()
    wide, tall = max(wide or 0.0, 1e-6), max(tall or 0.0, 1e-3)
    column, row = (lambda c: F.floor(F.log(c) / wide)), (lambda c: F.floor(F.col(c) / tall))
    spread = whole.withColumn("_x", F.explode(F.sequence(F.floor(F.log(F.greatest(low, F.lit(1e-12))) / wide), column(high)))).withColumn("_y", F.explode(F.sequence(row(first), row(last))))
    placed = points.where(F.col(x) > 0).withColumns({"_x": column(x), "_y": row(y)})
    met = placed.join(spread, ["_x", "_y", *(by or [])])
    return met.where((F.col(x) >= F.col(low)) & (F.col(x) <= F.col(high)) & (F.col(y) >= F.col(first)) & (F.col(y) <= F.col(last))).drop("_x", "_y")
