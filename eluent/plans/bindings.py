"""The given tables as signals, peaks, cells and truth, with the same in SQL.

- signals: ``events``; sample is the user, ion the event type, rt the minute, intensity the value
- peaks: ``lineitem``; eight samples by supplier, ion is the part, rt the day of shipping, area the price
- cells: the largest area of each ion and sample over returned peaks, on the full grid of parts and samples; group A is samples 0 to 3
- truth: parts of size 25 or less; true fold changes are those over all peaks
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import matrix, ranks

SAMPLES = list(range(8))
#: A total order of peaks, whose keys repeat.
ORDER = ["rt", "area", "width", "conf", "class", "l_orderkey", "l_linenumber", "l_suppkey", "l_tax", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("ion_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 6e7).alias("rt"), F.col("value").alias("intensity"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("sample_id", "ion_id").agg(signal.build(F.col("rt"), F.col("intensity")).alias("points"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 8).alias("sample_id"), F.col("l_partkey").alias("ion_id"), F.unix_date(F.col("l_shipdate").cast("date")).cast("double").alias("rt"), F.col("l_extendedprice").alias("area"),
        F.col("l_returnflag").alias("class"), F.col("l_quantity").alias("width"), F.col("l_discount").alias("conf"), "l_orderkey", "l_linenumber", "l_suppkey", "l_tax", "l_linestatus",
    )


def areas(peaks: DataFrame, key: str = "ion_id") -> DataFrame:
    """A row for each ion of ``peaks``, with the largest area of each sample as a column: rows are dealt and joined as ions, not as cells."""
    return peaks.groupBy(key).agg(*(F.max(F.when(F.col("sample_id") == s, F.col("area"))).alias(f"_area_{s}") for s in SAMPLES))


def spread() -> Column:
    """sample_id and area, a row for each sample, of a row of ``areas``."""
    return F.inline(F.array(*(F.struct(F.lit(s).cast("long").alias("sample_id"), F.col(f"_area_{s}").alias("area")) for s in SAMPLES)))


def cells(spark: SparkSession, sf_dir: str, returned: bool = True) -> DataFrame:
    """feature_id, ion_id, sample_id, grp, area: every ion and sample, null where there is no peak."""
    p = peaks(spark, sf_dir)
    p = p.where("class = 'R'") if returned else p
    ions = ranks.dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ion_id")), "ion_id")
    out = ions.join(areas(p), "ion_id", "left").select("ion_id", spread())
    return out.select(F.col("ion_id").alias("feature_id"), "ion_id", "sample_id", F.when(F.col("sample_id") < 4, "A").otherwise("B").alias("grp"), "area")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("feature_id"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("target_id"), F.col("s_acctbal").alias("target_mz"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("centroid_id"), F.col("c_acctbal").alias("mz"), F.col("c_nationkey").cast("double").alias("intensity"))


POINTS_SQL = """pts AS (SELECT user_id AS sample_id, event_type AS ion_id, epoch_us(ts) / 6e7 AS rt, value AS intensity,
  row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n,
  lag(value) OVER w AS y0, lag(epoch_us(ts) / 6e7) OVER w AS t0
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), value))"""

APEX_SQL = POINTS_SQL + """, apex AS (SELECT sample_id, ion_id, min(i) AS k FROM
  (SELECT *, max(intensity) OVER (PARTITION BY sample_id, ion_id) AS top FROM pts) WHERE intensity = top GROUP BY ALL)"""

PEAKS_SQL = """peaks AS (SELECT l_suppkey % 8 AS sample_id, l_partkey AS ion_id, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS rt,
  l_extendedprice AS area, l_returnflag AS class, l_quantity AS width, l_discount AS conf, l_orderkey, l_linenumber, l_suppkey, l_tax, l_linestatus FROM lineitem)"""


def cells_sql(returned: bool = True, name: str = "cells") -> str:
    where = "WHERE l_returnflag = 'R'" if returned else ""
    return f"""{name} AS (SELECT p.p_partkey AS feature_id, s.sample_id, CASE WHEN s.sample_id < 4 THEN 'A' ELSE 'B' END AS grp, f.area
  FROM part p CROSS JOIN (SELECT unnest(range(8)) AS sample_id) s
  LEFT JOIN (SELECT l_partkey, l_suppkey % 8 AS sample_id, max(l_extendedprice) AS area FROM lineitem {where} GROUP BY ALL) f
  ON f.l_partkey = p.p_partkey AND f.sample_id = s.sample_id)"""


__all__ = ["ORDER", "SAMPLES", "cells", "matrix", "peaks", "points", "signals", "truth", "universe"]
