"""Connected components of a graph of links, each round a few shuffles of the links that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(links: DataFrame, rows: int) -> bool:
    """Whether no ``b`` is an ``a``, and each ``a`` has one ``b``."""
    roots = common.saved(links.select(F.col("b").alias("a")).distinct(), "roots", rows)
    if not common.semi_join(links.select("a"), roots, "a").isEmpty():
        return False
    return links.groupBy("a").count().where("count > 1").coalesce(common.tasks(rows)).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for each id of ``links`` (a, b).

    Alternates two steps until each component is a star: each node links its larger neighbours to its smallest one, then itself and its smaller
    neighbours to it. Groups are only ever aggregated by ``min``, and the minima are written before they are joined, so that Spark
    can split the links of a node that has very many; every round is in the shared folder, written by as many tasks as its count asks for. Null ends
    are ignored; no links give no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = common.saved(links, "links")
    while not _stars(links, rows := 2 * links.count()):
        both = links.union(links.select("b", "a"))
        least = common.saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", rows)
        large = common.semi_join(both.where("b > a"), least, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.saved(large, "large", rows)
        least = common.saved(large.groupBy("a").agg(F.min("b").alias("m")), "least", rows)
        small = common.semi_join(large, least, "a", "inner").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        links = common.saved(small.where("a <> b").distinct(), "links", rows)
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
