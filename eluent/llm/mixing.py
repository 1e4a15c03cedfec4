"""Mixing sources to target weights.

Tokens (words) are added up for each source; the sources share a budget by weight, each up to a cap, what is above the caps being shared
again. A source's repetition rate is its target over its size. Each document is taken floor(rate) times, plus one more time
with a probability of the rate's fraction, a Bernoulli draw from a hash of a seed and the document. Of ``TRIES`` seeds a source takes the
one whose draws bring its total nearest to its target, so that a source of a few long documents comes near it too.

A null text has size 0. A null source is a source of its own, last in order. Rows with equal doc_id, source and size share one draw;
each of them is taken that often. An empty table gives an empty mix. Sizes of 0 throughout give targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: By code point of the source's name, null last, repeating.
WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED, TRIES = 1.5, 2.0, 17, 64


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target from source, source_size. Each round caps what is above; two sums come to the driver."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = common.with_rank(sources, order, "place")
    ranked = common.saved(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))), "sources")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    most = F.col("source_size") * F.lit(float(cap))
    level = 0.0
    while True:
        # sources whose part at this level is above their cap stay at the cap; the level only rises, so they never come back
        above = F.col("weight") * F.lit(level) > most
        held, weight = ranked.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))).first()
        now = (total - (held or 0.0)) / weight if weight else level
        if now <= level:
            break
        level = now
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(level), most).alias("target"))


def plan(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, copies."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size(F.col("text").cast("string")).alias("size"))
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    rows = common.saved(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    aims = targets(sources, **options).withColumnRenamed("source", "name")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aims.withColumns({"whole": F.floor(rate), "part": rate - F.floor(rate)})
    words = F.col("size") * F.col("rows")
    copies = lambda j: F.col("whole") + (F.pmod(F.xxhash64(F.lit(seed) + j, "doc_id", "size"), F.lit(1 << 40)) < F.col("part") * float(1 << 40)).cast("int")
    # a row for each source: Spark broadcasts them below its own threshold and splits the rows of a large source above
    drawn = rows.join(aims, rows["source"].eqNullSafe(aims["name"]))
    off = [F.abs(F.sum(words * copies(F.lit(j))) - F.first("target")) for j in range(TRIES)]
    best = drawn.groupBy("name").agg(F.array(*off).alias("off")).select(F.col("name").alias("_name"), (F.array_position("off", F.array_min("off")) - 1).cast("int").alias("seed"))
    aims = common.saved(aims.join(best, aims["name"].eqNullSafe(best["_name"])).drop("_name"), "aims")
    out = rows.join(aims, rows["source"].eqNullSafe(aims["name"])).withColumn("copies", copies(F.col("seed")).cast("int"))
    return out.select("doc_id", "source", "size", "rows", "source_size", "target", "copies")


def decisions(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes: a row for each row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted)."""
    out = plan(docs, **options)
    out = out.withColumn("_row", F.explode(F.expr("sequence(1, int(rows))")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns as they are."""
    words, of, source, n, copies, copy = common.free(docs, "_words", "_of", "_source", "_n", "_copies", "_copy")
    taken = plan(docs, **options).where("copies > 0").select(F.col("doc_id").alias(of), F.col("source").alias(source), F.col("size").alias(n), F.col("copies").alias(copies))
    sized = docs.withColumn(words, size(F.col("text").cast("string")))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (F.col(words) == F.col(n))
    out = sized.join(common.saved(taken, "copies"), on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
