"""Reproducible sampling, splits and augmentation. Draws are ranks of a seeded hash, so that they do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import ranks


def draw(key: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def fixed_size(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, and an error if there are fewer."""
    have = rows.limit(n).count()
    if have < n:
        raise ValueError(f"{n} rows are asked for; there are {have}")
    return rows.withColumn("_draw", draw(key, seed)).orderBy("_draw", key).limit(n).drop("_draw")


def validate_ratios(ratios: list[float]) -> None:
    if any(r <= 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError(f"ratios are positive and add up to 1: {ratios}")


def largest_remainder(total: int, ratios: list[float]) -> list[int]:
    """Whole numbers near ``total * ratio`` that add up to ``total``; what is left goes to the largest remainders, then the first."""
    exact = [total * r for r in ratios]
    out = [int(x + 1e-9) for x in exact]
    for i in sorted(range(len(ratios)), key=lambda i: (out[i] - exact[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


def stratified_split(rows: DataFrame, key: str, strata: list[str], names: list[str], ratios: list[float], seed: int = 42) -> DataFrame:
    """``rows`` with ``split``. Within each stratum the draws are cut at running shares of the whole table: strata follow each other on one
    line of ranks, so that each stratum is within a row of its share and the totals are exact."""
    validate_ratios(ratios)
    counts = sorted(map(tuple, rows.groupBy(*strata).count().collect()), key=str)  # one for each signature
    total = sum(c[-1] for c in counts)
    target, given, plan = largest_remainder(total, ratios), [0] * len(ratios), []
    seen = 0
    for c in counts:
        seen += c[-1]
        due = [t * seen / total for t in target]
        want = [min(max(int(d) - g, 0), c[-1]) for d, g in zip(due, given, strict=True)]
        while sum(want) > c[-1]:
            i = max(range(len(want)), key=lambda i: (want[i] and given[i] + want[i] - due[i], i))
            want[i] -= 1
        while sum(want) < c[-1]:
            i = min((i for i in range(len(want)) if given[i] + want[i] < target[i]), key=lambda i: given[i] + want[i] - due[i])
            want[i] += 1
        given = [g + w for g, w in zip(given, want, strict=True)]
        plan.append((*c[:-1], *(sum(want[: i + 1]) for i in range(len(want)))))
    spark = rows.sparkSession
    fields = [rows.schema[s].dataType.simpleString() for s in strata]
    ends = [f"_end{i}" for i in range(len(names))]
    table = spark.createDataFrame(plan, ", ".join([f"_{s} {t}" for s, t in zip(strata, fields, strict=True)] + [f"{e} long" for e in ends]))
    ranked = ranks.with_group_rank(rows, strata, [draw(key, seed), F.col(key)], "_rank")
    on = [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in strata]
    split = F.coalesce(*(F.when(F.col("_rank") <= F.col(e), F.lit(n)) for e, n in zip(ends, names, strict=True)))
    return ranked.join(F.broadcast(table), on).withColumn("split", split).select(*rows.columns, "split")


def flip(labels: DataFrame, prefix: str = "flip_") -> DataFrame:
    """``labels`` (stem, line, class_id, xc, yc, w, h) with a mirrored copy of each; those flipped before are not flipped again."""
    plain = labels.where(~F.col("stem").startswith(prefix))
    return plain.unionByName(plain.withColumns({"stem": F.concat(F.lit(prefix), "stem"), "xc": 1 - F.col("xc")}))


def pages(rows: DataFrame, by: list[str], order: list[Column], size: int = 24) -> DataFrame:
    """``rows`` with ``page`` and ``position`` on it, both from 0, in ``order`` within each group of ``by``."""
    k = F.col("_k") - 1
    return ranks.with_group_rank(rows, by, order, "_k").withColumns({"page": F.floor(k / size), "position": (k % size).cast("long")}).drop("_k")


def chi_square(rows: DataFrame, by: str, value: str, classes: list | None = None) -> DataFrame:
    """One row: statistic, degrees, p of the hypothesis that ``by`` and ``value`` are independent; an error where one of ``classes`` has no rows."""
    parts = contingency(rows, by, value)
    if classes is not None:
        seen = {r[0] for r in parts.select(value).where(F.col(value).isin(classes)).distinct().collect()}  # of the given classes
        if missing := [c for c in classes if c not in seen]:
            raise ValueError(f"classes without rows: {missing}")
    # a pair without rows counts too: all it is expected to have is its part
    every = parts.agg(F.sum("part").alias("part"), F.sum("expected").alias("expected"), F.sum("observed").alias("n"), ((F.countDistinct(by) - 1) * (F.countDistinct(value) - 1)).alias("degrees"))
    out = every.select((F.col("part") + F.col("n") - F.col("expected")).alias("statistic"), "degrees")
    p = F.pandas_udf(stats.chi_square_probabilities, "double")
    return out.withColumn("p", p(F.col("statistic"), F.col("degrees").cast("double")))


def contingency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, observed, expected and their part of chi-square."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("observed"))
    sums = n.withColumns({"a": F.sum("observed").over(Window.partitionBy(by)), "b": F.sum("observed").over(Window.partitionBy(value))})
    total = n.agg(F.sum("observed").alias("total"))
    out = sums.join(F.broadcast(total)).withColumn("expected", F.col("a") * F.col("b") / F.col("total"))
    return out.select(by, value, "observed", "expected", (F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected")).alias("part"))
