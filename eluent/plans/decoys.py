"""Decoy data sets: a list of true peaks and, sampled from one run's centroids, as many peaks that are none of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import sampling
from ..sources import mzml

N, DISTANCE, MOST, SEED = 836, 1.0, 100_000.0, 42
COLUMNS = ["Compound Name", "mz", "RT", "Intensity"]


def checked_parameters(n: int, distance: float, most: float) -> None:
    if n <= 0:
        raise ValueError(f"the number of decoys is positive, not {n}")
    if not math.isfinite(distance) or distance <= 0:
        raise ValueError(f"the m/z distance is finite and positive, not {distance}")
    if not math.isfinite(most) or most < 0:
        raise ValueError(f"the largest intensity is finite and not negative, not {most}")


def numbered(rows: DataFrame, prefix: str, order: list[Column | str], name: str = "Compound Name") -> DataFrame:
    """``rows``, a list of bounded size, with a name of ``prefix`` and their number from 1 in ``order``."""
    return rows.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.orderBy(*order)).cast("string")))


def true_positives(table: DataFrame) -> DataFrame:
    """Compound Name, mz, RT of a list of true peaks, or an error: columns that are missing, no rows, numbers that are none or not finite, m/z not above 0,
    times below 0, missing names. Without names they are TP_1, TP_2, ... in order of the rows."""
    missing = [c for c in ("mz", "RT") if c not in table.columns]
    if missing:
        raise ValueError(f"true positives lack the columns {missing}")
    rows = table.withColumns({"_i": F.monotonically_increasing_id(), "_mz": stats.finite(stats.number(F.col("mz"))), "_rt": stats.finite(stats.number(F.col("RT")))})
    named = "Compound Name" in table.columns
    n = lambda c: F.count(F.when(c, 1))
    r = rows.agg(F.count("*"), n(F.col("_mz").isNull() | F.col("_rt").isNull()), n(F.col("_mz") <= 0), n(F.col("_rt") < 0), n(F.col("`Compound Name`").isNull()) if named else F.lit(0)).first()
    for bad, what in ((r[0] == 0, "have no rows"), (r[1], "have m/z or RT that are no finite numbers"), (r[2], "have m/z that are not above 0"), (r[3], "have RT below 0"), (r[4], "lack names")):
        if bad:
            raise ValueError(f"true positives {what}")
    if not named:
        rows = numbered(rows, "TP_", ["_i"])
    return rows.select(F.col("`Compound Name`").cast("string").alias("Compound Name"), F.col("_mz").alias("mz"), F.col("_rt").alias("RT"))


def false_positives(candidates: DataFrame, n: int = N, seed: int = SEED) -> DataFrame:
    """``n`` of the candidates, named FP_1 to FP_n; an error if there are fewer. The draw is by hash, so that it can be repeated."""
    keyed = candidates.withColumn("_key", F.concat_ws("/", "sample_id", "scan", "place"))
    drawn = sampling.fixed_size(keyed, "_key", n, seed).withColumn("_order", sampling.draw("_key", seed))
    return numbered(drawn, "FP_", ["_order", "_key"]).select("Compound Name", "mz", F.col("rt").alias("RT"), F.col("intensity").alias("Intensity"))


def dataset(true: DataFrame, spectra: DataFrame, n: int = N, distance: float = DISTANCE, most: float = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """True positives (without intensities) and decoys in one table, and the MS1 range of times with the number of candidates."""
    checked_parameters(n, distance, most)
    tp = true_positives(true)
    found = mzml.candidates(spectra, tp, distance, most)
    timed = spectra.where((F.col("rt") >= 0) & (F.col("rt") < float("inf")))
    spans = timed.agg(F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"), F.count("*").alias("scans"))
    if timed.isEmpty():
        raise ValueError("there are no valid MS1 scans")
    both = tp.withColumn("Intensity", F.lit(None).cast("double")).unionByName(false_positives(found, n, seed))
    return both.select(*(F.col(f"`{c}`") for c in COLUMNS)), spans.join(F.broadcast(found.agg(F.count("*").alias("candidates"))))  # one row each
