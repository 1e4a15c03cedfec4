"""Alignment of the times of runs to those of a centre run, by dynamic time warping of their profiles.

A profile has a vector for each time cell: the logarithm of the intensities by whole mass, folded to ``MASSES`` places. A run's path through the similarities (cosines) of its
cells with the centre's, within a band, gains what matched cells have in common and pays for cells that are passed over. Matched cells are anchors; between them times are shifted linearly, and stay in order.
Profiles are sums made before anything is gathered; each run is one task, with the centre's profile, whose size is checked, beside it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASSES, CELL, BAND, PASS = 64, 0.05, 60, 0.3
#: Time cells of a profile, at most.
LIMIT = 100_000


def profiles(centroids: DataFrame, cell: float = CELL) -> DataFrame:
    """sample_id, t, m, y of centroids (sample_id, rt, mz, intensity), times in minutes."""
    sums = centroids.where("rt >= 0 and mz > 0").groupBy("sample_id", F.floor(F.col("rt") / cell).cast("int").alias("t"), F.pmod(F.floor("mz"), F.lit(MASSES)).cast("int").alias("m")).agg(F.sum("intensity").alias("y"))
    return sums.where("y > 0").select("sample_id", "t", "m", F.log1p("y").alias("y"))


def dense(t: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Vectors of length 1 (or 0), one for each time cell; values are centred at the cell's mean."""
    if t.max() >= LIMIT:
        raise ValueError(f"a profile has more than {LIMIT} time cells; use a wider cell")
    out = np.zeros((int(t.max()) + 1, MASSES))
    out[t, m] = y
    out -= out.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def path(a: np.ndarray, b: np.ndarray, band: int = BAND, passed: float = PASS) -> list[tuple[int, int]]:
    """The matched cells of two profiles: the best sum of similarities, less ``passed`` for each cell of either side that is passed over. Cells further apart than ``band`` do not match."""
    n, width = len(a), 2 * band + 1
    best = np.full(width + 1, -np.inf)
    best[band:width] = -passed * np.arange(width - band)  # before the first cell; entry k of row i is column i - band + k
    choice = np.zeros((n, width), np.int8)
    steps = passed * np.arange(width)
    for i in range(n):
        columns = np.arange(i - band, i + band + 1)
        inside = (columns >= 0) & (columns < len(b))
        gain = np.full(width, -np.inf)
        gain[inside] = b[columns[inside]] @ a[i]
        match = best[:width] + gain  # from the cell before in both
        up = np.append(best[1:width], -np.inf) - passed
        here = np.maximum(match, up)
        run = np.maximum.accumulate(np.where(np.isfinite(here), here + steps, -np.inf)) - steps
        choice[i] = np.where(run > here + 1e-12, 2, np.where(match >= up, 0, 1))
        best = np.append(run, -np.inf)
    found, i = [], n - 1
    ends = np.where((np.arange(n - 1 - band, n + band) < len(b)) & np.isfinite(best[:width]), best[:width] - passed * np.abs(len(b) - 1 - np.arange(n - 1 - band, n + band)), -np.inf)
    k = int(np.argmax(ends))
    while i >= 0 and k >= 0:
        if choice[i, k] == 2:
            k -= 1
        elif choice[i, k] == 1:
            i, k = i - 1, k + 1
            if k >= width:
                break
        else:
            if i - band + k < 0:
                break
            found.append((i, i - band + k))
            i -= 1
    return found[::-1]


def shifts(a: np.ndarray, b: np.ndarray, cell: float, band: int = BAND, least: float = 0.5) -> np.ndarray:
    """For each cell of ``a``, by how much its centre moves: linear between anchors (matches of a similarity of ``least``), with no time before an earlier one."""
    anchors = [(i, j) for i, j in path(a, b, band) if a[i] @ b[j] >= least]
    at = np.arange(len(a))
    if not anchors:
        return np.zeros(len(a))
    i, j = np.array(anchors).T
    to = np.maximum.accumulate(at + np.interp(at, i, j - i))
    return (to - at) * cell


def warps(centroids: DataFrame, centre: object, cell: float = CELL, band: int = BAND) -> DataFrame:
    """sample_id, cell, shift, next: the shift in minutes at the centre of each time cell of each run, and of the one after. ``centre``: the run that the others follow."""
    rows = profiles(centroids, cell)
    own = rows.where(F.col("sample_id") == centre).select("t", "m", "y").limit(LIMIT * MASSES + 1).toPandas()  # one run's cells, checked next
    if not len(own):
        raise ValueError(f"the centre {centre} has no centroids")
    target = dense(*(own[c].to_numpy() for c in "tmy"))
    kind = rows.schema["sample_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        s = shifts(dense(*(group[c].to_numpy() for c in "tmy")), target, cell, band)
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "cell": np.arange(len(s)), "shift": s, "next": np.append(s[1:], s[-1])})

    return rows.groupBy("sample_id").applyInPandas(run, f"sample_id {kind}, cell int, shift double, next double")


def aligned(rows: DataFrame, warps: DataFrame, cell: float = CELL, rt: str = "rt") -> DataFrame:
    """``rows`` with their times moved; times of cells that no run has stay."""
    half = F.col(rt) / cell - 0.5
    out = rows.withColumn("_cell", F.greatest(F.floor(half), F.lit(0)).cast("int")).join(warps.withColumnRenamed("cell", "_cell"), ["sample_id", "_cell"], "left")
    share = F.least(F.greatest(half - F.col("_cell"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn(rt, F.col(rt) + F.coalesce(F.col("shift") + share * (F.col("next") - F.col("shift")), F.lit(0.0))).select(*rows.columns)


def centre_of(spectra: DataFrame) -> object:
    """The run with the most scans, the first of several."""
    first = spectra.groupBy("sample_id").count().orderBy(F.desc("count"), "sample_id").first()
    if first is None:
        raise ValueError("there are no runs")
    return first["sample_id"]
