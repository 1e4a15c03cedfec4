"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors to ``DIMS`` random directions, shifts the grid by its own offset, and orders the rows along a Hilbert curve.
The order is a range partitioning in Spark; it is cut into key windows of equal row counts, and a query looks into its own window and
those next to it, a ``REACH`` of the curve in all. The windows of all curves merge, and exact distances on the original vectors rerank.

``REACH`` is a share of the curve, the same at every size: many narrow windows see nearest neighbours more often than they see other rows, though
vectors that fill their space evenly need many of them. Work is ``CURVES * REACH`` distances for each query and row. A window has more rows than
the answers asked for, so that a table of no more than those is seen whole. A window and its queries are met in groups of
at most ``WINDOW`` rows and about ``QUERIES`` queries.

Vectors that are null, zero, of another length than most, or that hold a null or non-finite component take no part, nor do null ids. Rows of one
vec_id are one candidate at its smallest distance, taken before a window is cut to its nearest; rows that repeat in full count once; a query never finds its own id. Ties go to the smaller vec_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CURVES, DIMS, BITS = 16, 16, 3
REACH, WINDOW, QUERIES = 0.09, 2048, 512
EVERY, TOP, SEED = 100, 10, 7


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dims, below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of the coarser levels
        low = q - 1
        for d in range(len(x)):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, len(x)):  # Gray code
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = key << 1 | (x[d] >> b & 1)
    return key


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part; single-precision vectors are shuffled as such and measured in double precision."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (size[0] if size else 0))


def _keys(axes: np.ndarray, middle: np.ndarray, spread: np.ndarray, shifts: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it):
            x = b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)
            out = []
            for c in range(len(axes)):
                z = (x @ axes[c] - middle[c]) / spread[c]
                u = 0.5 + 0.5 * np.tanh(0.8 * z)  # about the share of rows below, if normally distributed
                out.append(hilbert(np.minimum((u + shifts[c]) / 2 * (1 << BITS), (1 << BITS) - 1), BITS))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(axes), dtype=np.int32), n)), pa.array(np.concatenate(out)), *(pa.concat_arrays([b.column(i)] * len(axes)) for i in (0, 2))], names=["curve", "key", "vec_id", "row"])

    return run


def _nearest(top: int):
    """The ``top`` nearest ids of one window to each of its queries; an id counts once, at the smallest distance of its rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, queries = group[~group["asked"]].sort_values("vec_id"), group[group["asked"]]
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(rows) or not len(queries):
            return none
        ids, starts = np.unique(rows["vec_id"].to_numpy(), return_index=True)
        x, q, of = np.stack(rows["embedding"].to_list()).astype(np.float64), np.stack(queries["embedding"].to_list()).astype(np.float64), queries["vec_id"].to_numpy()
        out = []
        for i in range(0, len(q), 64):  # so that the differences stay in bounds
            d = np.sqrt(np.square(q[i : i + 64, None, :] - x[None, :, :]).sum(axis=2))
            d = np.minimum.reduceat(d, starts, axis=1)
            d[of[i : i + 64, None] == ids[None, :]] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :top]  # ids ascend, so that ties go to the smaller
            near = np.take_along_axis(d, order, axis=1)
            k, j = np.nonzero(near < np.inf)
            out.append(pd.DataFrame({"query_id": of[i : i + 64][k], "vec_id": ids[order[k, j]], "score": near[k, j]}))
        return pd.concat(out)

    return run


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP, reach: float = REACH) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = common.saved(usable(vectors).distinct().withColumn("row", F.monotonically_increasing_id()), "vectors")
    if (head := rows.first()) is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = len(head["embedding"])
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    rng = np.random.default_rng(SEED)
    axes = rng.standard_normal((CURVES, size, DIMS)) / np.sqrt(size)
    shifts = rng.random((CURVES, DIMS))
    # mean and spread along an axis follow from those of the components, by one pass
    comps = rows.select(F.posexplode(F.col("embedding").cast("array<double>"))).groupBy("pos").agg(F.avg("col").alias("m"), F.var_pop("col").alias("v")).orderBy("pos").collect()
    mean, var = np.array([r["m"] for r in comps]), np.array([r["v"] for r in comps])
    middle = np.einsum("s,csd->cd", mean, axes)
    spread = np.sqrt(np.einsum("s,csd->cd", var, axes**2)) + 1e-12

    keys = rows.mapInArrow(_keys(axes, middle, spread, shifts), "curve int, key long, vec_id long, row long")
    ranked = common.with_rank(keys, [F.col("curve"), F.col("key"), F.col("vec_id"), F.col("row")])
    # three windows make the reach, or more if one would have too many rows; at least top + 1 rows in each
    windows = max(1, min(max(round(3 / reach), -(-n // WINDOW)), n // (top + 1)))
    side = min(max(1, (round(windows * reach) - 1) // 2), (windows - 1) // 2)
    ranked = ranked.withColumn("window", F.floor((F.col("rank") - F.col("curve") * F.lit(n)) * windows / F.lit(n)).cast("int"))
    low = F.greatest(F.lit(0), F.least(F.col("window") - side, F.lit(windows - 2 * side - 1)))
    placed = ranked.select("curve", "window", "vec_id", "row", low.alias("low"))
    blocks = max(1, round(n_queries * (2 * side + 1) / windows / QUERIES))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    inside = placed.select("curve", "window", "row", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asked"))
    asks = placed.where(F.col("vec_id") % every == 0).select("curve", F.explode(F.sequence(F.col("low"), F.col("low") + 2 * side)).alias("window"), "row", block, F.lit(True).alias("asked"))
    met = inside.union(asks).join(rows, "row")
    found = met.groupBy("curve", "window", "block").applyInPandas(_nearest(top), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")  # at most ``top`` rows of each window a query saw
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
