"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import shared_dir, until_exit

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Short rows of ids, up to this many (some 8 MB of longs), may be broadcast; longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Paths of this session, in order.
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    _made.append(until_exit(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"))
    return _made[-1]


def made() -> int:
    """How many paths there are so far."""
    return len(_made)


def discard(spark: SparkSession, first: int, end: int) -> None:
    """Deletes what lies at the paths from ``first`` to before ``end``: for tables that nothing reads any more, since what came of them is written."""
    for path in _made[first:end]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets the driver's JVM collect its garbage, upon which Spark deletes the shuffle files of tables that are written and plans that are gone; else they stay until it happens
    to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Short rows that one task may hold when a table of known size is written.
TASK_ROWS = 500_000


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts lineage, and outlives lost executors. A table of at most ``rows`` short rows is written by
    as many tasks as that needs, rather than by one for each shuffle partition."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df if rows is None else df.coalesce(tasks(rows))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def semi_join(df: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Join on ``on``; broadcasts ``ids`` (a saved table of a few short columns) only if a count shows that they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, how)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def semi_join_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` with (left_semi) or without (left_anti) the doc_id of ``ids`` (a saved table of longs), with their columns as they are, whatever
    their names. A null doc_id is in no list."""
    (name,) = free(docs, "_id")
    ids = ids.select(F.col("doc_id").alias(name))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").cast("long") == F.col(name), how)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def with_rank(df: DataFrame, order: list[Column], name: str = "rank", extra: dict[str, Column] | None = None) -> DataFrame:
    """``df`` (short rows) with a global 0-based rank, and running sums of ``extra`` before each row, in ``order``.

    A range partitioning spreads the rows, a hot value of the first key included, if later keys tell its rows apart. Only a
    row for each partition meets in one place. The ordered rows are checkpointed, since the ranges of a second
    run may differ.
    """
    shared_dir(df.sparkSession)
    extra = extra or {}
    rows = df.withColumns({f"_{k}": v for k, v in extra.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}).checkpoint()
    # the sequence number starts at 0 in each partition, above its 33 lower bits stands the partition
    rows = rows.withColumn("_seq", F.col("_seq").bitwiseAND((1 << 33) - 1))
    sums = [F.count("*").alias("_n"), *(F.sum(f"_{k}").alias(f"_sum_{k}") for k in extra)]
    from pyspark.sql import Window

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(*sums)
    parts = parts.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ["_n", *(f"_sum_{k}" for k in extra)]))
    out = rows.join(F.broadcast(parts), "_part")  # a row for each partition: bounded by their number
    out = out.withColumn(name, F.col("_n_before") + F.col("_seq"))
    if extra:
        inside = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({k: F.col(f"_sum_{k}_before") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in extra})
    return out.select(*df.columns, name, *extra)


# ---- inside tasks -------------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHash(dict):
    """64-bit hash of a word, kept for words met before; bounded, since the words of a corpus are not."""

    LIMIT = 400_000

    def __init__(self, seed: int = 0):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each ``n`` consecutive entries; empty if there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = hashes[:m].copy()
    for k in range(1, n):
        g *= _MULTIPLIER
        g += hashes[k : k + m]
    return mixed(g)


def shingles(text: bytes, known: WordHash, n: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles of an ASCII-lower-cased text; a shorter text is one shingle, an empty one none."""
    h = hashed_words(text.lower().split(), known)
    if 0 < len(h) < n:
        return mixed(windows(h, len(h)) + np.uint64(len(h)))
    return np.unique(windows(h, n))


def batches(rows: Iterable[pa.RecordBatch], size: int = 2_000) -> Iterable[pa.RecordBatch]:
    """The same rows in batches of at most ``size``."""
    for b in rows:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)
