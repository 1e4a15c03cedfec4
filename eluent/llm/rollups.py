"""Token counts as delta-maintained rollups.

A rollup is a folder with one sub-folder for each committed batch, which holds that batch's signed sums by source, language and tokenizer version.
Totals are sums over batches, so that inserts, deletes and revised counts cost only their own rows. A batch is committed when its
sums are written in full; committing its id again with the same changes changes nothing, with others it is an error, and a batch that broke off is
written anew. ``compact`` adds the batches up in a snapshot; totals are then those of the latest one and of the batches after it.

Changes are rows (op, source, lang, tokenizer, tokens, old_tokens): ``insert`` adds a document and its tokens, ``delete`` takes both away, ``revise``
replaces ``old_tokens`` by ``tokens``. Null sources and languages are groups of their own; null counts are 0; other ops are an error. A batch
without rows is a batch all the same. Groups whose documents and tokens are both 0 are left out of totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Tokenizer versions as patterns of their tokens.
VERSIONS = {"words-1": common.WORD, "words-2": r"[^\x20\x09-\x0D.,;:!?]+"}


def signed(changes: DataFrame) -> DataFrame:
    """The sums of a batch."""
    op, tokens, old = F.col("op"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong.cast("int"))
    delta = F.when(op == "insert", tokens).when(op == "delete", -tokens).otherwise(tokens - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(delta).cast("long").alias("tokens"))


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def committed(self, batch: int) -> bool:
        fs, where = self._fs(f"{self.path}/batch={batch}/_SUCCESS")
        return fs.exists(where)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Whether the batch was new. A known batch with other sums is refused."""
        sums, path = signed(changes), f"{self.path}/batch={batch}"
        if not self.committed(batch):
            sums.write.mode("overwrite").parquet(path)
            return True
        before = self.spark.read.schema(SCHEMA).parquet(path)
        differ = before.withColumn("n", F.lit(1)).unionByName(sums.withColumn("n", F.lit(-1))).groupBy(*KEYS, "docs", "tokens").agg(F.sum("n").alias("n")).where("n <> 0")
        if not differ.isEmpty():
            raise ValueError(f"batch {batch} was committed with other changes")
        return False

    def _done(self, kind: str) -> dict[int, str]:
        """Numbers and paths of the finished batches or snapshots: one for each."""
        fs, where = self._fs(f"{self.path}/{kind}=*/_SUCCESS")
        paths = [str(f.getPath().getParent()) for f in fs.globStatus(where) or []]
        return {int(p.rsplit("=", 1)[1]): p for p in paths}

    def _rows(self) -> tuple[DataFrame, list[int]]:
        """Rows that add up to the totals, and the batches in them."""
        batches, snapshots = self._done("batch"), self._done("snapshot")
        empty = self.spark.createDataFrame([], f"{SCHEMA}, batches array<long>")
        held, rows = [], empty
        if snapshots:
            rows = self.spark.read.schema(empty.schema).parquet(snapshots[max(snapshots)])
            held = [x for r in rows.where("batches is not null").select("batches").collect() for x in r[0]]  # one row
        later = [p for b, p in batches.items() if b not in set(held)]
        rows = rows.where("batches is null").drop("batches")
        return (rows.unionByName(self.spark.read.schema(SCHEMA).parquet(*later)) if later else rows), sorted({*held, *batches})

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over the committed batches."""
        return self._rows()[0].groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Writes what is committed as a snapshot; the batches stay, so that they are known if they are delivered again."""
        _, held = self._rows()
        sums = self.totals().withColumn("batches", F.lit(None).cast("array<bigint>"))
        mark = self.spark.createDataFrame([(held,)], "batches array<long>")
        number = max(self._done("snapshot"), default=0) + 1
        sums.unionByName(mark, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/snapshot={number}")


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def history(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after four batches over ``docs``: all are inserted under the first version; those labelled toxic are deleted; all are inserted under the second version; counts of the
    first are revised to leave out words of punctuation alone for documents labelled of low quality. The second batch arrives twice."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", "source", "lang", *(count(text, p).alias(v) for v, p in VERSIONS.items()), count(text, r"(?<![^\x20\x09-\x0D])[.,;:!?]+(?![^\x20\x09-\x0D])").alias("marks"))
    rows = common.saved(rows, "counts")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    judged = rows.join(marks, "doc_id")

    def changes(df: DataFrame, op: str, version: str, tokens: Column | None = None, old: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("long")
        return df.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), (F.col(version) if tokens is None else tokens).alias("tokens"), (none if old is None else old).alias("old_tokens"))

    rollup = Rollup(spark, common.fresh_path(spark, "rollup"))
    one, two = VERSIONS
    gone = changes(judged.where("toxic = 1"), "delete", one)
    rollup.commit(1, changes(rows, "insert", one))
    rollup.commit(2, gone)
    rollup.commit(3, changes(rows, "insert", two))
    rollup.commit(2, gone)
    low = judged.where("quality = 0 and coalesce(toxic, 0) <> 1")
    rollup.commit(4, changes(low, "revise", one, F.col(one) - F.col("marks"), F.col(one)))
    return rollup.totals()


SQL = r"""
WITH c AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w1,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D.,;:!?]+')) AS w2,
                  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: regexp_full_match(x, '[.,;:!?]+'))) AS marks FROM documents),
l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
j AS (SELECT c.*, toxic, quality FROM c LEFT JOIN l USING (doc_id)),
t AS (SELECT source, lang, 'words-1' AS tokenizer, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS docs,
             CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN w1 - marks ELSE w1 END AS tokens FROM j
      UNION ALL SELECT source, lang, 'words-2', 1, w2 FROM j)
SELECT source, lang, tokenizer, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens
FROM t GROUP BY source, lang, tokenizer HAVING sum(docs) <> 0 OR sum(tokens) <> 0
"""
