"""Corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns; the last returns what its token files
hold. Between stages the rows are written as Parquet and read again. Further columns of ``documents`` go through all but the last stage
unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eluent.llm import common, decontam, langid, mixing, ngram_join, token_io


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters (null and empty texts too), in no known language, or with evidence that points
    nowhere, go. Rows of one doc_id go only together; rows with a null doc_id stay; an empty table stays empty."""
    judged = langid.identify_documents(docs)
    rejected = judged.groupBy(F.col("id").alias("doc_id")).agg(F.count("lang").alias("n")).where("n = 0 and doc_id is not null").select("doc_id")
    return common.semi_join_ids(docs, common.saved(rejected, "rejected"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group; of rows with one doc_id, one. Null and empty texts are in no group; rows with a null
    doc_id stay."""
    first = common.made()
    groups = common.saved(ngram_join.components(docs), "groups")
    common.discard(spark, first, common.made() - 1)  # what the groups came of
    kept = common.semi_join_ids(docs, common.saved(groups.where("component_id < doc_id").select("doc_id").distinct(), "dropped"), "left_anti")
    repeated = common.saved(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    (name,) = common.free(docs, "_id")
    once = common.semi_join_ids(kept, repeated, "left_semi").withColumn(name, F.col("doc_id").cast("long")).dropDuplicates([name]).drop(name)
    return common.semi_join_ids(kept, repeated, "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``. Documents without words, and rows with a null doc_id, stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the mix of sources takes it; a null source is one of its own, and a text without words has size 0."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the token files: doc_id, start, n_tokens, ids_crc32; null ids first, null texts as their end id alone."""
    import public_tokenizers

    return token_io.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token output", tokens),
]

#: The stages draw by hash, fit a text model and run a BPE tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. When a stage is written, its intermediate tables and the table it read are deleted."""
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.made()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            end = common.made()
            docs = common.saved(docs, "stage")
            common.discard(spark, first, end)
            first = end
    return docs
