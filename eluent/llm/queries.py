"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_io

    return token_io.encode(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.components(_documents(spark, sf_dir))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by markup, address and host, and documents by the language and source they come with; one text model for both."""
    from . import langid

    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.selectExpr("doc_id as id", "text", "lang"))
    of_docs = langid.identify_documents(docs, model)
    of_pages = langid.identify(langid.evidence_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), model, markup=True)
    none = F.lit(None).cast("long")
    columns = ["lang", "best", "posterior"]
    return of_docs.select(F.col("id").alias("doc_id"), none.alias("page_id"), *columns).union(of_pages.select(none, "id", *columns))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's messages hold no quotes: ``chat.history`` adds replies that quote them."""
    from . import chat

    return chat.conversations(chat.history(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rollups

    return rollups.history(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digest(secrets.spans(_documents(spark, sf_dir)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.decisions(_documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.dedup(_documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence

    return divergence.audit(_documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical

    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pitman_yor

    return pitman_yor.scores(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_nearest, op3_language_id, op4_mixing, op5_chat, op6_secret_scan, op7_token_counts, op8_decontamination, op9_substring_dedup, op10_token_output, op11_source_divergence, op12_lexical_search, op13_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    from . import decontam, divergence, lexical, ngram_join, rollups, substring

    return {"op1_ngram_join": ngram_join.SQL, "op7_token_counts": rollups.SQL, "op8_decontamination": decontam.SQL, "op9_substring_dedup": substring.SQL, "op11_source_divergence": divergence.SQL, "op12_lexical_search": lexical.SQL}
