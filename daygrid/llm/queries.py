"""The operators as registered queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.llm import (
    chat,
    embedding_dedup,
    instruction_packing,
    mixing,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scans,
    signature_join,
    sql,
    suffix_dedup,
    url_filters,
    whitening,
)
from daygrid.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_quality_rules", sql.QUALITY_RULES)
def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.stored_ledger(table(spark, sf_dir, "documents"))
    return quality_rules.with_verdict(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


@query("quality_ablation", sql.quality_ablation())
def quality_ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(quality_rules.stored_ledger(table(spark, sf_dir, "documents")))


@query("op2_url_filters", sql.url_filters())
def url_filters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


@query("op3_secret_scans", sql.secret_scans())
def secret_scans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.summarised(secret_scans.scan(table(spark, sf_dir, "documents")))


@query("op4_best_fit_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_chat_formatting", sql.chat())
def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.formatted(chat.message_events(rows.unionByName(more))))


@query("op5_quality_classifier")
def quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


@query("op7_mixing")
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = mixing.with_probability(table(spark, sf_dir, "documents"), columns=["doc_id"])
    cell = [F.col(names[d]).alias(d) for d in (*mixing.DIMENSIONS, "weight", "probability", "kept")]
    return rows.select("doc_id", *cell)


@query("op6_ngram_jaccard_join")
def jaccard_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.join(table(spark, sf_dir, "documents"))


@query("op9_embedding_near_dedup")
def embedding_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


@query("op10_suffix_array_dedup")
def suffix_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op13_instruction_packing")
def instruction_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruction_packing.pack(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Beyond what a long holds, from some million vectors on, the decimal has no counterpart here.
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query("op12_periodic_runs")
def periodic_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.collapse(table(spark, sf_dir, "documents"), change=periodic_runs.planted)
