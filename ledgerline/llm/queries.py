"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.chat import CHAT_SQL, chat_digests, with_hostile
from ledgerline.llm.collocations import COLLOCATIONS_SQL, collocations
from ledgerline.llm.common import table
from ledgerline.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negatives, noisy_label
from ledgerline.llm.html_text import page_texts
from ledgerline.llm.mixing import MIX_SQL, poisson_mix
from ledgerline.llm.near_dup import jaccard_join
from ledgerline.llm.packing import pack
from ledgerline.llm.perplexity import quality_rules
from ledgerline.llm.pii import personal_data
from ledgerline.llm.quality import quality_scores
from ledgerline.llm.token_counts import token_counts
from ledgerline.llm.topk import TOP_K_SQL, top_k
from ledgerline.llm.toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op1_top_k", TOP_K_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query("op3_quality_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op10_poisson_mix", MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_chat_format", CHAT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(with_hostile(table(spark, sf_dir, "conversations"), spark))


@query("op12_hard_negatives", HARD_NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, noisy_label())


@query("op13_collocations", COLLOCATIONS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
