"""The corpus pipeline: quality rules, language ID, near-duplicate removal, pseudonyms and packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. No
stage holds rows back but by its own decision: distinct texts under one id are documents each, a row that repeats both
goes as a copy, rows with a null id or without words pass the near-duplicate stage. Ties: of a group the smallest id stays,
of repeated rows the least by all columns. Very long texts are measured, compared, changed and packed whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import common, language, ngrams, order, packing, pii, rules

#: The least share of the main language in a text that stays.
LEAST_SHARE = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """A stage begins after the one before it was written out, so that one's intermediates can go."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, "pipeline")
        with common.owned_by("pipeline"):
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = common.written(rules.measured(docs).select("row", "host", "base_failed"))
    return rules.judged(rows).where("kept").select("row.*")


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    lang, share = (max([*docs.columns, ""], key=len) + end for end in ("_lang", "_share"))  # names that no column has
    found = language.identify(docs, model, docs.columns, lang, share)
    return found.where((F.col(lang) != language.UNKNOWN) & (F.col(share) >= LEAST_SHARE)).select(docs.columns)


def told_apart(docs: DataFrame, key: str) -> DataFrame:
    """docs with a key of their own for all rows that the near-duplicate stage tells apart, null for those it lets pass.

    The key is the id where only one row has it. Distinct texts under a shared id get keys beyond all ids, in order of id
    and text digest; of rows with one id and one text with words, the least by all columns stays.
    """
    shared = common.written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if shared.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    digest, row = key + "_digest", key + "_row"
    words = F.col("text").rlike(r"[^ \t-\r]")
    rows = common.written(docs.join(ngrams.small(shared), "doc_id", "left_semi").select(*docs.columns, F.when(words, F.sha2("text", 256)).alias(digest)))
    once = rows.where(F.col(digest).isNotNull()).groupBy("doc_id", digest).agg(F.min(F.struct(*docs.columns)).alias(row))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    placed = order.numbered(once.withColumn("all", F.lit(0)), "all", ["doc_id", digest])
    new = F.col("position") + F.lit(high + 1) if high < 1 << 62 else F.lit(low - 1) - F.col("position")
    alone = docs.join(ngrams.small(shared), "doc_id", "left_anti").select(*docs.columns, F.col("doc_id").cast("long").alias(key))
    placed = placed.select(f"{row}.*", new.cast("long").alias(key))
    rest = rows.where(F.col(digest).isNull()).select(*docs.columns, F.lit(None).cast("long").alias(key))
    return common.written(alone.unionByName(placed).unionByName(rest))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = max([*docs.columns, ""], key=len) + "_key"
    docs, columns = told_apart(docs, key), docs.columns
    found = ngrams.similar(docs.select(F.col(key).alias("doc_id"), "text"), 5, 8, 10)
    gone = common.written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct())
    return docs.join(ngrams.small(gone), key, "left_anti").select(columns)


@stage
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df = pii.pseudonymised(docs)
    new = {"text": F.col("text"), "n_chars": F.col("row.n_chars") + F.coalesce(F.length("text") - F.length("row.text"), F.lit(0))}
    return df.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("pii", pseudonyms),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, near-duplicate components and tokenizers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, work in STAGES[:-1]:
        docs = common.written(work(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
