"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage but the last returns the columns of ``documents``:

1. language identification drops what it rejects (no letters, or far from every
   language's centroids) and fills in missing languages;
2. quality rules drop what they reject and remove frequent lines from the rest;
3. near-duplicate detection keeps the smallest id of each group (five words,
   similarity 0.8);
4. best-fit packing deals the documents left, or pieces of long ones, to bins.

Defined results: null and empty texts go in the first stage; rows of a null id
are kept by near-duplicate detection; repeated rows leave one, rows of one id and
different texts are told apart; columns beyond those of ``documents`` pass
through, whatever their names, if they don't begin with ``_p_``; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import best_fit_packing, language_id, quality_rules, setsketch_dedup
from tracefold.llm.common import cut, fold

#: The language and other decisions of the stages are no SQL; tests use a brute-force version.
ORACLE_SQL = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    model = language_id.fit(docs, F.coalesce(fold(F.col("doc_id")) != 0, F.lit(True)))
    found = language_id.identify(docs, model, carry=tuple(docs.columns), prefix="_p_")
    return found.filter(~F.col("_p_rejected")).withColumn("lang", F.coalesce("lang", "_p_lang_pred")).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their frequent lines."""
    judged = quality_rules.quality_verdicts(docs, carry=tuple(docs.columns), with_frequent_lines=True, prefix="_p_")
    left = quality_rules.remove_lines(judged.filter("_p_kept").select(*docs.columns, "_p_frequent_lines"), "text", "source", "_p_frequent_lines")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Rows are told apart by id and text: of rows with one id, each goes or stays by its own text, and equal rows leave one.
    """
    marked = docs.withColumn("_p_text", F.xxhash64("text"))
    key, row = ["doc_id", "_p_text"], F.struct("doc_id", "_p_text")
    found = cut(setsketch_dedup.near_duplicates(marked, carry=("_p_text",)).select(*key, "kept", "group"))
    stays = found.filter("kept and group is not null")
    several = stays.groupBy("group").agg(F.count("*").alias("_p_n"), F.min(row).alias("_p_first")).filter("_p_n > 1")
    again = cut(stays.join(several, "group").select(*key, (row == F.col("_p_first")).alias("_p_is_first")).distinct())  # groups whose smallest id has several rows
    gone = found.filter("not kept").select(*key).unionByName(again.select(*key)).distinct()
    left = marked.join(gone, key, "left_anti")
    if not again.isEmpty():  # without such groups, this would exchange all texts once more for no row
        left = left.unionByName(marked.join(again.filter("_p_is_first").select(*key), key, "left_semi").dropDuplicates(key))
    return left.select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each document, or of each piece of a long one."""
    return best_fit_packing.pack(best_fit_packing.measure(docs), rows=docs.count())


STAGES = [
    ("language_id", identify_languages),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("best_fit_packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
