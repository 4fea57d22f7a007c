"""Lexical retrieval: an inverted index as tables, and scoring as a join and a sum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.text import tokenise
from tracefold.sources.scratch import written

K1, B = 1.5, 0.75


@dataclass
class Index:
    """``postings`` (id, term, tf, dl), ``term_df`` (term, df) and one row of ``stats`` (n, avgdl)."""

    postings: DataFrame
    term_df: DataFrame
    stats: DataFrame


def indexed_text(symbol: Column, docstring: Column, code: Column, path: Column | None = None) -> Column:
    """What the index holds of a chunk; paths only on request."""
    return F.concat_ws("\n", *[c for c in (path, symbol, docstring, code) if c is not None])


def _tokens(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, tokens and dl; the generator keeps Catalyst from copying the tokeniser into every use."""
    return docs.select(F.col(id_col).alias("id"), F.inline(F.array(F.struct(tokenise(text).alias("tokens"))))).withColumn("dl", F.size("tokens"))


def build(docs: DataFrame, id_col: str, text: Column) -> Index:
    """The index of ``docs``.

    Length comes from the token array of each document, so counting terms is
    the only exchange; term_df and stats aggregate partially before theirs.
    """
    tokens = _tokens(docs, id_col, text)
    postings = tokens.select("id", "dl", F.explode("tokens").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").cast("int").alias("tf"))
    return Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def build_for(docs: DataFrame, id_col: str, text: Column, terms: DataFrame) -> Index:
    """The part of the index that ``terms`` (term) need, from one pass over the documents.

    Each document also gives one row of the empty term, which no query has, so
    that the written table holds the length of every document; statistics are
    those of the full index.
    """
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    found = _tokens(docs, id_col, text).select("id", "dl", F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term")).join(wanted, "term", "left_semi")
    counted = written(found.groupBy("id", "term", "dl").agg(F.count("*").cast("int").alias("tf")))
    postings = counted.filter("term <> ''")
    stats = counted.filter("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), stats)


def search_once(docs: DataFrame, id_col: str, text: Column, queries: DataFrame, k: int = 100, text_col: str = "text") -> DataFrame:
    """``search`` over documents that have no stored index: only terms of the queries are counted."""
    return search(build_for(docs, id_col, text, query_terms(queries, text_col)), queries, k, text_col)


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """query_id, term and how often the query has it."""
    return queries.select("query_id", F.explode(tokenise(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def scores(index: Index, queries: DataFrame, text_col: str = "text", k1: float = K1, b: float = B, variant: str = "full") -> DataFrame:
    """query_id, id and score (rounded to 6 places) of every document with a query term.

    ``variant="bare"`` leaves out the constant factor (k1 + 1), which doesn't
    change the order.
    """
    terms = query_terms(queries, text_col)
    factor = (k1 + 1) if variant == "full" else 1.0
    weight = terms.join(index.term_df, "term").crossJoin(F.broadcast(index.stats)).select("query_id", "term", (idf(F.col("n"), F.col("df")) * F.col("qtf") * factor).alias("w"), "avgdl")
    part = F.col("w") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return index.postings.join(weight, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def ranked(scored: DataFrame, k: int, id_col: str = "id", by: str = "query_id") -> DataFrame:
    """The ``k`` best rows of each query with their rank; ties go to the smaller id."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 100, text_col: str = "text", **options) -> DataFrame:
    """query_id, id, score, rank: the ``k`` best documents of positive score for each query."""
    return ranked(scores(index, queries, text_col, **options).filter("score > 0"), k)
