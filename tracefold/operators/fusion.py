"""Fusion of ranked lists, the confidence gate, fallbacks, filters, reranking and collapse."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fuse(bm25: DataFrame, dense: DataFrame, k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0), by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal-rank fusion of two lists (``by``, id, score, rank).

    Adds bm25_rank, bm25_score, dense_rank, dense_score, fused_score and rank;
    a row that one list lacks has nulls there.  Ties go to the smaller id.
    """
    keys = [*by, "id"]
    a = bm25.select(*keys, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    b = dense.select(*keys, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    part = lambda c, w: F.coalesce(F.lit(float(w)) / (F.col(c) + k), F.lit(0.0))
    fused = a.join(b, keys, "full_outer").withColumn("fused_score", F.round(part("bm25_rank", weights[0]) + part("dense_rank", weights[1]), 6))
    return reranked_by(fused, "fused_score", by)


def fuse_many(lists: list[DataFrame], k: int = RRF_K, weights: list[float] | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal-rank fusion of any number of lists."""
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("one weight for each list")
    parts = [x.select(*by, "id", (F.lit(float(w)) / (F.col("rank") + k)).alias("part")) for x, w in zip(lists, weights, strict=True)]
    return reranked_by(reduce(DataFrame.unionByName, parts).groupBy(*by, "id").agg(F.round(F.sum("part"), 6).alias("fused_score")), "fused_score", by)


def reranked_by(rows: DataFrame, score: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "id")))


def high_confidence(fused: DataFrame, margin: float = 0.15) -> DataFrame:
    """Per query, whether the first score leads the second by ``margin`` of itself.

    True with fewer than two rows, else false if the first score is 0.
    """
    top = F.max(F.when(F.col("rank") == 1, F.col("fused_score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("fused_score")))
    two = fused.filter(F.col("rank") <= 2).groupBy("query_id").agg(top.alias("top"), second.alias("second"))
    sure = F.when(F.col("second").isNull(), True).when(F.col("top") == 0, False).otherwise((F.col("top") - F.col("second")) / F.col("top") >= margin)
    return two.select("query_id", "top", "second", sure.alias("confident"))


def fuse_or_fall_back(bm25: DataFrame, dense: DataFrame, hybrid: bool = True, k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0), by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Fusion where both lists have rows; else the raw scores of the list that has.

    Without ``hybrid`` the dense list is taken if it has rows.
    """
    both = fuse(bm25, dense, k, weights, by)
    w = Window.partitionBy(*by)
    n = both.withColumns({"_b": F.count("bm25_rank").over(w), "_d": F.count("dense_rank").over(w)})
    fusing = F.lit(hybrid) & (F.col("_b") > 0) & (F.col("_d") > 0)
    use_dense = F.col("_d") > 0
    score = F.when(fusing, F.col("fused_score")).when(use_dense, F.col("dense_score")).otherwise(F.col("bm25_score"))
    kept = n.withColumn("fused_score", score).filter(F.col("fused_score").isNotNull()).drop("_b", "_d")
    return reranked_by(kept, "fused_score", by)


def post_filter(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Case-insensitive equality on columns, applied to ranked rows (so after the cut to k)."""
    for name, value in wanted.items():
        if value:
            rows = rows.filter(F.lower(F.col(name)) == value.lower())
    return rows


def rerank(rows: DataFrame, text: Column, query: Column, scorer: Callable[[list[str], list[str]], list[float]] | None, first: int = 30, confident: DataFrame | None = None, chars: int = 1000) -> DataFrame:
    """Scores the ``first`` rows of each query anew; the rest follows in its old order.

    Queries of ``confident`` pass through, as do all rows without a scorer or if
    it fails on a batch.  Rows to score are split off, so the others never reach
    Python.
    """
    if confident is not None:
        rows = rows.join(confident.select("query_id", "confident"), "query_id", "left")
    sure = F.coalesce(F.col("confident"), F.lit(False)) if confident is not None else F.lit(False)
    tail = rows.filter(sure | (F.col("rank") > first)).withColumn("rerank_score", F.col("fused_score")).withColumn("_tail", F.col("rank") > first)
    head = rows.filter(~sure & (F.col("rank") <= first))

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series, old: pd.Series) -> pd.Series:
        try:
            return pd.Series(scorer(q.tolist(), t.tolist()), dtype=float) if scorer else old
        except Exception:  # a failing model passes the batch through
            return old

    scored = head.withColumn("rerank_score", F.col("fused_score") if scorer is None else score(query, F.substring(text, 1, chars), F.col("fused_score"))).withColumn("_tail", F.lit(False))
    out = scored.unionByName(tail)
    w = Window.partitionBy("query_id").orderBy("_tail", F.when(~F.col("_tail"), -F.col("rerank_score")), "rank")
    return out.withColumn("rank", F.row_number().over(w)).drop("_tail", *(["confident"] if confident is not None else []))


def collapse_lineages(rows: DataFrame, lineage: str = "lineage_id", score: str = "fused_score", extra: tuple[str, ...] = ()) -> DataFrame:
    """The best row of each lineage per query, with the others in ``other_versions`` by rank.

    Rows of an empty or null lineage stay as they are.
    """
    named = F.coalesce(F.col(lineage), F.lit("")) != ""
    key = F.when(named, F.col(lineage)).otherwise(F.concat(F.lit("\0"), F.col("id").cast("string"), F.lit("\0"), F.col("rank").cast("string")))
    w = Window.partitionBy("query_id", "_lineage")
    other = F.struct("rank", F.col(score).alias("score"), "id", *extra)
    marked = rows.withColumn("_lineage", key).withColumn("_first", F.min("rank").over(w)).withColumn("_all", F.sort_array(F.collect_list(other).over(w)))
    best = marked.filter(F.col("rank") == F.col("_first")).withColumn("other_versions", F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))))
    out = best.drop("_lineage", "_first", "_all")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def trim(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each query, with ``total_results`` before the cut."""
    return rows.withColumn("total_results", F.count("*").over(Window.partitionBy("query_id"))).filter(F.col("rank") <= k)
