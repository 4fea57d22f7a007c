"""Ranking quality: NDCG, MRR, recall and MAP over results and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """``results`` (query_id, id, rank) with ``rel`` from ``qrels`` (query_id, id, rel), 0 if not judged."""
    return results.join(qrels.select("query_id", "id", "rel"), ["query_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _dcg(rel: str, rank: str):
    return F.sum(F.col(rel) / F.log2(F.col(rank) + 1))


def evaluate(results: DataFrame, qrels: DataFrame, k: int = 10, groups: DataFrame | None = None) -> DataFrame:
    """Per query of ``qrels``: ndcg, ndcg_retrieved, mrr, recall and map at ``k``, 6 places.

    ``ndcg_retrieved`` takes the retrieved rows, best first, as the ideal;
    ``ndcg`` takes the judgements.  Queries without results score 0.
    ``groups`` (a few rows of one column that ``results`` has too) evaluates
    several result sets at once.
    """
    keys = ["query_id", *([] if groups is None else groups.columns)]
    rows = judged(results.filter(F.col("rank") <= k), qrels)
    best = rows.withColumn("best", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rel"), "rank")))
    relevant = F.when(F.col("rel") > 0, 1).otherwise(0)
    hits = F.sum(relevant).over(Window.partitionBy(*keys).orderBy("rank"))
    got = (
        best.withColumn("precision", F.when(F.col("rel") > 0, hits / F.col("rank")))
        .groupBy(*keys)
        .agg(_dcg("rel", "rank").alias("dcg"), _dcg("rel", "best").alias("own"), F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"), F.sum(relevant).alias("found"), F.sum("precision").alias("precisions"))
    )
    ideal = qrels.filter("rel > 0").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "id")))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= k, F.col("rel") / F.log2(F.col("place") + 1))).alias("ideal"), F.count("*").alias("relevant"))
    asked = qrels.select("query_id").distinct().join(ideal, "query_id", "left")
    if groups is not None:
        asked = asked.crossJoin(F.broadcast(groups))
    ratio = lambda a, b: F.round(F.coalesce(F.when(b > 0, a / b), F.lit(0.0)), 6)
    c = F.col
    return asked.join(got, keys, "left").select(
        *keys,
        ratio(c("dcg"), c("ideal")).alias("ndcg"),
        ratio(c("dcg"), c("own")).alias("ndcg_retrieved"),
        F.round(F.coalesce(1 / c("first"), F.lit(0.0)), 6).alias("mrr"),
        ratio(c("found"), c("relevant")).alias("recall"),
        ratio(c("precisions"), F.least(c("relevant"), F.lit(k))).alias("map"),
    )


def summary(per_query: DataFrame, *by: str) -> DataFrame:
    """Means over queries: quality to 4 places, latency (if there) to 1."""
    means = [F.round(F.avg(m), 4).alias(m) for m in ("ndcg", "mrr", "recall", "map") if m in per_query.columns]
    if "latency_ms" in per_query.columns:
        means.append(F.round(F.avg("latency_ms"), 1).alias("latency_ms"))
    return per_query.groupBy(*by).agg(F.count("*").alias("n_queries"), *means)
