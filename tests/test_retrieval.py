"""BM25, dense search, fusion, filters, reranking and collapse."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.operators import bm25, dense, fusion, metrics
from tracefold.plans import ablation

CORPUS = [
    ("sort_list", "sort_list\ndef sort_list(x):\n    return sorted(x) list python"),
    ("parse_json", "parse_json json json data parse"),
    ("empty", ""),
]


def plain_bm25(docs, query, k1=1.5, b=0.75):
    from collections import Counter

    tf = {i: Counter(t) for i, t in docs.items()}
    avg = sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, t in docs.items():
        s = 0.0
        for q in query:
            df = sum(q in x for x in tf.values())
            s += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf[i][q] * (k1 + 1) / (tf[i][q] + k1 * (1 - b + b * len(t) / avg))
        out[i] = s
    return out


def test_bm25_matches_the_formula(spark):
    index = bm25.build(spark.createDataFrame(CORPUS, "id string, text string"), "id", F.col("text"))
    asked = spark.createDataFrame([(1, "sort list python"), (2, "return json data"), (3, "sort sort"), (4, "zzz"), (5, "")], "query_id long, text string")
    docs = {"sort_list": "sort list def sort list return sorted list python".split(), "parse_json": "parse json json json data parse".split(), "empty": []}
    got = {(r.query_id, r.id): r.score for r in bm25.search(index, asked, 5).collect()}
    for q, words in ((1, "sort list python"), (2, "return json data"), (3, "sort sort")):
        want = {i: s for i, s in plain_bm25(docs, words.split()).items() if s > 0}
        assert {i for n, i in got if n == q} == set(want)
        assert all(got[q, i] == pytest.approx(s, abs=1e-6) for i, s in want.items())
    assert not any(q in (4, 5) for q, _ in got)
    bare = {(r.query_id, r.id): r.score for r in bm25.search(index, asked, 5, variant="bare").collect()}
    assert all(bare[k] == pytest.approx(v / 2.5, abs=1e-6) for k, v in got.items())


def test_dense_blocks_and_cache(spark):
    rng = np.random.default_rng(0)
    x = dense.normalised(rng.standard_normal((60, 12)))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<float>").repartition(3)
    asked = rows.filter("id < 7").withColumnRenamed("id", "query_id")
    whole, cut = (sorted(map(tuple, dense.search(rows, asked, 5, query_block=n).collect())) for n in (100, 3))
    assert whole == cut and len(whole) == 35
    scores = np.round(x[:7].astype(float) @ x.T.astype(float), 6)
    for q in range(7):
        assert [r[1] for r in whole if r[0] == q] and {r[1] for r in whole if r[0] == q} == set(np.lexsort((np.arange(60), -scores[q]))[:5].tolist())
    assert dense.search(rows, asked.limit(0), 5).count() == 0
    chunks = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id long, t string")
    calls = spark.sparkContext.accumulator(0)

    def counting(texts):
        calls.add(len(texts))
        return dense.hashed_words(8)(texts)

    first, cache = dense.with_embeddings(chunks, F.col("t"), counting, None, "m")
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    assert cache.count() == 2 and calls.value == 2
    again, whole = dense.with_embeddings(chunks.unionByName(spark.createDataFrame([(4, "d")], "id long, t string")), F.col("t"), counting, cache, "m")
    assert again.filter("embedding is not null").count() == 4 and calls.value == 3


def test_approximate_search_with_all_probes_is_exact(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    exact = dense.search(rows, asked, 10)
    index = dense.InvertedFile(rows, cells=8)
    assert dense.recall(index.search(asked, 10, probes=8), exact).agg(F.min("recall")).first()[0] == 1
    assert dense.recall(index.search(asked, 10, probes=4), exact).agg(F.avg("recall")).first()[0] > 0.7


def ranked(spark, rows):
    return spark.createDataFrame([(1, i, s, r) for r, (i, s) in enumerate(rows, 1)], "query_id long, id string, score double, rank int")


def test_fusion(spark):
    a, b = ranked(spark, [("A", 9.0), ("B", 8.0), ("C", 7.0)]), ranked(spark, [("B", 0.9), ("A", 0.8), ("D", 0.7)])
    got = {r.id: r for r in fusion.fuse(a, b).collect()}
    assert [got[i].fused_score for i in "ABCD"] == [0.032522, 0.032522, 0.015873, 0.015873] and [got[i]["rank"] for i in "ABCD"] == [1, 2, 3, 4]
    assert got["C"].dense_rank is None and got["D"].bm25_score is None
    many = {r.id: r.fused_score for r in fusion.fuse_many([a, b, a], weights=[1, 1, 2]).collect()}
    assert many["A"] == pytest.approx(3 / 61 + 1 / 62, abs=1e-6)
    swapped = {r.id: r.fused_score for r in fusion.fuse(b, a).collect()}
    assert swapped == {i: r.fused_score for i, r in got.items()}


@pytest.mark.parametrize("scores,sure", [((2 / 61, 2 / 62), False), ((2 / 61, 1 / 61), True), ((0.5,), True), ((0.0, 0.0), False)])
def test_confidence(spark, scores, sure):
    rows = spark.createDataFrame([(1, s, r) for r, s in enumerate(scores, 1)], "query_id long, fused_score double, rank int")
    assert fusion.high_confidence(rows).first().confident is sure


def test_fallback(spark):
    a, b = ranked(spark, [("A", 9.0)]), ranked(spark, [("B", 0.9)])
    none = a.limit(0)
    one = lambda x, y, **o: [(r.id, r.fused_score) for r in fusion.fuse_or_fall_back(x, y, **o).collect()]
    assert one(a, none) == [("A", 9.0)] and one(none, b) == [("B", 0.9)] and one(a, b, hybrid=False) == [("B", 0.9)] and one(none, none) == []


def test_rerank_and_collapse(spark):
    rows = spark.createDataFrame([(q, f"{q}{c}", s, r, f"L{r % 2}" if r < 5 else "") for q in (1, 2) for r, (c, s) in enumerate(zip("abcdef", (6.0, 5.0, 4.0, 3.0, 2.0, 1.0), strict=True), 1)], "query_id long, id string, fused_score double, rank int, lineage_id string")
    sure = spark.createDataFrame([(1, False), (2, True)], "query_id long, confident boolean")
    got = fusion.rerank(rows, F.col("id"), F.lit("q"), lambda q, t: [float(ord(x[1])) for x in t], first=3, confident=sure).orderBy("query_id", "rank").collect()
    assert [r.id for r in got] == ["1c", "1b", "1a", "1d", "1e", "1f", "2a", "2b", "2c", "2d", "2e", "2f"]

    def broken(q, t):
        raise RuntimeError

    assert [r.id for r in fusion.rerank(rows, F.col("id"), F.lit("q"), broken, first=3).filter("query_id = 1").orderBy("rank").collect()] == ["1a", "1b", "1c", "1d", "1e", "1f"]
    best = fusion.collapse_lineages(rows).filter("query_id = 1").orderBy("rank").collect()
    assert [(r.id, [o.id for o in r.other_versions]) for r in best] == [("1a", ["1c"]), ("1b", ["1d"]), ("1e", []), ("1f", [])]
    twice = fusion.collapse_lineages(fusion.collapse_lineages(rows).drop("other_versions"))
    assert twice.count() == 8
    cut = fusion.trim(fusion.collapse_lineages(rows), 1).collect()
    assert len(cut) == 2 and all(r.total_results == 4 for r in cut)


def test_metrics(spark):
    results = spark.createDataFrame([(1, i, r) for r, i in enumerate("abc", 1)] + [(2, i, r) for r, i in enumerate("abc", 1)] + [(3, i, r) for r, i in enumerate("abc", 1)], "query_id long, id string, rank int")
    qrels = spark.createDataFrame([(1, "b", 1), (2, "a", 1), (2, "c", 1), (2, "z", 1), (3, "y", 1), (4, "a", 1)], "query_id long, id string, rel int")
    got = {r.query_id: r for r in metrics.evaluate(results, qrels, 10).collect()}
    assert (got[1].ndcg_retrieved, got[1].mrr) == (0.63093, 0.5) and (got[2].ndcg_retrieved, got[2].mrr) == (0.919721, 1.0)
    assert (got[3].ndcg, got[3].mrr, got[4].recall) == (0, 0, 0) and got[2].recall == 0.666667 and got[2].map == pytest.approx((1 + 2 / 3) / 3, abs=1e-6)
    assert got[2].ndcg < got[2].ndcg_retrieved


def test_rebuild_and_load():
    t = iter([0, 10, 10, 12])
    assert ablation.rebuild_times(lambda: None, lambda: None, lambda: next(t))["speed_up"] == 5
    calls = []
    out = ablation.load([("a", 5, lambda: calls.append("a")), ("b", 1, lambda: calls.append("b"))], 30)
    assert sum(x["requests"] for x in out.values()) == 30 == len(calls)
