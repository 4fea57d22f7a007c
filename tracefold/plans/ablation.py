"""Comparisons of configurations, rebuild times and a mixed load."""

from __future__ import annotations

import random
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators import fusion, metrics

#: name, lexical, dense, weights of both lists
CONFIGURATIONS = (
    ("bm25_only", True, False, (1.0, 1.0)),
    ("dense_only", False, True, (1.0, 1.0)),
    ("hybrid", True, True, (1.0, 1.0)),
    ("hybrid_lexical", True, True, (2.0, 1.0)),
    ("hybrid_dense", True, True, (1.0, 2.0)),
)


def grid(lexical: DataFrame, dense: DataFrame, qrels: DataFrame, k: int = 10, configurations=CONFIGURATIONS) -> DataFrame:
    """Mean quality of every configuration over the same two lists; ``bm25_only`` is really lexical.

    The lists are joined once; each row then stands once for each configuration
    that has it.
    """
    fused = fusion.fuse(lexical, dense)
    part = lambda rank, weight: F.coalesce(F.lit(float(weight)) / (F.col(rank) + fusion.RRF_K), F.lit(0.0))
    rows = []
    for name, use_lexical, use_dense, weights in configurations:
        both = use_lexical and use_dense
        own = F.col("bm25_rank") if use_lexical else F.col("dense_rank")
        score = F.round(part("bm25_rank", weights[0]) + part("dense_rank", weights[1]), 6) if both else -own.cast("double")
        rows.append(F.struct(F.lit(name).alias("config"), score.alias("s")))
    each = fused.select("query_id", "id", F.explode(F.array(*rows)).alias("c")).select("query_id", "id", "c.config", "c.s").filter("s is not null")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("config", "query_id").orderBy(F.desc("s"), "id")))
    names = lexical.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c[0]) for c in configurations])).alias("config"))
    return metrics.summary(metrics.evaluate(ranked, qrels, k, names), "config")


def rebuild_times(full: Callable[[], object], incremental: Callable[[], object], clock: Callable[[], float] = time.monotonic) -> dict[str, float]:
    """Seconds of a full and of an incremental build, and their ratio."""
    taken = []
    for build in (full, incremental):
        began = clock()
        build()
        taken.append(clock() - began)
    return {"full_seconds": taken[0], "incremental_seconds": taken[1], "speed_up": taken[0] / taken[1] if taken[1] else float("inf")}


def load(actions: list[tuple[str, int, Callable[[], object]]], requests: int = 50, seed: int = 1, clock: Callable[[], float] = time.monotonic) -> dict[str, dict[str, float]]:
    """Runs actions (name, weight, call) in a weighted random order; count and latencies in ms."""
    rng, taken = random.Random(seed), {name: [] for name, _, _ in actions}
    for name, _, call in rng.choices(actions, [w for _, w, _ in actions], k=requests):
        began = clock()
        call()
        taken[name].append((clock() - began) * 1000)
    return {n: {"requests": len(t), "p50_ms": statistics.median(t), "p95_ms": sorted(t)[int(0.95 * (len(t) - 1))]} for n, t in taken.items() if t}
