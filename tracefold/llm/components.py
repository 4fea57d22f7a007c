"""Connected components of a table of links.

Each round contracts links in two ways: tasks run a union-find over pieces of
a fixed number of links, and alternating stars point all larger neighbours of a
vertex at its smallest one, then all its smaller ones.  Minima are aggregated
with partial sums, and a vertex with very many links only makes a skewed
equi-join, which adaptive execution splits.  The number of pieces follows the
number of links, whatever the partitions are, so that a task holds one piece
and no task is started for a handful of links.  Rounds are cut by a table in
the shared folder and stop when every vertex has one link, to a vertex that has
none; links that made a single piece are at that point by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import discard, kept


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _union_find(edges: list[np.ndarray]) -> pa.RecordBatch:
    names, at = np.unique(np.concatenate(edges, 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(names))
    while True:  # hook larger roots to smaller ones, then shorten the paths
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    far = names != names[root]
    return pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root][far])], ["a", "b"])


def _contracted(edges: DataFrame, piece: int) -> tuple[DataFrame, str, int]:
    """Links from each vertex to the smallest one found within a piece, as a written table, its path, and the number of pieces.

    ``edges`` is a written table.
    """
    pieces = max(1, -(-edges.count() // piece))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
                n += b.num_rows
            if n >= piece and pieces > 1:
                yield _union_find(held)
                held, n = [], 0
        if held:
            yield _union_find(held)

    state, path = kept(edges.select("a", "b").coalesce(pieces).mapInArrow(run, "a long, b long"))
    return state, path, pieces


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex has one link at most, and those linked to have none."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by.filter((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)).isEmpty()


def components(edges: DataFrame, most_rounds: int = 60, piece: int = 500_000) -> DataFrame:
    """``vertex`` and ``component`` (its smallest vertex) of each vertex with a link.

    ``edges`` has long columns ``a`` and ``b``; self links are ignored, an empty table gives an empty result.
    """
    spark = edges.sparkSession
    links, links_path = kept(edges.filter("a <> b").select("a", "b").distinct())
    for _ in range(most_rounds):
        state, path, pieces = _contracted(links, piece)
        discard(spark, links_path)
        if pieces == 1 or _settled(state):
            break
        links, links_path = kept(_small(_large(state)))
        discard(spark, path)
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    roots = state.select(F.col("b").alias("vertex")).distinct()
    return state.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots.select("vertex", F.col("vertex").alias("component")))
