"""Conflict-constrained best-fit packing of documents into bins.

Documents longer than a bin are cut into full pieces and a rest.  Pieces are
dealt to groups by a hash of the document, so every group has about
``group_rows`` documents however skewed sources and clusters are.  In a group,
pieces go by falling length into bins kept in the order of their residuals.
A bin carries a bitmap of its sources and one of its duplicate clusters; the
search starts at the smallest residual that holds the piece and takes
successors until a bin has neither the piece's source nor its cluster.

A source with more pieces in a group than there are bins forces new bins: the
constraint is kept, not relaxed.

Defined results: null or empty texts have length 0 and get no bin (``bin_id``
null); null sources and clusters conflict with nothing; documents of one
source share no bin, nor do repeated rows of one cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import LOWER, column, slices

_BLOCK = 256


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its offset there; pieces come by falling length.

    ``sources`` and ``clusters`` are small codes, -1 for none.
    """
    n = len(lengths)
    # Only clusters met twice can conflict; the others need no bit.
    twice = np.flatnonzero(np.bincount(clusters[clusters >= 0], minlength=1) > 1)
    code = np.full(int(clusters.max(initial=0)) + 1, -1, np.int64)
    code[twice] = np.arange(len(twice))
    cluster_bit = np.where(clusters >= 0, code[np.maximum(clusters, 0)], -1)
    n_sources = int(sources.max(initial=-1)) + 1
    width = max(1, -(-(n_sources + len(twice)) // 64))
    maps = np.zeros((n + 1, width), np.uint64)  # bitmaps by bin: sources, then clusters
    residual = np.empty(n + 1, np.int64)  # by place in the order
    bins = np.empty(n + 1, np.int64)
    open_, made = 0, 0
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(n):
        size = int(lengths[k])
        bits = [b for b in (int(sources[k]), n_sources + int(cluster_bit[k]) if cluster_bit[k] >= 0 else -1) if b >= 0]
        at = int(np.searchsorted(residual[:open_], size))
        place = -1
        while at < open_:  # successors, a block at a time
            some = bins[at : at + _BLOCK] if at + _BLOCK <= open_ else bins[at:open_]
            free = np.ones(len(some), bool)
            for b in bits:
                free &= (maps[some, b >> 6] >> np.uint64(b & 63)) & np.uint64(1) == 0
            first = int(free.argmax())
            if free[first]:
                place = at + first
                break
            at += len(some)
        if place < 0:
            own, left = made, capacity - size
            made += 1
            offset[k] = 0
            if left:
                to = int(np.searchsorted(residual[:open_], left))
                residual[to + 1 : open_ + 1] = residual[to:open_]
                bins[to + 1 : open_ + 1] = bins[to:open_]
                residual[to], bins[to] = left, own
                open_ += 1
        else:
            own, had = int(bins[place]), int(residual[place])
            left = had - size
            offset[k] = capacity - had
            to = int(np.searchsorted(residual[:open_], left)) if left else 0
            if left:
                residual[to + 1 : place + 1] = residual[to:place]
                bins[to + 1 : place + 1] = bins[to:place]
                residual[to], bins[to] = left, own
            else:  # full: it leaves the order
                residual[place : open_ - 1] = residual[place + 1 : open_]
                bins[place : open_ - 1] = bins[place + 1 : open_]
                open_ -= 1
        for b in bits:
            maps[own, b >> 6] |= np.uint64(1) << np.uint64(b & 63)
        where[k] = own
    return where, offset


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, source, ``n_words`` and ``cluster``: a hash of the words in lower case (null without words)."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, source_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, text_col):
            n, marks = [], []
            for text in column(batch, text_col).to_pylist():
                own = (text or "").encode("utf-8", "surrogatepass").split()
                n.append(len(own))
                marks.append(xxhash.xxh3_64_intdigest(b" ".join(own).translate(LOWER)) - (1 << 63) if own else None)
            yield pa.RecordBatch.from_arrays([column(batch, id_col), column(batch, source_col), pa.array(n, pa.int64()), pa.array(marks, pa.int64())], ["_id", "_source", "n_words", "cluster"])

    out = docs.select(*dict.fromkeys([id_col, text_col, source_col])).mapInArrow(run, f"_id {kinds[0]}, _source {kinds[1]}, n_words long, cluster long")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_source", source_col)


def pack(items: DataFrame, id_col: str = "doc_id", source_col: str = "source", *, capacity: int = 2048, group_rows: int = 8192, rows: int | None = None) -> DataFrame:
    """Bins of ``items`` (id, source, ``n_words``, ``cluster``).

    One row per piece: id, source, ``piece``, ``start`` (word of the document),
    ``n_words`` of the piece, ``bin_id`` (group and bin, as text), ``bin_offset``.
    ``rows`` is the number of items, counted if not given.
    """
    rows = items.count() if rows is None else rows
    groups = max(1, -(-rows // group_rows))
    kinds = [items.schema[c].dataType.simpleString() for c in (id_col, source_col)]
    full = F.floor(F.greatest(F.col("n_words") - 1, F.lit(0)) / capacity).cast("long")
    pieces = items.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), "cluster", "n_words", F.pmod(F.xxhash64(id_col, "cluster"), F.lit(groups)).alias("_group"), F.explode(F.sequence(F.lit(0).cast("long"), full)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("n_words", F.least(F.col("n_words") - F.col("start"), F.lit(capacity)))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_words", "_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        solid = frame["n_words"].to_numpy() > 0
        part = frame[solid]
        sources, clusters = (pd.factorize(part[c])[0] for c in ("_source", "cluster"))
        where, offset = best_fit(part["n_words"].to_numpy(), sources, clusters, capacity)
        frame["bin_id"] = None
        frame.loc[solid, "bin_id"] = [f"{key[0]}-{b}" for b in where]
        frame["bin_offset"] = pd.Series(np.nan, frame.index).astype("Int64")
        frame.loc[solid, "bin_offset"] = offset
        return frame[["_id", "_source", "piece", "start", "n_words", "bin_id", "bin_offset"]]

    out = pieces.groupBy("_group").applyInPandas(run, f"_id {kinds[0]}, _source {kinds[1]}, piece long, start long, n_words long, bin_id string, bin_offset long")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_source", source_col)
