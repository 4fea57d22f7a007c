"""Dense retrieval: encoding, an embedding cache, exact and approximate top-k."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.bm25 import ranked
from tracefold.sources.scratch import written

Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(dims: int = 384) -> Encoder:
    """A stand-in encoder: signed word hashes, summed.  It says nothing about a real model's quality."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for k, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[k, h % dims] += 1 if h & 0x80000000 else -1
        return out

    return encode


def normalised(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm == 0, 1, norm)).astype(np.float32)


def encode_column(text: Column, encoder: Encoder, second: Encoder | None = None, weight: float = 0.3) -> Column:
    """Unit vectors of a text column; a second encoder's vector may be appended with a weight."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            v = normalised(encoder(texts))
            if second is not None:
                v = normalised(np.concatenate([v, weight * normalised(second(texts))], 1))
            yield pd.Series(list(v))

    # Else Catalyst may copy the call into a filter below the join that spares it.
    return run.asNondeterministic()(text)


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def missing_embeddings(chunks: DataFrame, text: Column, encoder: Encoder, cache: DataFrame | None, model_id: str) -> DataFrame:
    """model_id, text_hash and embedding of the distinct texts that the cache lacks."""
    wanted = chunks.select(text.alias("_text")).withColumn("text_hash", text_hash(F.col("_text"))).dropDuplicates(["text_hash"])
    if cache is not None:
        wanted = wanted.join(cache.filter(F.col("model_id") == model_id).select("text_hash"), "text_hash", "left_anti")
    return wanted.select(F.lit(model_id).alias("model_id"), "text_hash", encode_column(F.col("_text"), encoder).alias("embedding"))


def from_cache(chunks: DataFrame, text: Column, cache: DataFrame, model_id: str) -> DataFrame:
    """``chunks`` with the ``embedding`` that the cache has for their text."""
    own = cache.filter(F.col("model_id") == model_id).select("text_hash", "embedding").dropDuplicates(["text_hash"])
    return chunks.withColumn("text_hash", text_hash(text)).join(own, "text_hash", "left").drop("text_hash")


def with_embeddings(chunks: DataFrame, text: Column, encoder: Encoder, cache: DataFrame | None, model_id: str) -> tuple[DataFrame, DataFrame]:
    """``chunks`` with ``embedding``, and the cache with the new vectors.

    The cache (model_id, text_hash, embedding) is keyed by model and by the
    embedded text.  Only distinct texts that it lacks reach the encoder, once:
    their vectors are written before both results read them.
    """
    new = written(missing_embeddings(chunks, text, encoder, cache, model_id))
    whole = new if cache is None else cache.unionByName(new)
    return from_cache(chunks, text, whole, model_id), whole


def _packed(source: DataFrame, size: int, id_kind: str) -> DataFrame:
    """ids, dim and matrix: rows (id, v) in blocks of at most ``size`` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows = zip(*waiting.pop(dim), strict=True)
            matrix = np.array(rows, np.float64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([list(ids)], pa.list_(id_type)), pa.array([dim], pa.int32()), pa.array([matrix], pa.binary())], ["ids", "dim", "matrix"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.setdefault(len(v), []).append((i, v))
                if len(waiting[len(v)]) >= size:
                    yield block(len(v))
        for dim in sorted(waiting):
            yield block(dim)

    return source.mapInArrow(run, f"ids array<{id_kind}>, dim int, matrix binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 100, id_col: str = "id", vec_col: str = "embedding", query_block: int = 1024, block: int = 4096) -> DataFrame:
    """query_id, id, score (inner product, rounded), rank: exact.

    Blocks of queries meet blocks of vectors in an equi-join on a cell number, as
    matrix products; nothing passes through the driver.  A task keeps ``k`` rows
    for each query of the blocks it met, before the last exchange.
    """
    cells = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind, id_kind = queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("v is not null")
    asked = queries.select("query_id", F.col(vec_col).alias("v")).filter("v is not null").repartition(max(1, cells // 8))
    right = _packed(rows, block, id_kind).withColumn("_cell", F.pmod(F.xxhash64("matrix"), F.lit(cells)))
    left = _packed(asked, query_block, kind).select(F.col("ids").alias("q_ids"), "dim", F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("_cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple] = {}

        def results() -> Iterator[pa.RecordBatch]:
            for q_ids, scores, ids in best.values():
                n = scores.shape[1]
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(np.repeat(np.arange(len(q_ids)), n))), pa.array(ids.ravel().tolist()), pa.array(scores.ravel())], ["query_id", "id", "score"])
            best.clear()

        for batch in batches:
            for n in range(batch.num_rows):
                q_ids, q_raw, ids, raw = (batch.column(c)[n] for c in range(4))
                key, ids = q_raw.as_py(), ids.as_py()
                q, v = (np.frombuffer(x, np.float64).reshape(m, -1) for x, m in ((key, len(q_ids)), (raw.as_py(), len(ids))))
                own = np.round(q @ v.T, 6)
                names = np.broadcast_to(np.array(ids, object if id_kind == "string" else np.int64)[None, :], own.shape)
                if key in best:
                    own, names = np.concatenate([best[key][1], own], 1), np.concatenate([best[key][2], names], 1)
                order = np.stack([np.lexsort((x, -s))[:k] for s, x in zip(own, names, strict=True)])
                best[key] = (q_ids.values, np.take_along_axis(own, order, 1), np.take_along_axis(names, order, 1))
                if len(best) > 64:
                    yield from results()
        yield from results()

    joined = right.join(left, ["_cell", "dim"]).select("q_ids", "q_matrix", "ids", "matrix")
    return ranked(joined.mapInArrow(run, f"query_id {kind}, id {id_kind}, score double"), k)


def inner_product(a: Column, b: Column) -> Column:
    """A native inner product in double precision, for joins of few rows."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


class InvertedFile:
    """Approximate top-k: vectors are assigned to centroids, and a query probes the nearest cells."""

    def __init__(self, vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", cells: int = 64, sample: int = 50_000, seed: int = 1):
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("v is not null")
        n = rows.count()
        drawn = rows if n <= sample else rows.sample(fraction=min(1.0, sample / n), seed=seed)  # centroids only; every row is indexed
        fitted = KMeans(k=max(1, min(cells, n)), seed=seed, featuresCol="f").fit(drawn.withColumn("f", array_to_vector("v")))
        self.centres = np.array(fitted.clusterCenters())
        self.cells = rows.withColumn("cell", self._nearest(F.col("v"), 1)[0])

    def _nearest(self, vec: Column, n: int) -> Column:
        centres = self.centres

        @F.pandas_udf("array<int>")
        def run(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy())
            d = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
            return pd.Series(list(np.argsort(d, 1, kind="stable")[:, :n].astype(np.int32)))

        return run(vec)

    def search(self, queries: DataFrame, k: int = 100, probes: int = 56, vec_col: str = "embedding") -> DataFrame:
        asked = queries.select("query_id", F.col(vec_col).alias("q")).withColumn("cell", F.explode(self._nearest(F.col("q"), probes)))
        return ranked(self.cells.join(asked, "cell").select("query_id", "id", F.round(inner_product(F.col("q"), F.col("v")), 6).alias("score")), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of the exact rows that were found, by query."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


__all__ = ["Encoder", "InvertedFile", "Window", "encode_column", "hashed_words", "inner_product", "normalised", "recall", "search", "with_embeddings"]
