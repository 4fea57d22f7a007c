"""Exact nearest neighbours by a block matrix join.

Vectors are quantised to int8 with one scale per vector and packed into
blocks; each block of queries meets each block of candidates once, as a tile,
which is one product of the int8 codes.  With q = s*a + e, where e is the
quantisation residue of known norm, the distance of two vectors lies within
|e_q| + |e_v| of the distance of their quantised forms.  Only pairs whose lower
bound does not exceed the query's k-th distance so far (at first: its k-th
upper bound) survive; they are recomputed in double precision and go to the k
best of their query.  So the result is exact.

The tiles come from a grid of cells: candidate blocks are dealt to ``groups``
columns, query blocks to as many rows as bound the queries that a task holds.
A cell gets the queries of its row first and then streams the candidates of
its column, so every block reaches a cell once.  There are at most so many
columns that the copies of queries take about half the candidates' room, and
nothing is broadcast or sent to the driver but three counts.

Vectors that are null, zero, or hold a null or non-finite component take no
part.  Ties go to the smaller id; a row never meets itself, but other rows
with the same id and vector are candidates like any other.  Distances whose
squares overflow are infinite, and tie.  Null ids take no part; extra columns
are ignored; an empty table gives an empty result; a vector of any length is
compared with those of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.llm.common import column, one_blas_thread

#: Bytes of queries, with what is found for them, that a task holds.
PIECE_BYTES = 192 << 20

#: Stands for no neighbour.
NONE = np.iinfo(np.int64).max


def _blocks(batches: Iterator[pa.RecordBatch], size: int, deal: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Packs rows (row, vid, vec) into blocks of vectors of one length, dealt to ``deal`` places in turn."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    place = int(TaskContext.get().partitionId() * 0.6180339887498949 % 1 * deal)  # where a task begins, far from its neighbours

    def packed(dim: int, least: int) -> Iterator[pa.RecordBatch]:
        nonlocal place
        ids, vectors = (np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True))
        at = 0
        while len(ids) - at >= least:
            place = (place + 1) % deal
            part = slice(at, at + size)
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids[part].tobytes()], pa.binary()), pa.array([vectors[part].tobytes()], pa.binary())], ["place", "dim", "ids", "vectors"])
            at += size
        if at < len(ids):
            waiting[dim] = [(ids[at:], vectors[at:])]

    for batch in batches:
        vec = column(batch, "vec")
        lengths = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False)
        values = pc.cast(vec.flatten(), pa.float32() if kind == "f4" else pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # null: not a number
        starts = np.cumsum(lengths) - lengths
        ids = np.stack([column(batch, c).to_numpy(zero_copy_only=False) for c in ("row", "vid")], 1).astype(np.int64)
        for dim in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == dim)
            x = values[starts[own][:, None] + np.arange(dim)]
            usable = np.isfinite(x).all(1) & x.any(1)
            if usable.any():
                waiting.setdefault(dim, []).append((ids[own[usable]], x[usable]))
                if sum(len(i) for i, _ in waiting[dim]) >= size:
                    yield from packed(dim, size)
    for dim in sorted(waiting):
        yield from packed(dim, 1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each vector, and the norm of what the codes miss."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def tile(queries: np.ndarray, vectors: np.ndarray, k: int, kth: np.ndarray, same: np.ndarray | None, coded: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, vector, distance) of a tile that can be among the ``k`` nearest.

    ``kth`` holds an upper bound of each query's k-th distance from other tiles;
    ``same`` marks pairs of a row with itself, ``coded`` is ``quantise(vectors)``.
    Bounds that overflow exclude nothing.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        return _tile(queries, vectors, k, kth, same, coded or quantise(vectors))


def _tile(queries: np.ndarray, vectors: np.ndarray, k: int, kth: np.ndarray, same: np.ndarray | None, coded: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (qa, qs, qe), (va, vs, ve) = quantise(queries), coded
    kind = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (qa.astype(kind) @ va.astype(kind).T).astype(np.float64)
    qn, vn = (np.square(a.astype(np.float64)).sum(1) * s * s for a, s in ((qa, qs), (va, vs)))
    about = np.sqrt(np.maximum(qn[:, None] + vn[None, :] - 2 * product * qs[:, None] * vs[None, :], 0))
    slack = (qe[:, None] + ve[None, :]) * (1 + 1e-9) + 1e-7 * (np.sqrt(qn)[:, None] + np.sqrt(vn)[None, :])
    high = about + slack
    if same is not None:
        high[same] = np.inf
        about[same] = np.inf
    if high.shape[1] > k:
        kth = np.minimum(kth, np.partition(high, k - 1, axis=1)[:, k - 1])
    q, v = np.nonzero(~(about - slack > kth[:, None]))  # not a number: kept
    if same is not None:
        own = same[q, v]
        q, v = q[~own], v[~own]
    exact = np.empty(len(q))
    for a in range(0, len(q), 65536):
        exact[a : a + 65536] = distances(queries[q[a : a + 65536]], vectors[v[a : a + 65536]])
    return q, v, exact


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row, the squares added in the order of the components."""
    total = np.empty(len(x))
    for a in range(0, len(x), 1024):  # as much as the cache holds
        square = np.square(x[a : a + 1024] - y[a : a + 1024])
        total[a : a + 1024] = np.add.accumulate(square, axis=1)[:, -1]
    return np.sqrt(total)


class Codes:
    """Quantised vectors as a side of a tile.

    ``fit`` marks those for which float32 bounds hold: squares neither overflow
    nor vanish, and the residue is small beside the vector.
    """

    def __init__(self, vectors: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            self.codes, self.scale, missed = quantise(vectors.astype(np.float64))
            self.square = np.square(self.codes.astype(np.float32)).sum(1, dtype=np.float64) * self.scale * self.scale
            norm = np.sqrt(self.square)
            self.missed = missed * (1 + 1e-9) + 1e-7 * norm
            self.fit = (norm > 1e-15) & (norm < 1e15) & (vectors.shape[1] * 127 * 127 < 1 << 24)
        self.loss = 4 * (vectors.shape[1] + 8) * 2.0**-24  # of a float32 product, as a share of the squares in it

    def right(self) -> np.ndarray:
        return np.concatenate([self.codes * self.scale[:, None], (self.square * (1 - self.loss) - self.missed**2)[:, None], self.missed[:, None]], 1).astype(np.float32)

    def left(self, at: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose product with a row of ``right`` reaches the second result if the distance can be ``kth`` or less.

        With a = kth + |e_q|, that is |q|^2 + |v|^2 - 2qv <= (a + |e_v|)^2 for the quantised forms.
        """
        a = kth + self.missed[at]
        rows = np.concatenate([self.codes[at] * (2 * self.scale[at])[:, None], np.full((len(at), 1), -1.0), 2 * a[:, None]], 1).astype(np.float32)
        return rows, (self.square[at] * (1 - self.loss) - a * a * (1 + self.loss)).astype(np.float32)


class Best:
    """Queries of one length, and for each the ``k`` smallest (distance, id, row) so far, in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k, self.coded = ids, vectors, k, Codes(vectors)
        self.dist = np.full((len(ids), k), np.inf)
        self.vid, self.row = (np.full((len(ids), k), NONE) for _ in range(2))

    def meet(self, ids: np.ndarray, vectors: np.ndarray, step: int = 512) -> None:
        """Takes a block of candidates; tiles of ``step`` queries bound the memory."""
        coded, wide = Codes(vectors), vectors.astype(np.float64)
        if coded.fit.any() and not coded.fit.all():
            for part in (coded.fit, ~coded.fit):
                self.meet(ids[part], vectors[part], step)
            return
        right = coded.right().T if coded.fit.all() else None
        for begin in range(0, len(self.ids), step):
            at = np.arange(begin, min(begin + step, len(self.ids)))
            kth = self.dist[at, -1]
            quick = self.coded.fit[at] & (right is not None)
            if len(new := np.flatnonzero(quick & ~(kth < 1e15))) and len(ids) > self.k:
                kth[new] = self.first_bound(at[new], ids, wide, right)
            quick &= kth < 1e15
            if quick.any():
                own = at[quick]
                left, least = self.coded.left(own, kth[quick])
                q, v = np.divmod(np.flatnonzero(left @ right >= least[:, None]), len(ids))
                q = own[q]
                for a in range(0, len(q), 65536):
                    self.add(q[a : a + 65536], ids[v[a : a + 65536]], distances(self.vectors[q[a : a + 65536]].astype(np.float64), wide[v[a : a + 65536]]))
            if not quick.all():
                own = at[~quick]
                same = self.ids[own, 0][:, None] == ids[None, :, 0]
                q, v, dist = tile(self.vectors[own].astype(np.float64), wide, self.k, kth[~quick], same if same.any() else None)
                self.add(own[q], ids[v], dist)

    def first_bound(self, at: np.ndarray, ids: np.ndarray, wide: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ``k``-th distance to some candidates of a block, those that look nearest."""
        near = np.argpartition(self.coded.left(at, np.zeros(len(at)))[0] @ right, len(ids) - self.k - 1, axis=1)[:, -self.k - 1 :]
        dist = distances(np.repeat(self.vectors[at].astype(np.float64), self.k + 1, 0), wide[near.ravel()]).reshape(near.shape)
        dist[self.ids[at, :1] == ids[near, 0]] = np.inf  # itself
        return np.sort(dist, 1)[:, self.k - 1]

    def add(self, q: np.ndarray, found: np.ndarray, dist: np.ndarray) -> None:
        row, vid = found.T
        far, last = self.dist[q, -1], self.vid[q, -1]
        keep = ((dist < far) | (dist == far) & (vid <= last)) & (row != self.ids[q, 0])
        if not keep.any():
            return
        q, dist, vid, row = q[keep], dist[keep], vid[keep], row[keep]
        known = np.unique(q)
        every = [np.concatenate(x) for x in ((np.repeat(known, self.k), q), (self.dist[known].ravel(), dist), (self.vid[known].ravel(), vid), (self.row[known].ravel(), row))]
        order = np.lexsort(every[::-1])
        q, dist, vid, row = (x[order] for x in every)
        first = np.searchsorted(q, known)[:, None] + np.arange(self.k)  # at least k each
        self.dist[known], self.vid[known], self.row[known] = dist[first], vid[first], row[first]

    def rows(self, size: int = 10_000) -> Iterator[pa.RecordBatch]:
        """A row for each query with any: its ``k`` distances, ids and rows, one after the other."""
        some = np.flatnonzero(self.row[:, 0] != NONE)
        for a in range(0, len(some), size):
            at = some[a : a + size]
            packed = np.stack([self.dist[at].view(np.int64), self.vid[at], self.row[at]], 1)
            ends = np.arange(len(at) + 1, dtype=np.int32) * (24 * self.k)
            found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[at, 0]), pa.array(self.ids[at, 1]), found], ["query_row", "query_id", "found"])


_FOUND = "query_row long, query_id long, found binary"


def _tiles(batches: Iterator[pa.RecordBatch], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """A cell: blocks of queries, then blocks of candidates."""
    one_blas_thread()
    asked: dict[int, list] = {}
    best: dict[int, Best] = {}
    for batch in batches:
        for n in range(batch.num_rows):
            candidates, dim, ids, vectors = (column(batch, c)[n].as_py() for c in ("candidates", "dim", "ids", "vectors"))
            block = np.frombuffer(ids, np.int64).reshape(-1, 2), np.frombuffer(vectors, kind).reshape(-1, dim)
            if not candidates:
                asked.setdefault(dim, []).append(block)
                continue
            if dim in asked:
                best[dim] = Best(*(np.concatenate(x) for x in zip(*asked.pop(dim), strict=True)), k)
            if dim in best:
                best[dim].meet(*block)
    for one in best.values():
        yield from one.rows()


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest of each query row, numbered, from what its cells found; rows of a query follow each other."""

    def ranked(ids: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        dist, vid, row = (found[:, n].ravel() for n in range(3))
        query = np.repeat(np.arange(len(ids)), k)
        query = np.cumsum(np.r_[True, ids[1:, 0] != ids[:-1, 0]])[query]
        order = np.lexsort((row, vid, dist.view(np.float64), query))
        order = order[row[order] != NONE]
        head = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]])
        rank = np.arange(1, len(order) + 1) - np.repeat(head, np.diff(np.r_[head, len(order)]))
        order, rank = order[rank <= k], rank[rank <= k]
        return pa.RecordBatch.from_arrays([pa.array(ids[order // k, 1]), pa.array(rank, pa.int32()), pa.array(vid[order]), pa.array(dist.view(np.float64)[order])], ["query_id", "rank", "vec_id", "score"])

    ids, found = np.empty((0, 2), np.int64), np.empty((0, 3, k), np.int64)
    for batch in batches:
        ids = np.concatenate([ids, np.stack([column(batch, c).to_numpy(zero_copy_only=False) for c in ("query_row", "query_id")], 1)])
        found = np.concatenate([found, np.frombuffer(b"".join(column(batch, "found").to_pylist()), np.int64).reshape(-1, 3, k)])
        done = int(np.searchsorted(ids[:, 0], ids[-1, 0])) if len(ids) else 0  # more rows of the last query may come
        if done:
            yield ranked(ids[:done], found[:done])
            ids, found = ids[done:], found[done:]
    if len(ids):
        yield ranked(ids, found)


def grid(rows: int, queries: int, dim: int, *, k: int, block: int, most: int, wide: int = 4) -> tuple[int, int]:
    """Rows and columns of the grid, for so many usable rows and queries of up to ``dim`` components.

    A row's queries take ``PIECE_BYTES`` at most, and the columns copy the
    queries into half the room that the rows copy the candidates into, but for
    16 columns that any grid may have.
    """
    pieces = max(1, -(-queries * (dim * (wide + 1) + 48 + 24 * k) // PIECE_BYTES))
    return pieces, max(1, min(most, -(-rows // block), max(16, rows * pieces // (2 * max(queries, 1)))))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 10, block: int = 2048, groups: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of each query row: query_id, rank, vec_id, score (Euclidean).

    ``block`` bounds the vectors of a block and ``groups`` names the columns of
    the grid (by default as ``grid`` has it, up to the shuffle partitions).
    The rows are counted at once, for the size of the grid.
    """
    spark = vectors.sparkSession
    kind = "f4" if vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vec_col].dataType.containsNull) else "f8"
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vid"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    usable = rows.filter(F.col("vid").isNotNull())
    n, queries, dim = usable.agg(F.count("*"), F.count_if("_q"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    pieces, columns = grid(n, queries, dim, k=k, block=block, most=int(spark.conf.get("spark.sql.shuffle.partitions")), wide=4 if kind == "f4" else 8)
    columns = groups or columns

    def blocks(side: DataFrame, deal: int, copies: int) -> DataFrame:
        packed = side.select("row", "vid", "vec").mapInArrow(lambda b: _blocks(b, block, deal, kind), "place long, dim int, ids binary, vectors binary")
        return packed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    asked = blocks(usable.filter("_q").repartition(max(1, queries // (4 * block))), pieces, columns)
    others = blocks(usable, columns, pieces)
    fields = "dim", "ids", "vectors"
    cells = asked.select(F.lit(0).alias("candidates"), (F.col("place") * columns + F.col("copy")).cast("int").alias("cell"), *fields)
    cells = cells.union(others.select(F.lit(1), (F.col("copy") * columns + F.col("place")).cast("int"), *fields))
    # by the cell's number itself, not a hash of it, under which some tasks would get several cells and some none
    cells = cells.repartitionById(pieces * columns, F.col("cell")).sortWithinPartitions("candidates")
    found = cells.select("candidates", *fields).mapInArrow(lambda b: _tiles(b, k, kind), _FOUND)
    ordered = found.repartition("query_row").sortWithinPartitions("query_row")
    return ordered.mapInArrow(lambda b: _merged(b, k), "query_id long, rank int, vec_id long, score double")
