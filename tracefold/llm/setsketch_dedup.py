"""Near-duplicate documents by SetSketch registers.

A document's set are the distinct shingles of its words.  Its sketch holds
``bands * width`` registers: register i is ``floor(1 - log_b(x))``, cut to 16
bits, of the smallest exponential x that the shingles give under the i-th
hash.  Registers of a union are the larger ones, and two are equal with about
the Jaccard similarity of the sets.  Bands of registers make candidates;
for a candidate pair the joint likelihood of the counts of larger, smaller and
equal registers (the set sizes being known) tells whether the similarity can
reach the limit; what can is verified on the full sets.

Steps, each linear in the documents but for pairs of different texts in one
bucket that aren't linked:

1. sketch every document; documents with equal sets form one node;
2. in each bucket of a band, every node is paired with the smallest node; each
   node verifies the pair of highest likelihood, and components are formed;
3. buckets that still hold several components go through further such rounds,
   each with other nodes in the middle, so that large groups of near copies,
   of which most aren't linked directly, grow together;
4. where several components are left in a bucket, the nodes outside its largest
   one are compared with all others of another component, block by block on
   registers; nodes with a pair that can reach the limit (in its first common
   bucket) come again with their full sets, and such pairs are verified there;
5. components of all links give the result.

So links inside a component aren't all looked at, which can't change it.  Two
documents at similarity 0.8 miss each other in all bands with probability
(1 - 0.8^width)^bands, 5e-6 for the defaults.

Defined results: null and empty texts have an empty set and are linked with
nothing; rows of a null id are linked with nothing and kept; repeated rows are
one document; ties go to the smaller id; extra columns are ignored; an empty
table gives an empty result; texts of any length are sketched whole, a text being
the least that a task handles at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import LOWER, WordHashes, column, kept, mix, slices
from tracefold.llm.components import components

BASE, RATE, TOP = 1.001, 20.0, 65535
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: list[str | None], words: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, document after document, and how many each has."""
    flat, sizes = [], []
    for text in texts:
        own = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        flat += own
        sizes.append(len(own))
    h, n = hashes.of(flat), np.array(sizes, np.int64)
    ends = np.cumsum(n)
    counts = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        rolled = rolled * _FACTOR + h[j : j + len(rolled)]
    first = np.repeat(ends - n, counts)  # of the document's words
    at = first + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.empty(len(at), np.uint64)
    long, after = np.repeat(n >= words, counts), np.cumsum(counts)
    out[long] = mix(rolled[at[long]])
    for k in np.flatnonzero((n > 0) & (n < words)):
        acc = np.array([n[k]], np.uint64)
        for x in h[ends[k] - n[k] : ends[k]]:
            acc = mix(acc * _FACTOR + x)
        out[after[k] - 1] = acc[0]
    return out, counts


class Sketcher:
    """Sketches of sets of 64-bit hashes."""

    def __init__(self, registers: int, seed: int = 7):
        self.odd = np.random.default_rng(seed).integers(0, 1 << 63, registers, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A row of registers for each set; sets are not empty."""
        flat = flat ^ (flat >> np.uint64(29))
        starts = np.cumsum(counts) - counts
        least, buffer = np.empty((len(counts), len(self.odd)), np.uint64), np.empty(len(flat), np.uint64)
        for i, odd in enumerate(self.odd):
            np.multiply(flat, odd, out=buffer)
            least[:, i] = np.minimum.reduceat(buffer, starts)
        x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / RATE
        return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def likely(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n1: np.ndarray, n2: np.ndarray, limit: float, odds: float = 14.0) -> tuple[np.ndarray, np.ndarray]:
    """The similarity of greatest joint likelihood, and whether ``limit`` can be reached.

    A pair is given up if ``limit`` is less likely by more than ``odds`` (natural
    log) than the best value below it, or if the sizes rule the limit out.  Twice
    the gap of a pair at the limit has about a chi-square distribution of one
    degree, so such a pair is given up with a probability of some 6e-8 at ``odds`` 14.
    """
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 51)[None, :] * most[:, None]

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
        terms = ((larger, up), (smaller, down), (equal, 1 - up - down))
        return sum(np.where(c[:, None] > 0, c[:, None] * np.log(np.maximum(q, 1e-12)), 0) for c, q in terms)

    values = log_likelihood(grid)
    best = values.argmax(1)
    at = np.minimum(limit, most)
    gap = values[np.arange(len(best)), best] - log_likelihood(at[:, None])[:, 0]
    estimate = grid[np.arange(len(best)), best]
    return estimate, (most >= limit - 1e-12) & ((estimate >= limit) | (gap <= odds))


def _compare(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    # The larger set tends to have the larger registers.
    return likely((a > b).sum(1), (a < b).sum(1), (a == b).sum(1), na.astype(float), nb.astype(float), limit)


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, words: int, registers: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """_id, n_shingles, print (of the set; null if empty) and sketch of each row, and the columns of ``carry`` as _c0, _c1..."""
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketcher = WordHashes(), Sketcher(registers)
        for batch in slices(batches, text_col):
            flat, counts = shingle_hashes(column(batch, text_col).to_pylist(), words, hashes)
            some = np.flatnonzero(counts)
            prints, sketches, sizes = [None] * batch.num_rows, [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            if len(some):
                rows = sketcher(flat, counts[some])
                ends = np.cumsum(counts)
                for row, k in zip(rows, some.tolist(), strict=True):
                    own = np.unique(flat[ends[k] - counts[k] : ends[k]])
                    sizes[k], prints[k], sketches[k] = len(own), xxhash.xxh3_128_digest(own.tobytes()), row.tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(sizes), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), *(column(batch, c) for c in carry)], ["_id", "n_shingles", "print", "sketch", *(f"_c{k}" for k in range(len(carry)))])

    more = "".join(f", _c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    return docs.select(*dict.fromkeys([id_col, text_col, *carry])).mapInArrow(run, f"_id {kind}, n_shingles long, print binary, sketch binary{more}")


def _band_keys(nodes: DataFrame, bands: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(column(batch, "sketch").to_pylist()), np.uint16).reshape(batch.num_rows, bands, width).astype(np.uint64)
            keys = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
            for j in range(width):
                keys = mix(keys * _FACTOR + rows[:, :, j])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(rows))), pa.array(np.repeat(column(batch, "node").to_numpy(), bands))], ["key", "band", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, band int, node long")


def _estimated(pairs: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """``pairs`` (a, b) that can reach ``limit``, with their estimate."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * limit - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                sa, sb = (np.frombuffer(b"".join(column(b, c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                estimate, can = _compare(sa, sb, column(b, "na").to_numpy(), column(b, "nb").to_numpy(), limit)
                yield pa.RecordBatch.from_arrays([column(b, "a"), column(b, "b"), pa.array(estimate)], ["a", "b", "estimate"]).filter(pa.array(can))

    return joined.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long, estimate double")


@contextmanager
def _filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Lets Spark put a Bloom filter of a small side (10 MB at most) before the exchange of the other, whatever its size."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """node and members (sorted hashes) of the nodes of ``wanted`` (node, min_id, print), as a written table.

    Few texts are wanted; a Bloom filter of their ids spares the others the exchange.
    """
    import xxhash

    wanted = kept(wanted)[0].filter("node >= 0")  # the comparison (always true) tells the optimizer that the side is worth a filter
    rows = docs.select(F.col(id_col).alias("min_id"), F.col(text_col).alias("text")).join(wanted, "min_id").select("node", "print", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            flat, counts = shingle_hashes(column(batch, "text").to_pylist(), words, hashes)
            ends, nodes, members = np.cumsum(counts), [], []
            for k, (node, mark) in enumerate(zip(column(batch, "node").to_pylist(), column(batch, "print").to_pylist(), strict=True)):
                own = np.unique(flat[ends[k] - counts[k] : ends[k]]).tobytes()
                if xxhash.xxh3_128_digest(own) == mark:
                    nodes.append(node)
                    members.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(members, pa.binary())], ["node", "members"])

    with _filtered_joins(docs.sparkSession):
        return kept(rows.mapInArrow(run, "node long, members binary"))[0]


def _linked(x: bytes, y: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among ``pairs``: 100 * intersection >= percent * union on full sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"m{x}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(column(batch, "ma"), column(batch, "mb"), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _mixed(members: DataFrame, block: int = 512) -> DataFrame:
    """The rows of ``members`` (key, band, node, comp) in buckets of several components.

    Adds the largest component of the bucket, and how many blocks its nodes
    (``across``) and those outside that component (``down``) make.
    """
    by = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    by = by.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    by = by.select("key", F.col("main.comp").alias("main"), F.ceil(F.col("n") / block).cast("long").alias("across"), F.ceil((F.col("n") - F.col("main.n")) / block).cast("long").alias("down"))
    return members.join(by, "key")


def _across(mixed: DataFrame, nodes: DataFrame, sets: DataFrame | None, bands: int, limit: float, percent: int) -> DataFrame:
    """The links (a, b) of one bucket and different components.

    Without ``sets``, the rows (key, node) of ``mixed`` that take part in a pair to verify.
    """
    mixed = mixed.join(nodes.select("node", "sketch", "n_shingles"), "node")
    if sets is not None:
        mixed = mixed.join(sets, "node")
    cell = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keep = ["key", "band", "node", "comp", "sketch", "n_shingles"] + ["members"] * (sets is not None)
    names = ["a", "b"] if sets is not None else ["key", "node"]
    probes = mixed.filter("comp <> main").select(*keep, F.lit(True).alias("probe"), cell("down").alias("i"), every("across").alias("j"))
    others = mixed.select(*keep, F.lit(False).alias("probe"), cell("across").alias("j"), every("down").alias("i"))
    cells = probes.unionByName(others).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("probe"))

    sets_given = sets is not None

    def compared(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(group).combine_chunks()
        node, comp, size, probe, band = (b.column(c).to_numpy() for c in ("node", "comp", "n_shingles", "probe", "band"))
        full = b.column("members") if sets_given else None
        place = np.flatnonzero(np.r_[True, np.any([np.diff(b.column(c).to_numpy()) != 0 for c in ("key", "i", "j")], axis=0), True])
        sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(len(node), -1)
        first, second, held = [], [], 0
        for k, (x, y) in enumerate(zip(place[:-1], place[1:], strict=True)):
            n = int(probe[x:y].sum())
            p, q = np.repeat(np.arange(x, x + n), y - x - n), np.tile(np.arange(x + n, y), n)
            ok = (comp[p] != comp[q]) & (np.minimum(size[p], size[q]) >= limit * np.maximum(size[p], size[q]) - 1e-6)
            first.append(p[ok])
            second.append(q[ok])
            held += int(ok.sum())
            if held < 8192 and k < len(place) - 2:
                continue
            p, q, first, second, held = np.concatenate(first), np.concatenate(second), [], [], 0
            for at in range(0, len(p), 8192):
                pp, qq = p[at : at + 8192], q[at : at + 8192]
                _, can = _compare(sketch[pp], sketch[qq], size[pp], size[qq], limit)
                if not can.any():
                    continue
                pp, qq = pp[can], qq[can]
                same = (sketch[pp] == sketch[qq]).reshape(len(pp), bands, -1).all(2)
                here = same.argmax(1) == band[pp]  # other common buckets need not look again
                pp, qq = pp[here], qq[here]
                if not sets_given:
                    rows = np.unique(np.r_[pp, qq])
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows)).combine_chunks(), pa.array(node[rows])], names)
                    continue
                ok = np.array([_linked(full[x].as_buffer(), full[y].as_buffer(), percent) for x, y in zip(pp.tolist(), qq.tolist(), strict=True)], bool)
                a, c = node[pp[ok]], node[qq[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, c)), pa.array(np.minimum(a, c))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.any([np.diff(column(batch, c).to_numpy()) != 0 for c in ("key", "i", "j")], axis=0)
            ends = np.flatnonzero(keys)
            if waiting:
                last = waiting[-1].slice(waiting[-1].num_rows - 1)
                if any(column(last, c)[0].as_py() != column(batch, c)[0].as_py() for c in ("key", "i", "j")):
                    yield from compared(waiting)
                    waiting = []
            if len(ends):
                to = int(ends[-1]) + 1
                waiting.append(batch.slice(0, to))
                yield from compared(waiting)
                waiting = [batch.slice(to)]
            else:
                waiting.append(batch)
        if waiting:
            yield from compared(waiting)

    return cells.mapInArrow(run, f"{names[0]} long, {names[1]} long").distinct()


def _best(estimated: DataFrame) -> DataFrame:
    """The pair of highest estimate of each node ``a``."""
    return estimated.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("top")).select("a", F.col("top.b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, carry: tuple[str, ...] = (), words: int = 5, percent: int = 80, bands: int = 40, width: int = 6, rounds: int = 2) -> DataFrame:
    """The id column, ``n_shingles``, ``component_id`` (smallest id linked, over any chain) and ``kept``.

    With ``carry``, also those columns and ``group``, a number of the component that rows of one id but
    unlinked texts don't share (null for empty sets and null ids).
    """
    limit = percent / 100
    rows, _ = kept(sketch_documents(docs, id_col, text_col, words, bands * width, carry))
    known = rows.filter(F.col("_id").isNotNull() & F.col("print").isNotNull())
    classes = known.groupBy("print").agg(F.min("_id").alias("min_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes, _ = kept(classes.withColumn("node", F.monotonically_increasing_id()))
    keys = _band_keys(nodes, bands, width)
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    members, _ = kept(keys.join(hubs, "key"))
    stars = members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    close = _estimated(stars, nodes, limit)
    best, _ = kept(_best(close))
    facts = nodes.select("node", "min_id", "print")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def checked(pairs: DataFrame) -> DataFrame:
        sets = _sets(docs, facts.join(ends(pairs), "node"), id_col, text_col, words)
        return kept(_verified(pairs, sets, percent))[0]

    def labelled(found: DataFrame) -> DataFrame:
        return members.join(found.withColumnRenamed("vertex", "node"), "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("comp"))

    links = checked(best)
    found, _ = kept(components(links))
    for turn in range(rounds):
        here = labelled(found)
        middle = here.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), "node", "comp")).alias("m")).filter("low < high")
        around = here.join(middle.select("key", "m"), "key").filter(F.col("comp") != F.col("m.comp")).select(F.col("node").alias("a"), F.col("m.node").alias("b")).distinct()
        best, _ = kept(_best(_estimated(around, nodes, limit)))
        new = checked(best)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        found, _ = kept(components(links))
    mixed, _ = kept(_mixed(labelled(found)))
    open_, _ = kept(_across(mixed, nodes, None, bands, limit, percent))
    mixed = mixed.join(open_, ["key", "node"], "left_semi")
    sets = _sets(docs, facts.join(open_.select("node").distinct(), "node"), id_col, text_col, words)
    final = components(links.unionByName(_across(mixed, nodes, sets, bands, limit, percent)))
    named = nodes.select("node", "print", "min_id").join(final.withColumnRenamed("vertex", "node"), "node", "left").select("print", "min_id", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("min_id").alias("component_id"))
    labels = named.join(smallest, "component").select("print", "component_id", "component")
    out = rows.select("_id", "n_shingles", "print", *(f"_c{k}" for k in range(len(carry)))).join(labels, "print", "left")
    component = F.when(F.col("_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "_id"))
    more = [F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)] + [F.when(F.col("_id").isNotNull(), F.col("component")).alias("group")] * bool(carry)
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"), *more)
