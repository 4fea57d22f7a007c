"""Language-model scores from a log-bilinear model with a count-based base.

Base: every token counts, over all learning documents, with half a count added
(``log10((c + 0.5) / (N + 0.5 (V + 1)))``).

Model: the list holds the words met at least ``min_count`` times, the
``most_words`` most frequent if there are more, so it grows with the corpus up
to what a worker can hold.  Outputs have two levels: the most frequent words are
classes of their own, the other listed words are dealt to groups of words with
similar endings, and all remaining words to ``rests`` classes by a hash of
their ending, so every word has learnt vectors, if shared ones.  With context
vectors r (of listed words and rest classes), position weights C, output
vectors q and biases b, class k has the score ``(C1 r_u1 + C2 r_u2) . q_k + b_k``
after the tokens u1, u2; the softmax over classes normalises it.  Words of a group have scores
of the same form, normalised within the group; words of a rest class share it
by their base counts, with one unseen word.  So all probabilities sum to one.

Training is noise-contrastive estimation in numpy on both levels: classes
against noise shared by a batch, words of a group against noise of the group.
Learning documents are dealt to shards of about ``shard_docs`` by a hash of
their id and text, each shard trains from the same vectors in the order of
that hash, and the vectors of all shards are averaged, each row weighed by how
often a shard used it; this is repeated for ``epochs``.  An epoch takes every
``epochs``-th token of each document, the next one beginning a token later, so
each token of each document is a target once.  Averages are sums of fixed-point
integers, so neither partitions nor their order change a result.  They are
formed on executors; the driver sees one model an epoch.

Scoring multiplies the context vectors of the distinct contexts of a slice
with all class vectors at once (batched matrix products), and those of the
tokens of each group with the group's.

Steps: words are counted (partial counts a task); texts are encoded once, as a
written table that training and scoring read.  Words outside the list need
their base counts per document: each slice of documents sends, per bucket of
word hashes, one packed row of (word, document, times); a bucket counts its
words over the learning documents and sends the counts back to the slice, which
sums ``log10(c + 0.5)`` per document.  Buckets grow in number with the corpus.  A
listed word, be it a third of all tokens, takes no part in this.

Defined results: a null or empty text is the end token alone; a null id is not
held out; repeated rows are separate documents, each counted; without learning
rows all counts are 0 and the model is untrained; an empty table gives an empty
result; extra columns are ignored; texts of any length are counted, trained on
and scored whole, a document being the least that a task handles at once.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracefold.llm.common import column, discard, kept, one_blas_thread, slices, words_of

END = b"\n"  # no word holds a line end
RESTS = 32


def rest_class(word: bytes) -> int:
    """The class of a word outside the list, by its ending."""
    return zlib.crc32(word[-3:]) % RESTS


def count_words(docs: DataFrame, learn_col: str, text_col: str) -> tuple[DataFrame, str]:
    """word, n (a written table and its path): all words of the rows where ``learn_col`` is true, the end of each text among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts: Counter[bytes] = Counter()
        for batch in slices(batches, "text"):
            texts = column(batch, "text").to_pylist()
            for text in texts:
                counts.update(words_of(text, lower=True))
            counts[END] += len(texts)
            if len(counts) > 500_000:
                yield packed()
                counts = Counter()
        if counts:
            yield packed()

    parts = docs.filter(learn_col).select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return kept(parts.groupBy("word").agg(F.sum("n").alias("n")))


@dataclass
class Words:
    """The listed words in the order of their codes, and what is known of the others.

    The first ``singles`` codes are classes of their own; the codes of group g
    begin at ``edges[g]`` and end at ``edges[g + 1]``.  Rest classes follow the listed
    words, and the start of a text is the last code.
    """

    words: list[bytes]
    counts: np.ndarray
    singles: int
    edges: np.ndarray
    rest_n: np.ndarray  # tokens and distinct words of each rest class
    rest_v: np.ndarray

    @property
    def start(self) -> int:
        return len(self.words) + RESTS

    @property
    def total(self) -> int:
        return int(self.counts.sum() + self.rest_n.sum())

    @property
    def distinct(self) -> int:
        return int((self.counts > 0).sum() + self.rest_v.sum())

    def class_of(self) -> np.ndarray:
        """The class of each code but the last."""
        groups = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges)) + self.singles
        return np.r_[np.arange(self.singles), groups, np.arange(RESTS) + self.singles + len(self.edges) - 1].astype(np.int64)


def list_words(counted: DataFrame, min_count: int = 20, most_words: int = 16_000, singles: int = 96, groups: int = 96) -> Words:
    """The list from a table of all words (word, n)."""
    top = counted.filter((F.col("n") >= min_count) | (F.col("word") == F.lit(bytearray(END)))).orderBy(F.desc("n"), "word").limit(most_words).collect()
    rows = [(bytes(r["word"]), r["n"]) for r in top]
    listed = {w for w, _ in rows}
    shared = counted.sparkSession.sparkContext.broadcast(listed)  # at most ``most_words`` words

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(RESTS, np.int64), np.zeros(RESTS, np.int64)
        for b in batches:
            for word, times in zip(column(b, "word").to_pylist(), column(b, "n").to_pylist(), strict=True):
                if word not in shared.value:
                    n[rest_class(word)] += times
                    v[rest_class(word)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RESTS)), pa.array(n), pa.array(v)], ["c", "n", "v"])

    found = {r["c"]: (r["n"], r["v"]) for r in counted.mapInArrow(rest, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    grouped = sorted(rows[singles:], key=lambda x: (x[0][::-1], x[0]))
    ordered = rows[:singles] + grouped
    edges = len(rows[:singles]) + np.linspace(0, len(grouped), min(groups, len(grouped)) + 1).astype(int) if grouped else np.array([len(ordered)])
    n, v = (np.array([found.get(c, (0, 0))[k] for c in range(RESTS)], np.int64) for k in (0, 1))
    return Words([w for w, _ in ordered], np.array([n for _, n in ordered], np.int64), len(rows[:singles]), edges, n, v)


class Coder(dict):
    """Numbers words as they are first met, and keeps the code and hash of each number.

    Listed words have their code as number; of others up to ``most`` are remembered.
    """

    def __init__(self, words: list[bytes], most: int = 400_000):
        import xxhash

        self.listed, self.n, self.most, self._hash = {w: k for k, w in enumerate(words)}, len(words), most, xxhash.xxh3_64_intdigest
        self.new: list[bytes] = []
        self._codes, self._hashes = np.arange(self.n, dtype=np.uint16), np.zeros(self.n, np.uint64)
        super().__init__(self.listed)

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words, each text followed by its end."""
        if len(self) > self.n + self.most:  # texts may overshoot, then all but the listed are forgotten
            self.clear()
            self.update(self.listed)
            self._codes, self._hashes = self._codes[: self.n], self._hashes[: self.n]
        flat = chain.from_iterable(chain(t, (END,)) for t in texts)
        out = np.fromiter(map(self.__getitem__, flat), np.int64, sum(map(len, texts)) + len(texts))
        if self.new:
            self._codes = np.r_[self._codes, np.fromiter((self.n + rest_class(w) for w in self.new), np.uint16, len(self.new))]
            self._hashes = np.r_[self._hashes, np.fromiter(map(self._hash, self.new), np.uint64, len(self.new))]
            self.new.clear()
        return out

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        return self._codes.take(numbers)

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        return self._hashes.take(numbers)


def contexts(codes: np.ndarray, starts: np.ndarray, start_code: int) -> tuple[np.ndarray, np.ndarray]:
    """The code before and the code two before each token; ``start_code`` before a text."""
    one = np.r_[start_code, codes[:-1]]
    one[starts] = start_code
    two = np.r_[start_code, one[:-1]]
    two[starts] = start_code
    return one, two


def targets(sizes: np.ndarray, epoch: int, epochs: int) -> np.ndarray:
    """Places of the tokens trained on in ``epoch``, for documents of ``sizes`` tokens laid end to end."""
    starts = np.cumsum(sizes) - sizes
    return np.flatnonzero((np.arange(sizes.sum()) - np.repeat(starts, sizes)) % epochs == epoch)


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the sums of their ``rows``, and how many each has."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # numpy sorts short integers by radix
    ordered = keys[order]
    at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[at], np.add.reduceat(rows.take(order, 0), at), np.diff(np.r_[at, len(keys)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Bilinear:
    """Parameters, training steps and scoring of the model."""

    #: Arrays of parameters; each row is averaged by how often shards used it.
    PARTS = ("context", "output", "word_output", "weights")

    def __init__(self, words: Words, dims: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.start, self.singles, self.edges, self.listed = words.start, words.singles, words.edges, len(words.words)
        self.class_of = words.class_of()
        n_classes = words.singles + len(words.edges) - 1 + RESTS
        mass = np.maximum(np.r_[words.counts, words.rest_n].astype(np.float64), 0.5)
        by_class = np.bincount(self.class_of, mass, n_classes)
        self.class_share = by_class / by_class.sum()
        self.class_ends = np.cumsum(self.class_share)[:-1]
        self.cumulative = np.cumsum(np.r_[0.0, mass[: self.listed]])
        self.word_share = mass / by_class[self.class_of]  # of a word in its class
        # The last column of outputs is the bias, that of contexts does nothing.
        self.context = (rng.standard_normal((self.start + 1, dims)) * 0.1).astype(np.float32)
        self.output = np.c_[rng.standard_normal((n_classes, dims)) * 0.1, np.log(self.class_share)].astype(np.float32)
        self.word_output = np.c_[rng.standard_normal((self.listed, dims)) * 0.1, np.log(self.word_share[: self.listed])].astype(np.float32)
        self.weights = np.full((2, dims), 0.5, np.float32)

    def fresh(self) -> Bilinear:
        """A copy to train, with the state of AdaGrad and the uses of each row."""
        own = copy.copy(self)
        for p in self.PARTS:
            setattr(own, p, getattr(self, p).copy())
        own.squares = {p: np.full(getattr(self, p).shape, 0.1, np.float32) for p in self.PARTS}
        own.uses = {p: np.zeros(len(getattr(self, p)), np.int64) for p in self.PARTS}
        return own

    def _step(self, part: str, rows: np.ndarray, gradient: np.ndarray, uses: np.ndarray | int, rate: float) -> None:
        own, all_squares = getattr(self, part), self.squares[part]
        squares = all_squares.take(rows, 0)
        squares += gradient * gradient
        all_squares[rows] = squares
        np.sqrt(squares, out=squares)
        np.divide(gradient, squares, out=squares)
        squares *= rate
        squares += own.take(rows, 0)
        own[rows] = squares
        self.uses[part][rows] += uses

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context.take(one, 0) * self.weights[0] + self.context.take(two, 0) * self.weights[1]

    def train(self, target: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator, noise: int = 24, group_noise: int = 2, rate: float = 0.1) -> None:
        """One step of noise-contrastive estimation on both levels, with AdaGrad scaling."""
        n, dims = len(target), self.context.shape[1]
        before = self.context.take(np.r_[one, two], 0)
        guess = before[:n] * self.weights[0] + before[n:] * self.weights[1]
        # Classes, against classes drawn for the whole batch.
        wanted = self.class_of.take(target)
        fake = np.searchsorted(self.class_ends, rng.random(noise), side="right")
        q, f = self.output.take(wanted, 0), self.output.take(fake, 0)
        rows = np.empty((n + noise, dims + 1), np.float32)
        error = _sigmoid(np.log(noise * self.class_share.take(wanted)).astype(np.float32) - np.einsum("nd,nd->n", guess, q[:, :dims]) - q[:, dims])
        wrong = -_sigmoid(guess @ f[:, :dims].T + (f[:, dims] - np.log(noise * self.class_share.take(fake)).astype(np.float32)))
        d_guess = wrong @ f[:, :dims]
        d_guess += error[:, None] * q[:, :dims]
        np.multiply(error[:, None], guess, out=rows[:n, :dims])
        rows[:n, dims] = error
        rows[n:, :dims] = wrong.T @ guess
        rows[n:, dims] = wrong.sum(0)
        keys, sums, times = _summed(np.r_[wanted, fake], rows)
        # Words of a group, each against words of its group.
        inner = np.flatnonzero((target >= self.singles) & (target < self.listed))
        if len(inner):
            word, group = target.take(inner), wanted.take(inner) - self.singles
            first, last = self.edges.take(group), self.edges.take(group + 1)
            low, high = self.cumulative.take(first), self.cumulative.take(last)
            drawn = np.searchsorted(self.cumulative, low[:, None] + rng.random((len(inner), group_noise)) * (high - low)[:, None], side="right") - 1
            both = np.concatenate([word[:, None], np.clip(drawn, first[:, None], last[:, None] - 1)], 1)
            w, g = self.word_output.take(both, 0), guess.take(inner, 0)
            off = -_sigmoid(np.einsum("nd,nkd->nk", g, w[:, :, :dims]) + w[:, :, dims] - np.log(group_noise * self.word_share.take(both)).astype(np.float32))
            off[:, 0] += 1
            d_guess[inner] += np.einsum("nk,nkd->nd", off, w[:, :, :dims])
            grown = np.empty(w.shape, np.float32)
            np.multiply(off[:, :, None], g[:, None, :], out=grown[:, :, :dims])
            grown[:, :, dims] = off
            self._step("word_output", *_summed(both.ravel(), grown.reshape(-1, dims + 1)), rate)
        self._step("output", keys, sums, times, rate)
        d_weights = np.stack([np.einsum("nd,nd->d", d_guess, before[:n]), np.einsum("nd,nd->d", d_guess, before[n:])])
        np.multiply(d_guess, self.weights[0], out=before[:n])
        np.multiply(d_guess, self.weights[1], out=before[n:])
        self._step("context", *_summed(np.r_[one, two], before), rate)
        self._step("weights", np.arange(2), d_weights, n, rate)

    def fixed_sums(self, bits: int) -> list[np.ndarray]:
        """Every part as integers: its rows times their uses, and the uses."""
        return [x for p in self.PARTS for x in (np.rint(np.ldexp(getattr(self, p).astype(np.float64) * self.uses[p][:, None], bits)).astype(np.int64), self.uses[p])]

    def average(self, sums: np.ndarray, bits: int) -> None:
        """Replaces the rows in use by the averages that sums of ``fixed_sums`` hold."""
        at = 0
        for p in self.PARTS:
            own = getattr(self, p)
            total = sums[at : at + own.size].reshape(own.shape)
            uses = sums[at + own.size : at + own.size + len(own)]
            at += own.size + len(own)
            some = uses > 0
            own[some] = (np.ldexp(total[some].astype(np.float64), -bits) / uses[some][:, None]).astype(np.float32)

    def log10_probability(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log probabilities of the codes: of listed words, and of rest classes as a whole."""
        by_class = np.ascontiguousarray(self.output[:, :-1].T)
        pairs, at = np.unique(one.astype(np.int64) * (self.start + 1) + two, return_inverse=True)
        norm = np.empty(len(pairs), np.float32)
        vectors = self.predicted(pairs // (self.start + 1), pairs % (self.start + 1))
        for a in range(0, len(pairs), 2048):
            norm[a : a + 2048] = _log_sums(vectors[a : a + 2048], by_class, self.output[:, -1])
        guess, wanted = vectors.take(at, 0), self.class_of.take(target)
        q = self.output.take(wanted, 0)
        score = np.einsum("nd,nd->n", guess, q[:, :-1]) + q[:, -1] - norm[at]
        inner = np.flatnonzero((target >= self.singles) & (target < self.listed))
        inner = inner[np.argsort(wanted[inner].astype(np.uint16), kind="stable")]
        ends = np.searchsorted(wanted[inner], np.arange(len(self.edges)) + self.singles)
        for g in np.flatnonzero(np.diff(ends)).tolist():
            own = inner[ends[g] : ends[g + 1]]
            block = self.word_output[self.edges[g] : self.edges[g + 1]]
            by_word = np.ascontiguousarray(block[:, :-1].T)
            q = self.word_output.take(target[own], 0)
            score[own] += (guess[own] * q[:, :-1]).sum(1) + q[:, -1]
            for a in range(0, len(own), 8192):
                score[own[a : a + 8192]] -= _log_sums(guess.take(own[a : a + 8192], 0), by_word, block[:, -1])
        return score.astype(np.float64) / np.log(10)


def _log_sums(guess: np.ndarray, outputs: np.ndarray, bias: np.ndarray) -> np.ndarray:
    s = guess @ outputs
    s += bias
    top = np.zeros(len(s), np.float32)
    if s.max() > 60:
        top = s.max(1)
        s -= top[:, None]
    np.exp(s, out=s)
    return np.log(s @ np.ones(s.shape[1], np.float32)) + top


_CODED = "slice long, place int, id {}, learn boolean, order long, n_tokens long, codes binary, bucket int, words binary, docs binary, times binary"


def encode(docs: DataFrame, words: Words, learn_col: str, id_col: str = "doc_id", text_col: str = "text", *, bucket_tokens: int = 4_000_000, slice_bytes: int = 4 << 20) -> DataFrame:
    """The codes of every row, and packed rows of the words outside the list, as a written table."""
    buckets = 1 + words.total // bucket_tokens
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    shared = docs.sparkSession.sparkContext.broadcast(words.words)
    # The order and shard of a document depend on nothing but its id and text.
    order = F.xxhash64(F.col(id_col).cast("string"), text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn_col, F.lit(True)).alias("learn"), order.alias("order"), F.monotonically_increasing_id().alias("row"))
    fields = [pa.field(*x) for x in (("slice", pa.int64()), ("place", pa.int32()), ("id", id_type), ("learn", pa.bool_()), ("order", pa.int64()), ("n_tokens", pa.int64()), ("codes", pa.binary()), ("bucket", pa.int32()), ("words", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for piece in slices(batches, "text", slice_bytes, 1 << 12):
            texts = [words_of(t, lower=True) for t in column(piece, "text").to_pylist()]
            n, name = len(texts), column(piece, "row")[0].as_py()
            sizes = np.fromiter(map(len, texts), np.int64, n) + 1
            numbers = coder.numbers(texts)
            raw, ends = coder.codes(numbers).tobytes(), (2 * np.cumsum(sizes)).tolist()
            yield _filled({"slice": np.full(n, name), "place": np.arange(n, dtype=np.int32), "id": column(piece, "id"), "learn": column(piece, "learn"), "order": column(piece, "order"), "n_tokens": sizes, "codes": pa.array([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())}, n, fields)
            rest = np.flatnonzero(numbers >= coder.n)
            if not len(rest):
                continue
            doc = np.repeat(np.arange(n), sizes)[rest]
            pairs, times = np.unique(doc * len(coder) + numbers[rest], return_counts=True)
            doc, keys = pairs // len(coder), coder.hashes(pairs % len(coder))
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            keys, doc, bucket, times = keys[by], doc[by], bucket[by], times[by].astype(np.uint32)
            marks = (doc << 1 | column(piece, "learn").to_numpy(zero_copy_only=False)[doc]).astype(np.uint32)
            ends = np.flatnonzero(np.r_[np.diff(bucket) != 0, True]) + 1
            first = np.r_[0, ends[:-1]]
            packed = {k: pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for k, x in (("words", keys), ("docs", marks), ("times", times))}
            yield _filled({"bucket": bucket[first], "slice": np.full(len(ends), name)} | packed, len(ends), fields)

    return kept(rows.mapInArrow(run, _CODED.format(docs.schema[id_col].dataType.simpleString())))[0]


def _batches_of(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of one shard with about ``tokens`` tokens, with their codes and sizes; record batches don't matter."""
    held: list[pa.RecordBatch] = []
    size, shard = 0, None

    def ready() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held)
        parts = [np.frombuffer(x.as_buffer(), np.uint16) for x in table["codes"]]
        return table, np.concatenate(parts).astype(np.int64), np.fromiter(map(len, parts), np.int64, len(parts))

    for batch in batches:
        n, own = column(batch, "n_tokens").to_numpy(), column(batch, "shard").to_numpy()
        at = 0
        for k in range(batch.num_rows):
            if held or k > at:
                if own[k] != shard or size >= tokens:
                    if k > at:
                        held.append(batch.slice(at, k - at))
                    yield ready()
                    held, at, size = [], k, 0
            size, shard = size + int(n[k]), own[k]
        if batch.num_rows > at:
            held.append(batch.slice(at))
    if held:
        yield ready()


def fit(coded: DataFrame, words: Words, *, dims: int = 16, epochs: int = 2, batch: int = 1024, shard_docs: int = 4096, chunk: int = 1 << 16) -> Bilinear:
    """The model after training on the learning rows of ``encode``'s table."""
    spark = coded.sparkSession
    learn = coded.filter("codes is not null and learn")
    model = Bilinear(words, dims)
    n_docs = learn.count()
    shards = max(1, -(-n_docs // shard_docs))
    bits = 54 - words.total.bit_length()  # sums of uses times values up to 128 fit 62 bits
    rows = learn.select(F.pmod("order", F.lit(shards)).alias("shard"), "order", "n_tokens", "codes").repartition("shard").sortWithinPartitions("shard", "order", "codes")
    for epoch in range(epochs if n_docs else 0):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            one_blas_thread()
            total, now, own, rng = None, None, None, None

            def added(total: list | None) -> list:
                sums = own.fixed_sums(bits)
                return sums if total is None else [x + y for x, y in zip(total, sums, strict=True)]

            for table, codes, sizes in _batches_of(batches, chunk):
                shard = table["shard"][0].as_py()
                if shard != now:
                    if own:
                        total = added(total)
                    now, own, rng = shard, shared.value.fresh(), np.random.default_rng([11, epoch, shard])
                one, two = contexts(codes, np.cumsum(sizes) - sizes, own.start)
                at = targets(sizes, epoch, epochs)
                rng.shuffle(at)
                for a in range(0, len(at), batch):
                    chosen = at[a : a + batch]
                    own.train(codes[chosen], one[chosen], two[chosen], rng)
            if own:
                total = added(total)
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in total]).tobytes()], pa.binary())], ["sums"])

        # Added up in two steps: a task holds two models at a time, the driver sees one.
        sums = rows.mapInArrow(run, "sums binary").repartition(16).mapInArrow(_added, "sums binary").repartition(1).mapInArrow(_added, "sums binary").collect()
        if sums:
            model.average(np.frombuffer(bytes(sums[0]["sums"]), np.int64), bits)
        shared.unpersist()
    return model


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in column(b, "sums"):
            own = np.frombuffer(x.as_buffer(), np.int64)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def score(coded: DataFrame, model: Bilinear, words: Words, id_col: str = "doc_id") -> DataFrame:
    """Id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row of ``encode``'s table."""
    spark = coded.sparkSession
    kind = coded.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(coded.schema["id"].dataType)
    inside = np.log10(words.rest_n + 0.5 * (words.rest_v + 1))
    shared = spark.sparkContext.broadcast((model, words.counts, inside))
    facts = f"id {kind}, n_tokens long, n_known long, model double, logs double"
    fields = [pa.field(*x) for x in (("slice", pa.int64()), ("place", pa.int32()), ("id", id_type), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("model", pa.float64()), ("logs", pa.float64()), ("docs", pa.binary()), ("times", pa.binary()), ("answers", pa.binary()))]
    schema = f"slice long, place int, {facts}, docs binary, times binary, answers binary"

    def modelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        own, counts, inside = shared.value
        logs = np.r_[np.log10(counts + 0.5), np.zeros(RESTS)]
        known = np.r_[(counts > 0).astype(np.float64), np.zeros(RESTS)]
        minus = np.r_[np.zeros(len(counts)), inside]
        for table, codes, sizes in _batches_of(batches, 1 << 18):
            n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            one, two = contexts(codes, np.cumsum(sizes) - sizes, own.start)
            found = np.concatenate([own.log10_probability(codes[a : a + (1 << 20)], one[a : a + (1 << 20)], two[a : a + (1 << 20)]) for a in range(0, len(codes), 1 << 20)])
            made = {"model": np.bincount(doc, found - minus[codes], n), "logs": np.bincount(doc, logs[codes], n), "n_known": np.bincount(doc, known[codes], n).astype(np.int64)}
            for b in table.select(["slice", "place", "id", "n_tokens"]).combine_chunks().to_batches():
                yield _filled({c: column(b, c) for c in b.schema.names} | made, n, fields)

    def replied(table: pa.Table) -> pa.Table:
        marks, keys, times = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]]) for c, t in (("docs", np.uint32), ("words", np.uint64), ("times", np.uint32)))
        distinct, code = np.unique(keys, return_inverse=True)
        learns = (marks & 1).astype(bool)
        c = np.bincount(code[learns], times[learns], len(distinct)).astype(np.uint32)
        ends = np.cumsum([len(x.as_buffer()) // 4 for x in table["docs"]])
        answers = pa.array([x.tobytes() for x in np.split(c[code], ends[:-1])], pa.binary())
        return pa.Table.from_batches([_filled({"slice": table["slice"].combine_chunks(), "docs": table["docs"].combine_chunks(), "times": table["times"].combine_chunks(), "answers": answers}, table.num_rows, fields)])

    def gather(table: pa.Table) -> pa.Table:
        own = table.filter(table["place"].is_valid()).sort_by("place")
        packed = table.filter(table["answers"].is_valid())
        n, logs, hit = own.num_rows, own["logs"].to_numpy(), own["n_known"].to_numpy()
        rest = np.zeros(n)
        if packed.num_rows:
            marks, times, c = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in packed[name]]) for name in ("docs", "times", "answers"))
            doc = (marks >> 1).astype(np.int64)
            rest = np.bincount(doc, np.log10(c.astype(np.float64) + 0.5) * times, n)
            hit = hit + np.bincount(doc, (c > 0) * times.astype(np.int64), n).astype(np.int64)
        out = own.select(["id", "n_tokens"])
        for name, x in (("n_known", hit), ("base", logs + rest), ("model", own["model"].to_numpy() + rest)):
            out = out.append_column(name, pa.array(x))
        return out

    scored = coded.filter("codes is not null").select(F.lit(0).cast("long").alias("shard"), "slice", "place", "id", "n_tokens", "codes").mapInArrow(modelled, schema)
    asked = coded.filter("words is not null").select("bucket", "slice", "words", "docs", "times")
    answered = asked.groupBy("bucket").applyInArrow(replied, schema)
    found = scored.unionByName(answered).groupBy("slice").applyInArrow(gather, f"id {kind}, n_tokens long, n_known long, base double, model double")
    base = float(np.log10(words.total + 0.5 * (words.distinct + 1)))
    return found.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "n_known",
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        F.col("model").alias("score"),
    )


def learn_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Scores of all rows by a model of the rows where ``learn`` is true."""
    marked = docs.withColumn("_learn", learn)
    counted, path = count_words(marked, "_learn", text_col)
    words = list_words(counted, **options)
    discard(docs.sparkSession, path)
    coded = encode(marked, words, "_learn", id_col, text_col)
    return score(coded, fit(coded, words), words, id_col)


def _filled(columns: dict, n: int, fields: list[pa.Field]) -> pa.RecordBatch:
    """A record batch of ``fields``; what ``columns`` lacks is null."""
    made = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in fields]
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in zip(made, fields, strict=True)], [f.name for f in fields])
