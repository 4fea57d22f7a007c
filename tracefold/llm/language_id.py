"""Language identification by nearest centroids.

Texts become hashed counts of letter n-grams (1 to 3, over lower-cased words
between single spaces), damped, weighted by inverse document frequency and
normalised.  Each language has several centroids, found by spherical k-means
over a bounded sample of its labelled documents; a text gets the language of
the centroid with the largest cosine.  Texts farther from every centroid than
nearly all labelled texts of their length are rejected.

Defined results: a null text or one without a letter is ``und`` with score 0
and not rejected by distance (``rejected`` is true, for want of a language);
rows of a null id belong to the learning rows; without any labelled row every
text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import column, one_blas_thread, slices

DIMS = 4096
_SHIFT = np.uint64(64 - 12)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, one row per text, and the letters of each text."""
    n = len(texts)
    low = [" " + (t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(n), np.fromiter(map(len, low), np.int64, n))
    is_letter = _letter_table()[points]
    first = np.r_[True, doc[1:] != doc[:-1]]
    keep = is_letter | first | np.r_[True, is_letter[:-1]]
    points, doc, is_letter = np.where(is_letter, points, 32)[keep].astype(np.uint64), doc[keep], is_letter[keep]
    counts = np.zeros(n * DIMS, np.int64)
    h = np.zeros(len(points), np.uint64)
    for k in range(3):
        size = len(points) - k
        if size < 1:
            break
        h = (h[:size] if k == 0 else h[:size] * _ODD[2]) + (points[k:] + np.uint64(k + 1)) * _ODD[0]
        ok = (doc[: size] == doc[k:]) & (is_letter[:size] | is_letter[k:])
        slot = ((h[ok] * _ODD[1]) >> _SHIFT).astype(np.int64)
        counts += np.bincount(doc[:size][ok] * DIMS + slot, minlength=n * DIMS)
    return counts.reshape(n, DIMS), np.bincount(doc[is_letter], minlength=n)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


class CentroidModel:
    """Centroids of each language, feature weights, and the least cosine by text length."""

    def __init__(self, counts: np.ndarray, letters: np.ndarray, langs: list[str], clusters: int = 3, rounds: int = 12, slack: float = 0.5):
        self.weights = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        vectors, labels = self.vectors(counts), np.array(langs, object)
        self.langs, rows = [], []
        for lang in sorted(set(langs)):
            own = vectors[labels == lang]
            centres = own[np.linspace(0, len(own) - 1, min(clusters, len(own))).astype(int)]
            for _ in range(rounds):
                nearest = (own @ centres.T).argmax(1)
                centres = _unit(np.array([own[nearest == k].mean(0) if (nearest == k).any() else centres[k] for k in range(len(centres))], np.float32))
            rows.append(centres)
            self.langs += [lang] * len(centres)
        self.centres = np.concatenate(rows) if rows else np.zeros((0, DIMS), np.float32)
        self.least = np.zeros(40)
        if len(rows):
            cosine, band = (vectors @ self.centres.T).max(1), self.bands(letters)
            filled = [b for b in range(5, 40) if (band == b).sum() >= 5]
            limits = {b: slack * np.quantile(cosine[band == b], 0.01) for b in filled}
            for b in range(5, 40) if filled else ():  # texts of under 32 letters tell too little to be rejected
                self.least[b] = limits[min(filled, key=lambda f: (abs(f - b), f))]

    @staticmethod
    def bands(letters: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(np.maximum(letters, 1))).astype(int)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts.astype(np.float32)) * self.weights)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, for each text."""
        counts, letters = ngram_counts(texts)
        if not len(self.centres):
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = self.vectors(counts) @ self.centres.T
        best = cosine.argmax(1)
        score = np.where(letters > 0, np.clip(cosine.max(1).astype(float), 0, 1), 0.0)
        rejected = (score < self.least[self.bands(letters)]) | (letters == 0)
        return [self.langs[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score, rejected


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, clusters: int = 3) -> CentroidModel:
    """Learn from at most about ``per_lang`` labelled documents of each language.

    The documents with the smallest id hashes are taken; they reach the driver
    as at most ``DIMS`` counts each.  ``learn`` says which rows may be used.
    """
    rows = docs.filter(learn & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    place = F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 40) - 1))
    limit = F.lit(0).cast("long")
    for lang, n in sizes.items():
        limit = F.when(F.col(lang_col) == lang, F.lit(min(1 << 40, int((1 << 40) * per_lang / n) + 1))).otherwise(limit)
    sample = rows.filter(place < limit).select(place.alias("place"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", rows=512):
            counts, letters = ngram_counts(column(batch, "text").to_pylist())
            packed = [np.stack([(at := np.flatnonzero(c)), c[at]]).astype(np.uint32).tobytes() for c in counts]
            yield pa.RecordBatch.from_arrays([column(batch, "place"), column(batch, "lang"), pa.array(letters, pa.int64()), pa.array(packed, pa.binary())], ["place", "lang", "letters", "packed"])

    got = sorted(sample.mapInArrow(run, "place long, lang string, letters long, packed binary").collect(), key=lambda r: (r.place, r.lang, bytes(r.packed)))
    taken: dict[str, int] = {}
    counts, letters, langs = [], [], []
    for r in got:
        if r.letters and taken.setdefault(r.lang, 0) < per_lang:
            taken[r.lang] += 1
            at, n = np.frombuffer(r.packed, np.uint32).reshape(2, -1)
            row = np.zeros(DIMS, np.float32)
            row[at] = n
            counts.append(row)
            letters.append(r.letters)
            langs.append(r.lang)
    return CentroidModel(np.array(counts, np.float32).reshape(-1, DIMS), np.array(letters, np.int64), langs, clusters)


def identify(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """The id column, the columns of ``carry``, ``lang_pred``, ``score`` and ``rejected`` (after ``prefix``)."""
    cols = list(dict.fromkeys([id_col, *carry]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters * languages * DIMS floats
    schema = ", ".join(f"_in{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(cols)) + ", _lang string, _score double, _rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in slices(batches, text_col, 1 << 19, 512):
            lang, score, rejected = shared.value.predict(column(batch, text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in cols] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [f"_in{k}" for k in range(len(cols))] + ["_lang", "_score", "_rejected"])

    out = docs.select(*dict.fromkeys([*cols, text_col])).mapInArrow(run, schema)
    return out.select(*[F.col(f"_in{k}").alias(c) for k, c in enumerate(cols)], F.col("_lang").alias(f"{prefix}lang_pred"), F.col("_score").alias(f"{prefix}score"), F.col("_rejected").alias(f"{prefix}rejected"))
