"""Quality rules: text heuristics, and line frequency across documents.

Lines are normalised (ASCII lower case, words joined by one space) and hashed
together with their host.  A line is *frequent* if more than
``max(min_docs, share * documents of the host)`` distinct documents of its
host carry it; exact copies of a text count as one document.  Frequent lines
are removed, and a document left with less than ``min_left`` of its words is
depleted and rejected.  Every line with a word is counted, however long.

Counting goes through two aggregations with partial sums on the map side,
first over (host, line, document), then over (host, line), so that a line or
host with a third of all rows is spread over all tasks.

Defined results: a null text has no words and fails the base rules; a null
host is the host with the empty name; repeated rows each get a result and
count as one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import LOWER, WordHashes, column, kept, mix, slices

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_DROP_SYMBOLS = SYMBOLS.encode()
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def repeated_window_words(hashes: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document, the words inside windows that occur twice or more in it.

    ``hashes`` are 64-bit word hashes in text order, ``doc`` the document of each.
    """
    out = np.zeros(n_docs, np.int64)
    n = len(hashes) - window + 1
    if n < 1:
        return out
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    rolled = np.zeros(n, np.uint64)
    for j in range(window):
        rolled = rolled * _FACTOR + hashes[j : j + n]
    keys = mix(rolled[at]) ^ mix(doc[at].astype(np.uint64) + _FACTOR)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    if not same.any():
        return out
    hit = at[order[np.r_[same, False] | np.r_[False, same]]]
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[hit] += 1
    edge[hit + window] -= 1  # windows start at distinct places
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def _measured(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, host_col: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    import xxhash

    word_hash = WordHashes()
    for batch in slices(batches, text_col):
        hosts = column(batch, host_col).to_pylist()
        texts = column(batch, text_col).to_pylist()
        words, counts, chars, symbols, dup_lines, line_keys, line_words, prints = [], [], [], [], [], [], [], []
        for text, host in zip(texts, hosts, strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            before, host_key = len(words), str(host if host is not None else "").encode("utf-8", "surrogatepass") + b"\0"
            seen, lines, repeats = set(), {}, 0
            for line in raw.split(b"\n"):
                own = line.split()
                if not own:
                    continue
                words += own
                if line in seen:
                    repeats += 1
                else:
                    seen.add(line)
                key = xxhash.xxh3_64_intdigest(host_key + b" ".join(own).translate(LOWER)) - (1 << 63)
                lines[key] = lines.get(key, 0) + len(own)
            inside = words[before:]
            counts.append(len(inside))
            joined = b"".join(inside)
            chars.append(len(joined.decode("utf-8", "surrogatepass")))
            symbols.append(len(joined) - len(joined.translate(None, _DROP_SYMBOLS)))
            dup_lines.append(repeats)
            line_keys.append(list(lines))
            line_words.append(list(lines.values()))
            prints.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
        n = np.array(counts, np.int64)
        repeat_words = repeated_window_words(word_hash.of(words), np.repeat(np.arange(len(n)), n), len(n))
        yield pa.RecordBatch.from_arrays(
            [column(batch, c) for c in keep]
            + [pa.array(n), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array(dup_lines, pa.int64()), pa.array(repeat_words), pa.array((n < 20) | (100 * repeat_words > 30 * n))]
            + [pa.array(prints, pa.int64()), pa.array(line_keys, pa.list_(pa.int64())), pa.array(line_words, pa.list_(pa.int32()))],
            [f"_in{k}" for k in range(len(keep))] + ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_print", "_line_keys", "_line_words"],
        )


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept")


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    *,
    min_docs: float = 20,
    share: float = 0.002,
    min_left: float = 0.3,
    carry: tuple[str, ...] = (),
    with_frequent_lines: bool = False,
    prefix: str = "",
) -> DataFrame:
    """The id column, the columns of ``carry`` and ``RESULTS`` (after ``prefix``), one row per input row.

    ``with_frequent_lines`` adds ``frequent_lines``, the keys of the lines to remove.
    """
    keep = list(dict.fromkeys([id_col, host_col, *carry]))
    source = list(dict.fromkeys([*keep, text_col]))
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join(f"_in{k} {kind}" for k, kind in enumerate(kinds))
    schema += ", _n_words long, _word_chars long, _n_symbols long, _n_dup_lines long, _n_repeat_words long, _base_failed boolean, _print long, _line_keys array<long>, _line_words array<int>"
    measured = docs.select(*source).mapInArrow(lambda b: _measured(b, id_col, text_col, host_col, keep), schema)
    table, _ = kept(measured.withColumn("_row", F.monotonically_increasing_id()))
    host = F.coalesce(F.col(f"_in{keep.index(host_col)}").cast("string"), F.lit(""))
    lines = table.select("_row", host.alias("_host"), "_print", F.explode(F.arrays_zip("_line_keys", "_line_words")).alias("_l")).select("_row", "_host", "_print", F.col("_l._line_keys").alias("_key"), F.col("_l._line_words").alias("_w"))
    # A line key already holds its host.
    carried = lines.groupBy("_key", "_host", "_print").agg(F.lit(1).alias("_one")).groupBy("_key", "_host").agg(F.count("*").alias("_docs"))
    hosts = table.select(host.alias("_host"), "_print").groupBy("_host", "_print").agg(F.lit(1).alias("_one")).groupBy("_host").agg(F.count("*").alias("_all"))
    frequent = carried.filter(F.col("_docs") > min_docs).join(hosts, "_host").filter(F.col("_docs") > F.greatest(F.lit(float(min_docs)), F.col("_all") * share)).select("_key")
    gone = lines.join(frequent, "_key").groupBy("_row").agg(F.sum("_w").alias("_gone"), *([F.collect_set("_key").alias("_frequent")] if with_frequent_lines else []))
    left = F.col("_n_words") - F.coalesce("_gone", F.lit(0))
    verdict = ~F.col("_base_failed") & (left >= F.col("_n_words") * min_left)
    out = table.join(gone, "_row", "left")
    named: list[Column] = [F.col(f"_in{k}").alias(c) for k, c in enumerate(keep) if c in (id_col, *carry)]
    named += [F.col(f"_{c}").alias(f"{prefix}{c}") for c in RESULTS[:6]] + [left.cast("long").alias(f"{prefix}words_left"), verdict.alias(f"{prefix}kept")]
    if with_frequent_lines:
        named.append(F.col("_frequent").alias(f"{prefix}frequent_lines"))
    return out.select(*named)


def remove_lines(docs: DataFrame, text_col: str, host_col: str, frequent_col: str) -> DataFrame:
    """``docs`` with the lines of ``frequent_col`` (keys, null for none) removed from the text."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, text_col):
            texts = column(batch, text_col).to_pylist()
            for k, (gone, host) in enumerate(zip(column(batch, frequent_col).to_pylist(), column(batch, host_col).to_pylist(), strict=True)):
                if not gone or texts[k] is None:
                    continue
                gone, lines = set(gone), []
                host_key = str(host if host is not None else "").encode("utf-8", "surrogatepass") + b"\0"
                for line in texts[k].encode("utf-8", "surrogatepass").split(b"\n"):
                    own = line.split()
                    if not own or xxhash.xxh3_64_intdigest(host_key + b" ".join(own).translate(LOWER)) - (1 << 63) not in gone:
                        lines.append(line)
                texts[k] = b"\n".join(lines).decode("utf-8", "surrogatepass")
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, fields)
