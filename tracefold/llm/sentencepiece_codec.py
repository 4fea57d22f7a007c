"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The merge rounds run over flat numpy symbol arrays that hold all distinct
units of a slice of texts.  Each round takes the segmented minimum of the
pair ranks per unit, merges every leftmost non-overlapping occurrence of that
pair at once, and compacts away the units in which no pair remains.

Units: a text is cut before each run of spaces and around line ends, which is
exact only if no piece of the vocabulary spans such a cut; ``Vocabulary``
checks that and otherwise takes the whole text as one unit.

A round that merged several occurrences and thereby made a pair of a better
rank could differ from the library, which merges one pair at a time.  So could
two adjacent merges, where the first makes a better pair with the symbol that the
second takes away.  Such units are redone one merge at a time, from a heap of
pairs, in a time of n log n.  Of a rank shared by several pieces, a round merges
the leftmost occurrence alone.

Defined results: a null or empty text has the end id alone and decodes to the
empty text.  Repeated rows each get their result; other columns are left out; an
empty table gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracefold.llm.common import column, slices

_NONE = np.int32(np.iinfo(np.int32).max)
_SPACE = "▁"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces of a model file, as tables for the merge rounds."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.eos, self.unk = n, sp.eos_id(), sp.unk_id()
        text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        normal = [i for i in range(n) if not (special[i] or byte[i] or sp.is_unused(i))]
        if sp.normalize(" Á ﬁ  b ") != f"{_SPACE}{_SPACE}Á ﬁ{_SPACE}{_SPACE}b{_SPACE}":
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(text[i][3:5], 16)] = i
        self.byte_fallback = any(byte)
        # A piece's rank is its place in the order of falling scores; equal scores share one.
        scores = np.array([sp.get_score(i) for i in range(n)])
        levels, rank = np.unique(-scores[normal], return_inverse=True)
        self.rank_of = np.full(n, _NONE, np.int32)
        self.rank_of[normal] = rank
        self.shared = np.bincount(rank, minlength=len(levels)) > 1
        ids = {text[i]: i for i in normal}
        self.start = np.arange(n, n + 0x110000, dtype=np.int32)  # symbols from n on: characters without a piece
        for piece, i in ids.items():
            if len(piece) == 1:
                self.start[ord(piece)] = i
        pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self._hash_table(np.array([a * n + b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int32))
        spans = any(a != _SPACE and b == _SPACE for p in ids for a, b in zip(p, p[1:], strict=False))
        breaks = any("\n" in p and len(p) > 1 for p in ids)
        self.units = re.compile(r"(?s).+" if spans else r" *[^ ]+| +" if breaks else r" *[^ \n]+| +|\n").findall
        # What each id decodes to, as UTF-8; an unknown id as the library shows it.
        surface = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(text[i][3:5], 16)]) if byte[i] else text[i].replace(_SPACE, " ").encode() for i in range(n)]
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.plain = np.zeros(n, bool)
        self.plain[normal] = True
        self.silent = self.surface_len == 0

    def _hash_table(self, keys: np.ndarray, merged: np.ndarray) -> None:
        bits = max(16, int(len(keys) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, self.probes = self._slot(keys), 0
        left = np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.merged[at[won]] = keys[won], merged[won]
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def merged_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece made of each pair of symbols, or -1."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left >= self.size) | (right >= self.size)] = -2
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.merged[at], np.int32(-1))
        open_ = np.flatnonzero((out < 0) & (self.keys[at] >= 0) & (keys >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def merge_rounds(vocab: Vocabulary, units: list[str]) -> list[np.ndarray]:
    """The ids of each unit (spaces stand for the piece that marks them)."""
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    sym, unit = vocab.start[np.where(points == 32, 0x2581, points)], np.repeat(np.arange(len(units)), lengths)
    out: list[np.ndarray | None] = [None] * len(units)
    done_sym, done_unit, redo = [], [], np.zeros(len(units), bool)
    last, several = np.full(len(units), -1, np.int64), np.zeros(len(units), bool)
    while len(sym):
        made = np.full(len(sym), -1, np.int32)  # of a symbol and the next
        made[:-1] = vocab.merged_pairs(sym[:-1], sym[1:])
        made[:-1][unit[:-1] != unit[1:]] = -1
        rank = np.where(made >= 0, vocab.rank_of[made], _NONE)
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        best = np.minimum.reduceat(rank, starts)
        of = unit[starts]
        redo[of[several[of] & (best < last[of])]] = True
        last[of] = best
        sizes = np.diff(np.r_[starts, len(sym)])
        going = np.repeat(best < _NONE, sizes)
        if not going.all():  # compaction: what can't merge any more leaves
            done_sym.append(sym[~going])
            done_unit.append(unit[~going])
            sym, unit, made, rank = sym[going], unit[going], made[going], rank[going]
            keep = best < _NONE
            of, best, sizes = of[keep], best[keep], sizes[keep]
            if not len(sym):
                break
        chosen = rank == np.repeat(best, sizes)
        at = np.flatnonzero(chosen)
        run = np.r_[True, (np.diff(at) != 1) | (unit[at[1:]] != unit[at[:-1]])]
        first = at[run][np.cumsum(run) - 1]
        at = at[(at - first) % 2 == 0]
        lead = np.r_[True, unit[at[1:]] != unit[at[:-1]]]
        at = at[lead | ~vocab.shared[rank[at]]]
        near = at[:-1][(np.diff(at) == 2) & (unit[at[1:]] == unit[at[:-1]])]
        if len(near):
            passing = vocab.merged_pairs(made[near], sym[near + 2])
            redo[unit[near[(passing >= 0) & (vocab.rank_of[passing] < rank[near])]]] = True
        several[of] = np.bincount(unit[at], minlength=len(units))[of] > 1
        sym = sym.copy()
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, unit = sym[keep], unit[keep]
    if done_sym:
        sym, unit = np.concatenate(done_sym), np.concatenate(done_unit)
        order = np.argsort(unit, kind="stable")
        sym, unit = sym[order], unit[order]
        ends = np.cumsum(np.bincount(unit, minlength=len(units)))
        odd = sym >= vocab.size
        has_odd = np.bincount(unit[odd], minlength=len(units)) > 0
        at = 0
        for k, end in enumerate(ends.tolist()):
            got = sym[at:end]
            out[k] = _with_bytes(vocab, got) if has_odd[k] else got
            at = end
    for k in np.flatnonzero(redo).tolist():
        out[k] = _with_bytes(vocab, np.array(merge_singly(vocab, units[k]), np.int64))
    return [x if x is not None else np.empty(0, np.int32) for x in out]


def merge_singly(vocab: Vocabulary, unit: str) -> list[int]:
    """The symbols of a unit after merging the leftmost pair of the best rank, again and again."""
    points = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = vocab.start[np.where(points == 32, 0x2581, points)].tolist()
    after, before = list(range(1, len(sym))) + [-1], list(range(-1, len(sym) - 1))
    heap: list[tuple[int, int, int, int, int]] = []
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def offer(places: list[int]) -> None:
        pairs = [(sym[k], sym[after[k]]) for k in places]
        new = list({p for p in pairs if p not in known})
        if new:
            left, right = (np.array(x, np.int32) for x in zip(*new, strict=True))
            made = vocab.merged_pairs(left, right)
            known.update(zip(new, zip(made.tolist(), vocab.rank_of[made].tolist(), strict=True), strict=True))
        for k, (a, b) in zip(places, pairs, strict=True):
            made, rank = known[a, b]
            if made >= 0:
                heapq.heappush(heap, (rank, k, a, b, made))

    offer(list(range(len(sym) - 1)))
    while heap:
        _, k, a, b, made = heapq.heappop(heap)
        if sym[k] != a or after[k] < 0 or sym[after[k]] != b:
            continue  # one of the two has been merged since
        gone = after[k]
        sym[k], sym[gone], after[k] = made, -1, after[gone]
        if after[k] >= 0:
            before[after[k]] = k
        offer([x for x in ((before[k], k) if after[k] >= 0 else (before[k],)) if x >= 0])
    return [s for s in sym if s >= 0]


def _with_bytes(vocab: Vocabulary, sym: np.ndarray) -> np.ndarray:
    ids: list[int] = []
    for s in sym.tolist():
        if s < vocab.size:
            ids.append(s)
        elif vocab.byte_fallback:
            ids.extend(vocab.byte_ids[list(chr(s - vocab.size).encode("utf-8", "surrogatepass"))].tolist())
        elif not ids or ids[-1] != vocab.unk:  # without bytes, the library joins a run of unknown characters
            ids.append(vocab.unk)
    return np.array(ids, np.int32)


class _Numbered(dict):
    """Numbers units in the order in which they are first asked for, and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class Codec:
    """Encodes and decodes texts; remembers the ids of up to ``most`` units.

    A slice of texts is one flat array of ids with the end of each text in it;
    ids, decimal digits and decoded bytes are gathered from flat tables.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.vocab, self.most = Vocabulary(path), most
        self._clear()
        digits = [b"%d " % i for i in range(self.vocab.size)]
        self.digit_len = np.fromiter(map(len, digits), np.int64, len(digits))
        self.digit_at = np.cumsum(self.digit_len) - self.digit_len
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def _clear(self) -> None:
        self.index = _Numbered()
        self.store, self.filled = np.empty(1 << 16, np.int32), 0
        self.at, self.len = np.empty(self.most + 1, np.int64), np.empty(self.most + 1, np.int64)

    def _learn(self) -> None:
        units, self.index.new = self.index.new, []
        made = merge_rounds(self.vocab, units)
        flat = np.concatenate(made)
        while self.filled + len(flat) > len(self.store):
            self.store = np.resize(self.store, 2 * len(self.store))
        n, lens = len(self.index) - len(units), np.fromiter(map(len, made), np.int64, len(made))
        if len(self.index) > len(self.at):
            self.at, self.len = np.resize(self.at, len(self.index)), np.resize(self.len, len(self.index))
        self.store[self.filled : self.filled + len(flat)] = flat
        self.at[n : n + len(made)] = self.filled + np.cumsum(lens) - lens
        self.len[n : n + len(made)] = lens
        self.filled += len(flat)

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has (no end ids)."""
        find = self.vocab.units
        split = [find(" " + t.replace(_SPACE, " ")) if t else [] for t in texts]
        if len(self.index) > self.most:  # a slice may overshoot, then all are forgotten
            self._clear()
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        of = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if self.index.new:
            self._learn()
        lens = self.len[of]
        ends = np.cumsum(lens)
        flat = self.store[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[of] - (ends - lens), lens)]
        return flat, np.diff(np.r_[0, np.r_[0, ends][np.cumsum(sizes)]])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without the end id."""
        flat, counts = self.encode_flat(texts)
        return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []

    def digits_flat(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decimal ids of each text, joined by one space."""
        buffer, ends = _gather(self.digits, self.digit_at, self.digit_len, flat, counts)
        return [buffer[a : max(a, b - 1)] for a, b in zip([0, *ends], ends, strict=False)]

    def decode_flat(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decoded UTF-8 of each text; the dummy space before the first piece goes.

        Control ids are silent; lone bytes become one replacement character each.
        """
        v = self.vocab
        buffer, ends = _gather(v.surface, v.surface_at, v.surface_len, flat, counts)
        try:
            buffer.decode()
            whole = True
        except UnicodeDecodeError:
            whole = False
        out, at, first = [], 0, (np.cumsum(counts) - counts).tolist()
        for k, end in enumerate(ends):
            raw, at = buffer[at:end], end
            if raw[:1] == b" ":
                own = flat[first[k] : first[k] + int(counts[k])]
                if v.plain[own[np.argmin(v.silent[own])]]:
                    raw = raw[1:]
            if not whole:
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    raw = _lenient(raw).encode()
            out.append(raw)
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return [x.decode() for x in self.decode_flat(np.concatenate(ids).astype(np.int32), counts)] if len(ids) else []


def _gather(table: np.ndarray, at: np.ndarray, size: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[bytes, list[int]]:
    lens = size[flat]
    ends = np.cumsum(lens)
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[flat] - (ends - lens), lens)
    return table[take].tobytes(), np.r_[0, ends][np.cumsum(counts)].tolist()


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, ``ids`` (with the end id) and ``decoded``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in slices(batches, text_col):
            flat, counts = _with_end(codec, column(batch, text_col).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([column(batch, id_col), ids, pa.array([x.decode() for x in codec.decode_flat(flat, counts)], pa.string())], ["key", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", id_col)


def digest_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with counts and SHA-256 digests in place of ids and texts.

    The digests are taken where the ids are made, so that no id list crosses to the JVM.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in slices(batches, text_col):
            flat, counts = _with_end(codec, column(batch, text_col).to_pylist())
            digests = [pa.array([hashlib.sha256(x).hexdigest() for x in part], pa.string()) for part in (codec.digits_flat(flat, counts), codec.decode_flat(flat, counts))]
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(counts, pa.int64()), *digests], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", id_col)


def _with_end(codec: Codec, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    flat, counts = codec.encode_flat(texts)
    return np.insert(flat, np.cumsum(counts), codec.vocab.eos), counts + 1
