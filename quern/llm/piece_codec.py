"""Merge-type piece encoding with seeded dropout, and its decoding.

Encoding follows the agenda of merge-type models: of all neighbouring pieces that join to a piece of the
vocabulary, the best-ranked (leftmost of equals) joins first. With dropout each candidate is skipped for good
if a keyed hash of (seed, text, number of the segment, place, both pieces) falls below the rate; so each occurrence
of a word is segmented on its own, and a segmentation depends on its key only, never on the machine, the batch
or a retry. Nothing is remembered between texts. At rate 0 it is the library's own.

No piece but runs of spaces has a space after its first letter, none has a line end, and none has a Latin
letter before a full stop or comma, so texts are cut there (the model is asked). Short segments run through the
agenda in lockstep, those of one length together: each step joins the best candidate of every segment that has one, so all that
go on have the same length again. Long segments go through a heap; both give the same pieces.

Decoding is lossless: what the vocabulary lacks, and the space mark itself where it stands in a text, goes by
byte pieces. A null text is empty and has no pieces; equal texts have equal pieces; repeated rows stay;
an empty table gives an empty result; null ids decode to null.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import M1, M2, by_bytes, fold, keyed, named, utf8
from .token_counts import shared, vocabulary

RATE, SEED = 0.1, 20_240
#: The rank of pairs that don't join.
NEVER = 2**31 - 1
#: The space mark of these models, and the code that stands for it where it is part of a text.
MARK, OWN_MARK = "▁", 0x110000
#: Longest segment for the lockstep, and how many go together.
SHORT, TOGETHER = 32, 1 << 13
_LATIN = "A-Za-z\u00c0-\u024f"
_SLOT_BITS = 19


class MergeModel:
    """The merge table of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = processor.get_piece_size()
        pieces = [processor.id_to_piece(i) for i in range(self.size)]
        usual = [not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i)) for i in range(self.size)]
        self.ids = {p: i for i, p in enumerate(pieces) if usual[i]}
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if processor.is_byte(i)}
        if len(byte_ids) < 256 or self.size > 1 << 20:
            raise ValueError("without byte pieces decoding would not be lossless; pieces must be fewer than 2^20")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces cross the cuts of segments")
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        self.surfaces = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(MARK, " ").encode() if usual[i] else b"" for i, p in enumerate(pieces)]
        order = sorted(self.ids.values(), key=lambda i: (-processor.get_score(i), i))
        rank = {i: k for k, i in enumerate(order)}
        self.merges = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.merges[a << 20 | b] = (rank[i], i)
        self.by_rank = np.array(order, np.int32)
        self.letters = np.full(OWN_MARK + 1, -1, np.int32)  # -1: a letter without a piece
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        # Where no piece has a letter before a mark, texts may be cut between them as well.
        self.apart = not any(re.search(rf"[{_LATIN}][.,]", p) for p in self.ids)
        self._slots()

    def _slots(self) -> None:
        """The merges as a hash table with linear probing."""
        size = max(1 << _SLOT_BITS, 4 * len(self.merges))
        self.slot_bits = (size - 1).bit_length()
        self.slot_pair = np.full(1 << self.slot_bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.slot_bits, NEVER, np.int32)
        pairs = np.array(list(self.merges), np.int64)
        for pair, at in zip(pairs.tolist(), self._slot(pairs).tolist()):
            while self.slot_pair[at] >= 0:
                at = at + 1 & (1 << self.slot_bits) - 1
            self.slot_pair[at], self.slot_rank[at] = pair, self.merges[pair][0]

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (pair.astype(np.uint64) * M1 >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _ranked(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, key: np.ndarray, below: np.uint64) -> np.ndarray:
        """Ranks of neighbours; NEVER where they don't join or are skipped."""
        pair = left.astype(np.int64) << 20 | right
        at = self._slot(pair)
        there = self.slot_pair[at]
        rank = np.where(there == pair, self.slot_rank[at], np.int32(NEVER))
        further = np.flatnonzero((there != pair) & (there >= 0))
        while len(further):
            at[further] = at[further] + 1 & (1 << self.slot_bits) - 1
            there = self.slot_pair[at[further]]
            hit = there == pair[further]
            rank[further[hit]] = self.slot_rank[at[further[hit]]]
            further = further[~hit & (there >= 0)]
        if below:
            on = np.flatnonzero(rank < NEVER)
            # A candidate's hash: of the occurrence's key, the place of its left piece in the segment, and both pieces.
            rank[on[fold(fold(key[on], place[on].astype(np.uint64)), pair[on].astype(np.uint64)) < below]] = NEVER
        return rank

    def together(self, letters: np.ndarray, keys: np.ndarray, below: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pieces of segments of one length, given as rows of letters' ids: rows' numbers, and their pieces, by how many they have."""
        n, size = letters.shape
        rows, symbols, places = np.arange(n), letters, np.tile(np.arange(size, dtype=np.int8), (n, 1))
        rank = self._ranked(symbols[:, :-1].ravel(), symbols[:, 1:].ravel(), places[:, :-1].ravel(), np.repeat(keys, size - 1), below).reshape(n, size - 1)
        while size > 1:
            best = rank.argmin(1)
            top = rank[np.arange(len(rows)), best]
            on = top < NEVER
            if not on.all():
                yield rows[~on], symbols[~on]
                rows, symbols, places, rank, best, top = (x[on] for x in (rows, symbols, places, rank, best, top))
            if not len(rows):
                return
            size -= 1
            here, column = np.arange(len(rows)), np.arange(size)
            kept = column <= best[:, None]
            symbols, places = np.where(kept, symbols[:, :-1], symbols[:, 1:]), np.where(kept, places[:, :-1], places[:, 1:])
            symbols[here, best] = self.by_rank[top]
            if size == 1:
                break
            rank = np.where(column[:-1] < best[:, None], rank[:, :-1], rank[:, 1:])
            for at, has in ((best, best < size - 1), (best - 1, best > 0)):
                row, at = here[has], at[has]
                rank[row, at] = self._ranked(symbols[row, at], symbols[row, at + 1], places[row, at], keys[rows[row]], below)
        yield rows, symbols

    def alone(self, letters: np.ndarray, key: int, below: np.uint64) -> np.ndarray:
        """The pieces of one long segment by a heap."""
        n, symbol = len(letters), letters.tolist()
        before, after, width = list(range(-1, n - 1)), list(range(1, n + 1)), [1] * n
        heap: list[tuple[int, int, int, int, int]] = []
        below, one, two, full = int(below), int(M1), int(M2), 2**64 - 1

        def folded(first: int, second: int) -> int:
            h = (first * one & full) ^ (second + two & full)
            h = (h ^ h >> 32) * two & full
            return h ^ h >> 29

        def add(a: int, b: int) -> None:
            if a < 0 or b >= n:
                return
            pair = symbol[a] << 20 | symbol[b]
            found = self.merges.get(pair)
            if found and not (below and folded(folded(key, a), pair) < below):
                heapq.heappush(heap, (found[0], a, b, width[a] + width[b], found[1]))

        for i in range(n - 1):
            add(i, i + 1)
        while heap:
            _, a, b, size, piece = heapq.heappop(heap)
            if not width[a] or not width[b] or width[a] + width[b] != size or after[a] != b:
                continue
            symbol[a], width[a], width[b], after[a] = piece, size, 0, after[b]
            if after[b] < n:
                before[after[b]] = a
            add(before[a], a)
            add(a, after[a])
        return np.array([symbol[i] for i in range(n) if width[i]], np.int32)

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All letters' ids, the segments' starts among them, and how many segments each text has.

        A letter without a piece stands there by its bytes' pieces. A text that isn't empty has a space put before it.
        """
        words = [raw.decode("utf-8", "replace") for raw in texts]
        sizes = np.array([len(w) + 1 if w else 0 for w in words], np.int64)
        codes = np.frombuffer("".join([MARK + w for w in words if w]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        mark = codes == ord(" ")
        codes[codes == ord(MARK)] = OWN_MARK
        codes[mark] = ord(MARK)
        codes[first] = ord(MARK)
        mark[first] = True
        line = codes == ord("\n")
        starts = line | mark
        starts[1:] |= line[:-1]
        starts[1:] &= ~(mark[1:] & mark[:-1])
        if self.apart:
            latin = (codes >= 0xC0) & (codes < 0x250) | ((codes | 32) >= ord("a")) & ((codes | 32) <= ord("z"))
            starts[1:] |= latin[:-1] & ((codes[1:] == ord(".")) | (codes[1:] == ord(",")))
        starts[first] = True
        count = np.add.reduceat(starts, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        per_text = np.zeros(len(texts), np.int64)
        per_text[sizes > 0] = count
        starts = np.flatnonzero(starts)
        letters = self.letters[codes]
        odd = np.flatnonzero(letters < 0)
        if len(odd):
            spelled = [(chr(c) if c < OWN_MARK else MARK).encode("utf-8", "surrogatepass") for c in codes[odd].tolist()]
            wide = np.ones(len(codes), np.int64)
            wide[odd] = [len(x) for x in spelled]
            moved = np.cumsum(wide) - wide
            letters = np.repeat(letters, wide)
            letters[letters < 0] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            starts = moved[starts]
        return letters, starts, per_text

    def pieces(self, letters: np.ndarray, starts: np.ndarray, keys: np.ndarray, below: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all segments, one segment after another, and how many each has."""
        lengths = np.diff(starts, append=len(letters))
        counts, found = np.ones(len(starts), np.int64), []
        order = np.argsort(np.minimum(lengths, SHORT + 1).astype(np.uint8), kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(1, SHORT + 2)).tolist()
        for size, (s, e) in enumerate(zip(bounds, bounds[1:]), 1):
            for at in range(s, e, TOGETHER):
                part = order[at : min(at + TOGETHER, e)]
                grid = letters[starts[part][:, None] + np.arange(size)]
                for rows, made in self.together(grid, keys[part], below) if size > 1 else ((slice(None), grid),):
                    counts[part[rows]] = made.shape[1]
                    found.append((part[rows], made))
        for i in order[bounds[-1] :].tolist():
            made = self.alone(letters[starts[i] : starts[i] + lengths[i]], int(keys[i]), below)
            counts[i] = len(made)
            found.append((np.array([i]), made[None, :]))
        out, first = np.empty(int(counts.sum()), "<u4"), np.cumsum(counts) - counts
        for part, made in found:
            out[first[part][:, None] + np.arange(made.shape[1])] = made
        return out, counts


class PieceEncoder:
    """Encoding and decoding of whole texts."""

    def __init__(self, path: str):
        self.model = MergeModel(path)

    def encode(self, texts: list[bytes], rate: float, seed: int) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        below = np.uint64(min(int(rate * 2.0**64), 2**64 - 1))
        letters, starts, per_text = self.model.cut(texts)
        own = np.array([xxhash.xxh3_64_intdigest(raw, seed) for raw in texts], np.uint64)
        number = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        ids, counts = self.model.pieces(letters, starts, fold(np.repeat(own, per_text), number.astype(np.uint64)), below)
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(per_text)))]
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def decode(self, ids: bytes) -> bytes:
        surfaces = self.model.surfaces
        whole = b"".join([surfaces[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return whole[1:] if whole[:1] == b" " else whole


def _encoded(path: str, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(PieceEncoder, path)
        for batch in by_bytes(batches, "__text", 1 << 20):
            raw = utf8(batch.column("__text"))
            ids = encoder.encode(raw, rate, seed)
            names = [n for n in batch.schema.names if n != "__text"]
            made = [pa.array([len(x) for x in raw], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, [*names, "n_bytes", "ids"])

    return run


def encode(docs: DataFrame, keys: list[str], text: str = "text", path: str | None = None, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """`keys`, n_bytes and ids (little-endian unsigned 32-bit) for each row."""
    kept = keyed(docs, keys, __text=F.col(f"`{text}`").cast("string"))
    schema = kept.drop("__text").schema.add("n_bytes", "long").add("ids", "binary")
    return named(kept.mapInArrow(_encoded(path or vocabulary("piece_bpe_32k.model"), rate, seed), schema), keys)


def _decoded(path: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(PieceEncoder, path)
        for batch in by_bytes(batches, ids, 4 << 20):
            texts = [None if x is None else encoder.decode(x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with `decoded`, the text of their column `ids`."""
    kept = keyed(encoded, encoded.columns)
    schema = T.StructType(list(kept.schema.fields)).add("decoded", "string")
    return named(kept.mapInArrow(_decoded(path or vocabulary("piece_bpe_32k.model"), f"__key{encoded.columns.index('ids')}"), schema), encoded.columns)
