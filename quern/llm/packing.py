"""Best-fit packing by sums of squares: fill fixed-length sequences with few left-over gaps.

Each piece goes where the sum over gaps of (open bins with that gap)^2 becomes smallest; among equals, into
the smallest gap. A block of rows is packed by itself, longest pieces first; blocks are dealt by a
hash of the row and of its place among equal rows of its task, so they have about the same number of rows however the keys are spread.
Pieces as long as a sequence fill one by themselves. At the end of a block, as long as it has more bins than its pieces need at least,
the emptiest bins (two, four, eight and so on) are unpacked and their pieces placed again, longest first, into the
smallest gap that takes them; what needs fewer bins stays. A block is sorted by its own columns, so it is packed the same again.

A null text is empty and holds the closing id only; repeated rows are packed each for itself; an
empty table gives an empty result. Only texts longer than a sequence are cut; their first piece may be shorter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, keyed, named, utf8
from .token_counts import IdEncoder, shared, vocabulary

CAPACITY, END_ID = 2048, 0
#: Rows whose places among equal ones a task remembers; beyond, it counts from the start again.
REMEMBERED = 1 << 20
#: Rows of a block, whose sizes alone are in memory while it is packed, and of one whose ids are returned.
BLOCK_ROWS, BLOCK_ROWS_WITH_IDS = 16_384, 4_096


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to capacity), longest first."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap, 1 to capacity - 1
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    far = np.iinfo(np.int64).max
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if s == capacity:
            bins[i], made = made, made + 1
            continue
        gaps = open_bins[s:capacity]
        # What the sum of squares gains if the piece goes into gap s, s + 1, ...; a filled gap 0 is not counted.
        gain = 2 * (open_bins[: capacity - s] - gaps) + 2
        gain[0] = 1 - 2 * gaps[0]
        gain[gaps == 0] = far
        at = int(gain.argmin()) if len(gain) else 0
        if len(gain) and gain[at] != far and gain[at] <= 2 * open_bins[capacity - s] + 1:
            gap = s + at
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            open_bins[gap - s] += 1
    return bins, offsets


def refilled(sizes: np.ndarray, bins: np.ndarray, offsets: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A packing with the emptiest bins' pieces placed again, if that takes fewer bins."""
    count, least = int(bins.max(initial=-1)) + 1, -(-int(sizes.sum()) // capacity)
    some = 2
    while count > least:
        level = np.bincount(bins, sizes, count).astype(np.int64)
        emptiest = np.argsort(level, kind="stable")
        emptiest = emptiest[(level[emptiest] < capacity) | (np.bincount(bins)[emptiest] > 1)]
        chosen = np.zeros(count, bool)
        chosen[emptiest[:some]] = True
        out, start = bins.copy(), offsets.copy()
        gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b in emptiest[some:].tolist():
            gaps[capacity - level[b]].append(b)
        filled, free, made = np.array([len(g) > 0 for g in gaps]), np.flatnonzero(chosen).tolist()[::-1], 0
        moved = np.flatnonzero(chosen[bins])
        for i in moved[np.argsort(-sizes[moved], kind="stable")].tolist():
            s = int(sizes[i])
            gap = s + int(filled[s:].argmax())
            if filled[gap]:
                b = gaps[gap].pop()
                filled[gap] = len(gaps[gap]) > 0
            elif free:
                gap, b, made = capacity, free.pop(), made + 1
            else:
                break  # no better than before
            out[i], start[i] = b, capacity - gap
            if gap > s:
                gaps[gap - s].append(b)
                filled[gap - s] = True
        else:
            if made < int(chosen.sum()):
                bins, offsets = np.unique(out, return_inverse=True)[1], start
                count = int(bins.max()) + 1
                continue
        if some >= len(emptiest):
            break
        some *= 2
    return bins, offsets


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole sequences, the shorter rest first."""
    first = length % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, length, capacity)]]


_PIECES = "rank integer, piece integer, start long, length long, ids_crc32 long, ids binary"


def _cut(path: str, capacity: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, seen = shared(IdEncoder, path), END_ID.to_bytes(4, "little"), Counter()
        for batch in by_bytes(batches, "__text", 4 << 20):
            row, out, same = [], [], batch.column("__row").to_pylist()
            if len(seen) > REMEMBERED:
                seen.clear()
            for i, ids in enumerate(encoder.encode([x.decode("utf-8", "replace") for x in utf8(batch.column("__text"))])):
                ids += end
                rank = seen[same[i]]
                seen[same[i]] += 1
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    row.append(i)
                    out.append((rank, k, start, length, zlib.crc32(part), part if keep_ids else None))
            names = [n for n in batch.schema.names if n != "__text"]
            kept = batch.select(names).take(pa.array(row, pa.int64()))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*names, "rank", "piece", "start", "length", "ids_crc32", "ids"])

    return cut


def _packed(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        # Ordered by its own columns, so that a block recomputed after a lost executor is packed the same.
        table = table.sort_by([(n, "ascending") for n in ("ids_crc32", "length", "start", "__row", "rank")])
        sizes = table["length"].to_numpy()
        bins, offsets = refilled(sizes, *sum_of_squares(sizes, capacity), capacity)
        block = table["__block"].to_numpy().astype(np.int64)
        table = table.drop_columns(["__block", "__row", "rank"])
        return table.append_column("sequence_id", pa.array((block << 40) + bins)).append_column("offset", pa.array(offsets))

    return pack


def pack(docs: DataFrame, keys: list[str], text: str = "text", path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True, block_rows: int | None = None) -> DataFrame:
    """A row for each piece: `keys`, piece, start, length, ids_crc32, ids (if kept), sequence_id, offset."""
    blocks = -(-docs.count() // (block_rows or (BLOCK_ROWS_WITH_IDS if keep_ids else BLOCK_ROWS))) or 1
    text_column = F.col(f"`{text}`").cast("string")
    kept = keyed(docs, keys, __text=text_column, __row=F.xxhash64(*[F.col(f"`{k}`") for k in keys], text_column))
    schema = kept.drop("__text").schema
    for field in _PIECES.split(", "):
        schema = schema.add(*field.split(" "))
    pieces = kept.mapInArrow(_cut(path or vocabulary("byte_bpe_50k.json"), capacity, keep_ids), schema)
    blocked = pieces.withColumn("__block", F.pmod(F.xxhash64("__row", "rank", "piece"), F.lit(blocks)))
    if not keep_ids:
        blocked = blocked.drop("ids")
    final = blocked.drop("__row", "rank", "__block").schema.add("sequence_id", "long").add("offset", "long")
    return named(blocked.groupBy("__block").applyInArrow(_packed(capacity), final), keys)
