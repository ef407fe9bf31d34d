"""Counts over all rows of what each block of rows holds, without a place that holds them all.

Rows are dealt into blocks of bounded size. A block asks for its own distinct hashes, in messages to nodes that
each keep a range of the hashes; nodes add up and send back, in the order asked, the sums of just these hashes.
With many blocks the messages go by several hops: a node of a hop merges what 2^digit neighbours ask of one
range, cuts the range in 2^digit parts and asks on. So a block or node sends at most 2^`FAN_BITS` messages of
a kind, however many blocks there are, a node's load is about that of a block, and the rows between two stages
grow in proportion to the blocks. A frequent hash is one entry of each block and of each node on its way.

Hashes are cut to `bits` leading bits (see `hash_bits`), sent as differences in byte planes, compressed.
Blocks must be dealt by the rows' content, so that a lost one is made again as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: A node sends at most 2^FAN_BITS messages of a kind.
FAN_BITS = 13
_ASKED = "dest long, src long, part int, hashes binary, counts binary"
_TOLD = "dest long, src long, part int, counts binary, total long, distinct long"


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, as many as the largest one needs, compressed."""
    wide = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def unplanes(data: bytes) -> np.ndarray:
    wide = data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    out = np.zeros((len(raw) // wide, 8), np.uint8)
    out[:, :wide] = raw.reshape(wide, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


def hash_bits(size: int, beyond: int) -> int:
    """Bits for about `size` hashes of which one shares its bits with another by a chance of 2^-beyond."""
    return min(64, max(32, max(size, 1).bit_length() + beyond))


def order_of(hashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """The order that sorts hashes of `bits` bits: numbers with their place below are sorted, which is faster than argsort."""
    n = len(hashes)
    low = np.uint64(max(n - 1, 1).bit_length())
    cut = np.uint64(max(0, bits + int(low) - 64))
    packed = (hashes >> cut) << low | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    if cut:
        # Hashes that differ only in the bits cut off may stand in the wrong order.
        ranked = hashes[order]
        wrong = np.flatnonzero(ranked[1:] < ranked[:-1])
        for s, e in {tuple(np.searchsorted(ranked >> cut, top, side).item() for side in ("left", "right")) for top in (ranked[wrong] >> cut)}:
            order[s:e] = order[s:e][np.argsort(ranked[s:e], kind="stable")]
    return order


def distinct(hashes: np.ndarray, weights: np.ndarray | None = None, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, their counts (or sums of weights), and the place of each given one among them."""
    order = order_of(hashes, bits)
    ranked = hashes[order]
    new = np.empty(len(ranked), bool)
    new[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.empty(len(order), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    first = np.flatnonzero(new)
    if weights is None:
        sums = np.diff(np.append(first, len(ranked)))
    else:
        sums = np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)
    return ranked[first], sums, at


class Route:
    """Where hashes of `bits` bits go, hop by hop. A node's number is its group of blocks, then its range."""

    def __init__(self, blocks: int, bits: int, fan_bits: int = FAN_BITS):
        whole = max(4, (max(blocks, 1) - 1).bit_length())
        self.bits, self.hops = bits, -(-whole // fan_bits)
        self.digit = -(-whole // self.hops)

    def messages(self, hop: int, node: int, part: int, values: np.ndarray, counts: np.ndarray, always: bool) -> Iterable[tuple]:
        """What a node of hop - 1 asks the nodes of `hop`; `always` sends empty messages too."""
        before = self.digit * (hop - 1)
        group, own = node >> before, node & (1 << before) - 1
        shift = self.bits - self.digit * hop
        group = 0 if hop == self.hops else group >> self.digit
        edges = (np.arange((own << self.digit) + 1, own + 1 << self.digit, dtype=np.uint64)) << np.uint64(shift)
        bounds = [0, *np.searchsorted(values, edges).tolist(), len(values)]
        for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
            if e > s or always:
                mine = values[s:e]
                told = mine[:1].tobytes() + planes(np.diff(mine)) if e > s else b""
                yield (group << self.digit * hop) + (own << self.digit) + k, node, part, told, planes(counts[s:e])


def _values(message: bytes) -> np.ndarray:
    if not message:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(message[:8], np.uint64)
    return np.concatenate((first, first + np.cumsum(unplanes(message[8:]), dtype=np.uint64)))


def _asked(rows: Iterable[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["dest", "src", "part", "hashes", "counts"])


def _told(rows: Iterable[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["dest", "src", "part", "counts", "total", "distinct"])


def _merged(table: pa.Table, bits: int):
    """For each part: who asks, how much each asks, and the distinct hashes, sums and places of all they ask."""
    parts = table["part"].to_numpy()
    for part in np.unique(parts).tolist():
        mine = table.filter(pa.array(parts == part))
        hashes = [_values(x) for x in mine["hashes"].to_pylist()]
        counts = np.concatenate([unplanes(x) for x in mine["counts"].to_pylist()])
        yield part, mine["src"].to_pylist(), [len(x) for x in hashes], distinct(np.concatenate(hashes), counts.astype(np.int64), bits)


def _answers(node: int, part: int, askers: list[int], sizes: list[int], sums: np.ndarray, at: np.ndarray, total, kinds):
    start = 0
    for asker, size in zip(askers, sizes):
        yield asker, node, part, planes(sums[at[start : start + size]]), total, kinds
        start += size


def _last(route: Route):
    def last(table: pa.Table) -> pa.Table:
        """A node of the last hop answers with the sums, and with its total and number of hashes counted at all."""
        node, rows = table["dest"][0].as_py(), []
        for part, askers, sizes, (_, sums, at) in _merged(table, route.bits):
            rows += _answers(node, part, askers, sizes, sums, at, int(sums.sum()), int((sums > 0).sum()))
        return _told(rows)

    return last


def _onward(route: Route, hop: int):
    def forward(table: pa.Table) -> pa.Table:
        node = table["dest"][0].as_py()
        return _asked(m for part, _, _, (values, sums, _) in _merged(table, route.bits) for m in route.messages(hop, node, part, values, sums, part == 0))

    return forward


def answer(told: pa.Table, part: int) -> tuple[np.ndarray, int, int]:
    """The counts that a block or node was told for its sorted distinct hashes of a part; all nodes' total and distinct."""
    mine = told.filter(pa.array(told["part"].to_numpy() == part)).sort_by("src")
    counts = [unplanes(x) for x in mine["counts"].to_pylist()]
    return (np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)), sum(mine["total"].to_pylist()), sum(mine["distinct"].to_pylist())


def _back(route: Route):
    def back(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _told([])
        node, rows = asked["dest"][0].as_py(), []
        for part, askers, sizes, (_, _, at) in _merged(asked, route.bits):
            sums, total, kinds = answer(told, part)
            rows += _answers(node, part, askers, sizes, sums, at, total, kinds)
        return _told(rows)

    return back


def _exchanged(asked: DataFrame, route: Route, hop: int) -> DataFrame:
    nodes = asked.groupBy("dest")
    if hop == route.hops:
        return nodes.applyInArrow(_last(route), _TOLD)
    told = _exchanged(nodes.applyInArrow(_onward(route, hop + 1), _ASKED), route, hop + 1)
    return asked.groupBy("dest").cogroup(told.groupBy("dest")).applyInArrow(_back(route), _TOLD)


Gathered = Iterable[tuple[np.ndarray, np.ndarray]]


def looked_up(rows: DataFrame, blocks: int, bits: int, gather: Callable[[pa.Table], Gathered], use: Callable[[pa.Table, pa.Table], pa.Table], schema, fan_bits: int = FAN_BITS) -> DataFrame:
    """`use(block's rows, what it was told)` for each block of `rows` (column block, long).

    `gather` gives for each part a block's sorted distinct hashes and its counts of them; `use` reads the
    sums over all blocks, in that order, by `answer`.
    """
    route = Route(blocks, bits, fan_bits)

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        return _asked([m for part, (values, counts) in enumerate(gather(table)) for m in route.messages(1, block, part, values, counts, part == 0)])

    # Both uses of the rows have the same columns, so Spark deals them out once.
    told = _exchanged(rows.groupBy("block").applyInArrow(ask, _ASKED), route, 1)
    return rows.groupBy("block").cogroup(told.groupBy("dest")).applyInArrow(use, schema)
