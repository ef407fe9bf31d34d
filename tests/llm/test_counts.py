from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm.counts import Route, answer, distinct, hash_bits, looked_up, order_of, planes, unplanes


@pytest.mark.parametrize("size", [0, 1, 2, 1000])
@pytest.mark.parametrize("high", [1, 255, 256, 2**40, 2**64 - 1])
def test_planes_round_trip(size, high):
    values = np.random.default_rng(1).integers(0, high, size, np.uint64, endpoint=True)
    assert (unplanes(planes(values)) == values).all()


@pytest.mark.parametrize("bits", [8, 40, 64])
def test_order_and_distinct(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 2**bits - 1, 5000, np.uint64) >> np.uint64(0)
    values[::7] = values[3]
    values[1::11] = values[4] ^ np.uint64(1)  # differs in the last bit only
    assert (values[order_of(values, bits)] == np.sort(values)).all()
    found, counts, at = distinct(values, bits=bits)
    assert Counter(values.tolist()) == dict(zip(found.tolist(), counts.tolist())) and (found[at] == values).all()


@pytest.mark.parametrize("fan_bits", [1, 2, 13])
def test_counts_by_one_and_by_many_hops(spark, fan_bits):
    """Every block is told the sums over all blocks; no node sends more than 2^fan_bits messages of a kind."""
    blocks, bits = 40, 32
    rng = np.random.default_rng(fan_bits)
    own = {b: rng.integers(0, 2**12, 60, np.uint64) << np.uint64(20) for b in range(blocks)}
    rows = spark.createDataFrame([(b, v.tobytes()) for b, v in own.items()], "block long, data binary")

    def gather(table):
        values, counts, _ = distinct(np.frombuffer(table["data"][0].as_py(), np.uint64))
        return [(values, counts), (values[::2], 2 * counts[::2])]

    def use(table, told):
        (values, _), (half, _) = gather(table)
        first, total, kinds = answer(told, 0)
        second, _, _ = answer(told, 1)
        return pa.table({"values": [values.tobytes()], "sums": [first.tobytes()], "half": [second.tobytes()], "total": [total], "kinds": [kinds]})

    got = looked_up(rows, blocks, bits, gather, use, "values binary, sums binary, half binary, total long, kinds long", fan_bits=fan_bits).collect()
    want = Counter(v for x in own.values() for v in x.tolist())
    doubled = Counter()
    for x in own.values():
        values, counts, _ = distinct(x)
        doubled.update(dict(zip(values[::2].tolist(), (2 * counts[::2]).tolist())))
    assert len(got) == blocks
    for r in got:
        values = np.frombuffer(r["values"], np.uint64).tolist()
        assert np.frombuffer(r["sums"], np.int64).tolist() == [want[v] for v in values]
        assert np.frombuffer(r["half"], np.int64).tolist() == [doubled[v] for v in values[::2]]
        assert (r["total"], r["kinds"]) == (sum(want.values()), len(want))


def test_messages_grow_with_the_blocks():
    """Rows a block are bounded by the fan, whatever the number of blocks."""
    values = np.sort(np.random.default_rng(2).integers(0, 2**48 - 1, 3000, np.uint64))
    for blocks in (50, 5_000, 10**7):
        route = Route(blocks, 48, 6)
        sent = [len(list(route.messages(h, 0, 0, values, values, True))) for h in range(1, route.hops + 1)]
        assert max(sent) <= 64 and route.hops <= 4
    assert Route(10**6, 48).hops == 2 and hash_bits(10**13, 20) == 64 and hash_bits(10**8, 12) == 39
