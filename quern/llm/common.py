"""What several operators share: words, hashes, byte-balanced batches, checkpoints."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import durable  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, UPPER, UPPER.lower())


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def keyed(df: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """The keys under names of our own, whatever theirs are, and further columns."""
    return df.select(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)], *[c.alias(n) for n, c in columns.items()])


def named(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys under their names again. A made column whose name a key has already gets underscores after it."""
    taken, out = {k.lower() for k in keys}, [F.col(f"__key{i}").alias(k) for i, k in enumerate(keys)]
    for c in df.columns:
        if not c.startswith("__key"):
            name = c
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts' bytes; null gives the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def released() -> None:
    """Give memory that is free again back to the system; Python workers live on from task to task, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _bounds(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Start and length of slices of at most `limit` bytes, but one row at least."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop - start
        start = stop


def by_bytes(batches: Iterator[pa.RecordBatch], name: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes of column `name`, but one row at least."""
    for batch in batches:
        for start, size in _bounds(batch.column(name), limit):
            yield batch.slice(start, size)
    batch = None
    released()


def each_part(texts: pa.Array, values, kind: pa.DataType, limit: int = 8 << 20) -> pa.Array:
    """`values(texts' bytes)`, a value for each text, called for slices of at most `limit` bytes, but one row at least."""
    made = [pa.array(values(utf8(texts.slice(start, size))), kind) for start, size in _bounds(texts, limit)]
    released()
    return pa.concat_arrays(made) if made else pa.array([], kind)


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def fold(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        h = (first * M1) ^ (second + M2)
        h ^= h >> np.uint64(32)
        h *= M2
        return h ^ (h >> np.uint64(29))


_FACTORS = [np.zeros(0, np.uint64)]


def _factors(size: int) -> np.ndarray:
    """An odd random number for each place in a word."""
    if len(_FACTORS[0]) < size:
        grown = np.arange(max(64, 2 * size), dtype=np.uint64)
        _FACTORS[0] = fold(fold(grown, M1), M2) | np.uint64(1)
    return _FACTORS[0]


def hashed_words(texts: list[bytes], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased (A-Z) word of the texts, one after another, and each text's number of words.

    Words are runs of bytes but 0x20 and 0x09-0x0D. A hash is the sum of the letters, each times a random number for its place.
    """
    out, counts, start = [], np.zeros(len(texts), np.int64), 0
    while start < len(texts):
        size, stop = len(texts[start]), start + 1
        while stop < len(texts) and size + len(texts[stop]) <= chunk:
            size, stop = size + len(texts[stop]), stop + 1
        own = texts[start:stop]
        raw = np.frombuffer(b" ".join([b"", *own, b""]).lower(), np.uint8)
        inside = ((raw - np.uint8(9)) > 4) & (raw != 32)
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, longest = edges[::2], int((edges[1::2] - edges[::2]).max(initial=0))
        if len(begin):
            # White space counts as nothing after the word before it.
            place = np.arange(begin[0], len(raw)) - np.repeat(begin, np.diff(begin, append=len(raw)))
            letters = (raw[begin[0] :] + np.uint64(1)) * inside[begin[0] :]
            with np.errstate(over="ignore"):
                letters *= _factors(longest)[np.minimum(place, longest - 1)]
                out.append(np.add.reduceat(letters, begin - begin[0]))
            ends = np.cumsum([len(x) + 1 for x in own])
            counts[start:stop] = np.diff(np.searchsorted(begin, ends + 1), prepend=0)
        start = stop
    return (fold(np.concatenate(out), M1) if out else np.zeros(0, np.uint64)), counts
