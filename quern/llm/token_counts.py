"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, long texts are split at safe boundaries, and what is new in a batch goes
through the library's batch call. A boundary is safe where the vocabulary's own pre-tokenizer always
cuts, at white space that it drops. Each worker remembers the lengths of short segments, up to a fixed number, so the library sees each
frequent word once; every text is still counted whole.

Nulls count as empty texts (0 bytes, 0 tokens); repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, keyed, named, utf8

LIMIT = 2048


def vocabulary(name: str) -> str:
    """Where the public file of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's tokenizer of a file, without truncation or padding, one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def joined_ids(tokenizer, pieces: list[str], size: int = 1 << 15) -> Iterator[list[int]]:
    """The ids of each piece, by batch calls on pieces joined end to end.

    The pieces must be such that the pre-tokenizer cuts at each joint; tokens are dealt back by offset.
    """
    start = 0
    while start < len(pieces):
        blocks, ends = [], []
        while start < len(pieces) and len(blocks) < 16:
            used, stop = 0, start
            while stop < len(pieces) and (used < size or stop == start):
                used += len(pieces[stop])
                stop += 1
            blocks.append("".join(pieces[start:stop]))
            ends.append(np.cumsum([len(p) for p in pieces[start:stop]]))
            start = stop
        for e, end in zip(tokenizer.encode_batch(blocks, add_special_tokens=False), ends):
            ids = e.ids
            last = np.fromiter((o[1] for o in e.offsets), np.int64, len(ids))
            cuts = np.searchsorted(last, end, "right").tolist()
            before = 0
            for cut in cuts:
                yield ids[before:cut]
                before = cut


class WordCounter:
    """Numbers of tokens, for vocabularies whose pre-tokenizer cuts at white space and drops it."""

    REMEMBERED, LONGEST = 1 << 20, 40

    def __init__(self, path: str):
        self.tokenizer, self.known = load(path), {}

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]  # at ASCII white space: always a safe boundary
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        known = self.known
        fresh = set().union(*split).difference(known)
        # "word," is "word" and ",": a letter and a following mark never share a token, and A-Z are lower-cased, but in special strings.
        stems = {}
        for w in fresh:
            mark = w[-1:] if len(w) > 1 and w[-1:] in (b".", b",") and w[:-1].isalpha() and w.isascii() else b""
            stem = w[:-1] if mark else w
            stems[w] = (stem if b"<|" in stem else stem.lower(), mark)
        need = list({s for s, _ in stems.values()}.difference(known) | {m for _, m in stems.values() if m and m not in known})
        plain = [w for w in need if b"<|" not in w]
        odd = [w for w in need if b"<|" in w]
        for w, ids in zip(plain, joined_ids(self.tokenizer, [w.decode("utf-8", "replace") + " " for w in plain])):
            known[w] = len(ids)
        for w, e in zip(odd, self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)):
            known[w] = len(e)
        for w, (stem, mark) in stems.items():
            known[w] = known[stem] + (known[mark] if mark else 0)
        out = [sum(map(known.__getitem__, words)) for words in split]
        for w in [w for w in (*fresh, *need) if len(w) > self.LONGEST]:
            known.pop(w, None)
        return out


#: The byte-level pre-tokenizer's pattern, a fixed value of this kind of vocabulary.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(path: str):
    """A fast encoder with the ids of a byte-level vocabulary file (.json)."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)


class IdEncoder:
    """Ids as little-endian unsigned 32-bit bytes, for byte-level vocabularies."""

    LONG = 20_000

    def __init__(self, path: str):
        self.path, self.encoding, self.slow = path, byte_level(path), None

    def ids(self, text: str) -> bytes:
        """Special strings inside a text give their special ids, as the library's default does."""
        if len(text) > self.LONG and max(map(len, text.split()), default=0) > self.LONG:
            # Merging one endless word takes the fast encoder quadratic time; the slower one keeps a heap.
            self.slow = self.slow or load(self.path)
            found = self.slow.encode(text, add_special_tokens=False).ids
        elif "<|" in text:
            found = self.encoding.encode(text, allowed_special="all", disallowed_special=())
        else:
            found = self.encoding.encode_ordinary(text)
        return array.array("I", found).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t) if t else b"" for t in texts]


_LOADED: dict = {}


def shared(kind, path: str):
    """One encoder for a Python worker, so that what it remembers serves the next tasks."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def _counted(path: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(WordCounter, path)
        for batch in by_bytes(batches, "__text", 4 << 20):
            raw = utf8(batch.column("__text"))
            tokens = np.array(counter.count(raw), np.int64)
            names = [n for n in batch.schema.names if n != "__text"]
            made = [pa.array([len(x) for x in raw], pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, [*names, "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, keys: list[str], text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """`keys`, n_bytes, n_tokens and over_limit for each row. For vocabularies that drop white space."""
    kept = keyed(docs, keys, __text=F.col(f"`{text}`").cast("string"))
    schema = kept.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return named(kept.mapInArrow(_counted(path or vocabulary("word_bpe_49k.json"), limit), schema), keys)
