"""N-gram Jaccard join: rare-first prefix filtering, then length, positional and suffix filters.

A document's set is that of its distinct word n-grams, as 64-bit hashes. Texts with the same words in the same order
are one class from the start, known by 128 bits of a digest. Classes are dealt into blocks, and each block asks how often its n-grams
occur in all classes (`counts`): so the order is rare first by counts that don't saturate, in steps of a third of an octave
(ties: by hash), and nothing grows with the corpus on the driver or in a broadcast. An n-gram that occurs once meets
nobody; a class whose whole prefix is such n-grams, as with most texts, is done. Of the others the
rest of the prefix is kept with the set. Two classes meet if an n-gram is in both prefixes; a pair that meets
in several is made one, so it is verified once.

Links only have to connect: a pair whose classes are already in one component needs no verification. So
the join runs in rounds: with each bucket's most central class, then with a sample of its classes, then
with all of them, always between different components only. The last round covers every pair that is
left, hence no link between components is lost, while a bucket of near copies costs about its size.

A text's copies are sent on once by each task that reads them, those of a text with more than a
thousandth of all rows (there are at most `HOT` such texts) only for their least id. Buckets are never gathered; counts
are pre-aggregated and hot keys fall to adaptive joins.

Nulls and odd cases: a null or empty text has an empty set and is linked with nothing; a text with fewer than
n words has its whole sequence as one n-gram; a null id is never the smallest id of a component with another;
repeated rows stay repeated; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_bytes, durable, fold, hashed_words, utf8
from .components import components
from .counts import answer, distinct, hash_bits, looked_up

#: Bytes of text of a block, and rows that a text must have as a share of all (one in `HOT`) to be sent on for one id only.
BLOCK_BYTES, HOT = 6 << 20, 1000
#: Digests that a task remembers to send each text on once.
REMEMBERED = 1 << 18
#: Groups of hashes whose counts bound the distance of two sets (the suffix filter): so many that even sets of
#: several thousand n-grams of unlike texts differ by more than the similarity allows. Counts stop at 127, which only loosens the bound.
GROUPS = 128
#: One class of this many takes part in the sampled round.
SAMPLE = 16
#: Bits of the rank of an n-gram in its key; the others are those of its hash.
RANK_BITS = np.uint64(6)


def plain(text: bytes) -> bytes:
    """The words, A-Z lower-cased, with one space between.

    bytes.split() splits at 0x20 and 0x09-0x0D and bytes.lower() touches A-Z only, as the contracts ask.
    """
    return b" ".join(text.lower().split())


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The hashes of each text's n-grams of lower-cased words, in order; of a shorter text that of all its words."""
    words, counts = hashed_words(texts)
    grams = words[: max(len(words) - n + 1, 0)]
    for k in range(1, n):
        grams = fold(grams, words[k : k + len(grams)])
    out, start = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(grams[start : start + count - n + 1])
        elif count:
            whole = np.full(1, 0x5851F42D4C957F2D + count, np.uint64)
            for w in words[start : start + count]:
                whole = fold(whole, np.full(1, w, np.uint64))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        start += count
    return out


def unique(sorted_values: np.ndarray) -> np.ndarray:
    keep = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=keep[1:])
    return sorted_values[keep]


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "__text"):
        words = [plain(x) for x in utf8(batch.column("__text"))]
        made = [pa.array([xxhash.xxh3_128_digest(x) if x else None for x in words], pa.binary()), pa.array([len(x) for x in words], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.select(["__id", "id_hash"]).columns, *made], ["__id", "id_hash", "class", "n_bytes"])


def _sent(hot):
    """Each class that comes by and its words, but those of hot classes for the id named only."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, seen = hot.value, set()
        for batch in by_bytes(batches, "__text"):
            classes, texts = [], []
            for h, raw in zip(batch.column("id_hash").to_pylist(), utf8(batch.column("__text"))):
                words = plain(raw)
                digest = xxhash.xxh3_128_digest(words)
                if words and digest not in seen and least.get(digest, h) == h:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    classes.append(digest)
                    texts.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(texts, pa.binary())], ["class", "words"])

    return send


def _block(table: pa.Table, n: int) -> tuple[list[bytes], list[np.ndarray]]:
    """A block's classes, each once, in an order of their own, and their n-grams."""
    own = dict(zip(table["class"].to_pylist(), table["words"].to_pylist()))
    classes = sorted(own)
    return classes, shingles([own[c] for c in classes], n)


def _gathered(n: int, bits: int):
    def gather(table: pa.Table):
        _, grams = _block(table, n)
        values, counts, _ = distinct(np.concatenate(grams) >> np.uint64(64 - bits), bits=bits)
        return [(values, counts)]

    return gather


def ranked(counts: np.ndarray) -> np.ndarray:
    """The rank of an n-gram by its count: 0 for 1, then three ranks an octave."""
    return np.minimum(np.ceil(3 * np.log2(np.maximum(counts, 1))), 63).astype(np.uint64)


_FIELDS = pa.schema([("class", pa.binary()), ("size", pa.int64()), ("centre", pa.float32()), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("groups", pa.list_(pa.int8())), ("hashes", pa.binary())])
_FIELDS_SQL = "class binary, size long, centre float, grams array<long>, places array<int>, groups array<tinyint>, hashes binary"


def _prefixed(n: int, percent: int, bits: int):
    """Each class's size, and for those that may meet others the shared n-grams of their prefix, and their set."""

    def prefix(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _FIELDS.empty_table()
        classes, grams = _block(table, n)
        del table
        flat = np.concatenate(grams)
        at = distinct(flat >> np.uint64(64 - bits), bits=bits)[2]
        keys = ranked(answer(told, 0)[0])[at] << np.uint64(64 - RANK_BITS) | flat >> RANK_BITS
        del flat, at, told
        first_shared, rows, start = np.uint64(1) << np.uint64(64 - RANK_BITS), [], 0
        for name, own in zip(classes, grams):
            key = unique(np.sort(keys[start : start + len(own)]))
            start += len(own)
            size = len(key)
            keep = size - -(-percent * size // 100) + 1
            alone = int(np.searchsorted(key[:keep], first_shared))
            if alone == keep:
                rows.append((name, size, None, None, None, None, None))
                continue
            found = unique(np.sort(own))
            counts = np.bincount((found & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
            centre = float((key >> np.uint64(64 - RANK_BITS)).mean())
            rows.append((name, size, centre, key[alone:keep].view(np.int64), np.arange(alone, keep, dtype=np.int32), np.minimum(counts, 127).astype(np.int8), found.tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

    return prefix


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The least intersection of sets of these sizes that gives the similarity."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _verified(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, keep = batch.column("left").to_pylist(), batch.column("right").to_pylist(), []
            for a, b in zip(left, right):
                both = np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
                total = len(both)
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (total - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return verify


class JaccardJoin:
    """The join of one table with itself; see the module's text."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90, block_bytes: int = BLOCK_BYTES):
        self.percent = percent
        texts = docs.select(F.col(f"`{key}`").alias("__id"), F.xxhash64(F.col(f"`{key}`")).alias("id_hash"), F.col(f"`{text}`").cast("string").alias("__text"))
        id_type = texts.schema["__id"].dataType.simpleString()
        self.rows = durable(texts.mapInArrow(_classed, f"__id {id_type}, id_hash long, class binary, n_bytes long"))
        each = self.rows.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("id_hash").alias("least"), F.max("n_bytes").alias("size"))
        size, rows = each.agg(F.sum("size"), F.sum("n")).first()
        # At most HOT of them: each has more than one in HOT of the rows.
        often = each.where((F.col("n") * HOT > (rows or 0)) & (F.col("n") > 16)).select("class", "least").collect()
        hot = docs.sparkSession.sparkContext.broadcast({bytes(r["class"]): r["least"] for r in often})
        blocks, bits = -(-(size or 0) // block_bytes) or 1, hash_bits((size or 0) // 4, 12)
        sent = texts.select("id_hash", "__text").mapInArrow(_sent(hot), "class binary, words binary")
        dealt = sent.select(F.pmod(F.xxhash64("class"), F.lit(blocks)).alias("block"), "class", "words")
        self.classes = durable(looked_up(dealt, blocks, bits, _gathered(n, bits), _prefixed(n, percent, bits), _FIELDS_SQL))

    def buckets(self) -> DataFrame:
        """Shared n-grams of prefixes that two classes have at least, a row for each of their classes."""
        level = F.pmod(F.xxhash64("class"), F.lit(SAMPLE)) == 0
        wide = self.classes.where("grams is not null").select("class", "size", "centre", level.alias("sampled"), F.explode(F.arrays_zip("grams", "places")).alias("x"))
        wide = wide.select("class", "size", "centre", "sampled", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
        # The most central class of a bucket has the n-grams that the others share.
        hubs = wide.groupBy("gram").agg(F.count("*").alias("n"), F.max(F.struct("centre", "class"))["class"].alias("hub")).where("n > 1").select("gram", "hub")
        return durable(wide.join(hubs, "gram").withColumn("hub", F.col("hub") == F.col("class")).drop("centre"))

    def _pairs(self, left: DataFrame, right: DataFrame, also: Column) -> DataFrame:
        """Candidates between different components that pass all filters, each once."""
        a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
        b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
        sa, sb, t = F.col("a_size"), F.col("b_size"), self.percent
        meets = (
            (F.col("a_gram") == F.col("b_gram"))
            & (F.col("a_comp") != F.col("b_comp"))
            & also
            & (100 * sa >= t * sb)  # length
            & (100 * sb >= t * sa)
            & (1 + F.least(sa - F.col("a_place") - 1, sb - F.col("b_place") - 1) >= least_overlap(sa, sb, t))  # position
        )
        met = a.join(b, meets).select(F.col("a_class").alias("u"), F.col("b_class").alias("v"), (sa + sb - 2 * least_overlap(sa, sb, t)).alias("apart")).distinct()
        own = self.classes.where("grams is not null").select("class", "groups")
        met = met.join(own.select(F.col("class").alias("u"), F.col("groups").alias("gu")), "u").join(own.select(F.col("class").alias("v"), F.col("groups").alias("gv")), "v")
        apart = F.aggregate(F.zip_with("gu", "gv", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda x, y: x + y)
        return met.where(apart <= F.col("apart")).select("u", "v")  # suffix

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are similar."""
        sets = self.classes.where("grams is not null").select("class", "hashes")
        with_v = pairs.join(sets.select(F.col("class").alias("v"), F.col("hashes").alias("right")), "v")
        full = with_v.join(sets.select(F.col("class").alias("u"), F.col("hashes").alias("left")), "u")
        return durable(full.select("u", "v", "left", "right").mapInArrow(_verified(self.percent), "u binary, v binary"))

    def roots(self) -> DataFrame:
        """node, root: each class that is linked, and its component's smallest class."""
        found, here = None, self.buckets().withColumn("comp", F.col("class"))
        b_hub, b_in = F.col("b_hub"), F.col("b_sampled")
        rounds = (
            (F.col("hub"), ~b_hub),
            (F.col("sampled") & ~F.col("hub"), ~b_hub & (~b_in | (F.col("a_class") < F.col("b_class")))),
            (~F.col("sampled") & ~F.col("hub"), ~b_hub & ~b_in & (F.col("a_class") < F.col("b_class"))),
        )
        for leads, also in rounds:
            pairs = durable(self._pairs(here.where(leads), here, also))
            new = None if pairs.isEmpty() else self._links(pairs)
            if new is None or new.isEmpty():
                continue
            # What was found before is a star for each component, so links never pile up.
            stars = None if found is None else found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
            found = durable(components(new if stars is None else new.unionByName(stars)))
            named = here.drop("comp").join(found, F.col("class") == F.col("node"), "left")
            named = named.withColumn("comp", F.coalesce("root", "class")).drop("node", "root")
            # Buckets whose classes are all in one component have nothing left to find.
            open_ = named.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
            here = durable(named.join(open_, "gram", "left_semi"))
        return self.rows.select(F.col("class").alias("node"), F.col("class").alias("root")).limit(0) if found is None else found

    def labelled(self) -> DataFrame:
        """__id, size, component: the smallest id reachable by links."""
        roots = self.roots()
        least = self.rows.where("class is not null").groupBy("class").agg(F.min("__id").alias("least"))
        named = least.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
        best = named.groupBy("root").agg(F.min("least").alias("component"))
        # Sizes of classes that a hot id sends on more than once are the same.
        sizes = self.classes.select(F.col("class").alias("of"), "size")
        by_class = named.join(best, "root").select("class", "component").join(sizes, F.col("class") == F.col("of")).select("of", "size", "component")
        joined = self.rows.select("__id", "class").join(by_class, F.col("class") == F.col("of"), "left")
        return joined.select("__id", F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.coalesce("component", "__id").alias("component"))


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """`key`, n_shingles, component_id for each row of `docs`."""
    out = JaccardJoin(docs, key, text, n, percent).labelled()
    return out.select(F.col("__id").alias(key), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with the columns it had: that with the smallest id; a null id comes last.

    A row is known by its id and a hash of all its columns, so equal ids of different texts stay apart; of
    a row that is there several times one is kept. Rows with empty texts are linked with nothing and all stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("__row"), F.col(f"`{key}`").alias("id"), F.xxhash64(*columns).alias("h"), F.col(f"`{text}`").cast("string").alias("text"))
    named = packed.select(F.struct(F.col("id").isNull().alias("no"), "id", "h").alias("k"), "text")
    labelled = durable(JaccardJoin(named, "k", "text", n, percent).labelled())
    kept = labelled.where((F.col("size") == 0) | (F.col("__id") == F.col("component")))
    counted = durable(kept.groupBy("__id").agg(F.count("*").alias("times"), F.max("size").alias("size")))
    single = counted.where("times = 1 or size = 0").select(F.col("__id.id").alias("of"), F.col("__id.h").alias("oh"))
    again = counted.where("times > 1 and size > 0").select(F.col("__id.id").alias("of"), F.col("__id.h").alias("oh"))
    same = (F.col("h") == F.col("oh")) & F.col("id").eqNullSafe(F.col("of"))
    rows = packed.drop("text")
    out = rows.join(single, same, "left_semi").select("__row.*")
    if again.isEmpty():
        return out
    return out.unionByName(rows.join(again, same, "left_semi").select("__row.*").distinct())
