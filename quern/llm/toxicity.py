"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words (A-Z lower-cased, punctuation taken off) and the words' first four and five
bytes, each hashed to one of 2^32 buckets. The machine has a weight and a short vector for each bucket; the dot products of
vectors let pairs of terms count together, such as an insult and the mention of a group, which a
sum of weights misses.

All buckets are fitted, with a penalty of `LEAST_Z` standard errors of a bucket's own slope: what the residuals say
about its weight or its vector by less than that leaves both at zero. As in other active-set methods, rounds take turns: every
bucket's slopes are taken over all rows, given the machine so far, then the non-zero ones are fitted. So a term that says nothing
alone comes in once the terms it goes with are in. Two that say nothing alone but much together (an exclusive or) have no slope
at zero; such pairs are found by counting pairs, and start with vectors.

It is fitted on a bounded sample of labelled rows that the caller allows for training: at most `SAMPLE_ROWS`, by a hash of their ids, and
`SAMPLE_BYTES` of terms; one row of each id. The sample's terms are collected, the model is broadcast. Every
text is then scored whole.

Nulls and odd cases: a null or empty text has no terms and gets the score of the bias; without labels of both
kinds the score is the smoothed share of label 1 (0.5 without labels); labels with a null are passed over, of
a repeated id the larger label counts, and of its texts the first in order; repeated documents stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import by_bytes, durable, each_part, id_remainder, keyed, named, utf8
from .counts import distinct

SAMPLE_ROWS, SAMPLE_BYTES, LEAST_TEXTS = 10_000, 256 << 20, 3
#: A bucket's penalty in standard errors of its slope. A telling pair is more (or less) often toxic than all texts and than either member,
#: beyond a chance of `PAIR_CHANCE` that any pair is by luck.
LEAST_Z, PAIR_CHANCE, PAIR_BLOCK = 4.0, 0.01, 512
FACTORS, ROUNDS, EPOCHS, BATCH, STEP, DECAY, SEED = 4, 3, 20, 256, 0.1, 1e-3, 7
#: Spread of the starting vectors of telling pairs.
PAIR_START = 0.03
THRESHOLD = 0.7
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def word_terms(word: bytes) -> tuple[int, ...]:
    """The hashed terms of one lower-cased word."""
    word = word.strip(_MARKS)
    if not word:
        return ()
    out = [xxhash.xxh32_intdigest(b"w" + word)]
    out += [xxhash.xxh32_intdigest(b"p" + word[:n]) for n in (4, 5) if len(word) >= n]
    return tuple(out)


class _Terms(dict):
    """word -> its terms, or with a model the places of those that it has."""

    LIMIT = 1 << 19

    def __init__(self, place: dict[int, int] | None = None):
        self.place = place

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        terms = word_terms(word)
        if self.place is not None:
            terms = tuple(self.place[t] for t in terms if t in self.place)
        self[word] = terms
        return terms

    def of(self, text: bytes) -> list[int]:
        """Distinct terms of a text, sorted."""
        return sorted(set().union(*map(self.__getitem__, set(text.lower().split()))))


def telling_pairs(kept: list[np.ndarray], labels: np.ndarray, total: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Which terms are in a telling pair; `kept` has the numbers of each row's terms, `total` and `hits` their rows and toxic ones.

    The chance is Chernoff's bound for the toxic rows of a pair, over the pairs of all terms in `LEAST_TEXTS` rows or
    more. A pair needs some toxic rows for it, so terms in fewer of them are passed over at no loss; the others'
    pairs are all counted, a block of terms at a time.
    """
    share = labels.mean()
    usable = total >= LEAST_TEXTS
    evidence = np.log(max(usable.sum(), 2) ** 2 / 2 / PAIR_CHANCE)
    places = np.flatnonzero(usable & (hits * -np.log(share) >= evidence))
    telling = np.zeros(len(total), bool)
    if len(places) < 2:
        return telling
    number = np.full(len(total), -1)
    number[places] = np.arange(len(places))
    rows = [x[x >= 0] for x in (number[r] for r in kept)]
    # Toxic rows first, so that each part of the rows has one label.
    parts = [(y, [rows[i] for i in at[k : k + 1000]]) for y in (1, 0) for at in [np.flatnonzero(labels == y)] for k in range(0, len(at), 1000)]
    least = np.maximum(share, hits[places] / total[places])
    for start in range(0, len(places), PAIR_BLOCK):
        both = np.zeros((2, len(places[start : start + PAIR_BLOCK]), len(places)), np.float32)
        for y, part in parts:
            x = np.zeros((len(part), len(places)), np.float32)
            x[np.repeat(np.arange(len(part)), [len(r) for r in part]), np.concatenate(part)] = 1
            both[y] += x[:, start : start + PAIR_BLOCK].T @ x
        a, b = np.nonzero(both[1] * -np.log(share) >= evidence)
        on = a + start != b
        a, b = a[on], b[on]
        toxic = both[1][a, b].astype(np.float64)
        n, e = toxic + both[0][a, b], np.minimum(np.maximum(least[a + start], least[b]), 1 - 1e-9)
        rate = toxic / n
        with np.errstate(divide="ignore", invalid="ignore"):
            against = np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - e)), 0)
        found = (rate > e) & (n * (rate * np.log(rate / e) + against) >= evidence)
        telling[places[a[found] + start]] = telling[places[b[found]]] = True
    return telling


class FactorizationMachine:
    """score = sigmoid(bias + sum of weights + half of (|sum of vectors|^2 - sum of |vector|^2))."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.terms, self.bias, self.weights, self.vectors = terms, bias, weights, vectors

    def margins(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of rows whose terms' places stand one row after another."""
        row = np.repeat(np.arange(len(counts)), counts)
        linear = np.bincount(row, self.weights[places], len(counts))
        sums = np.stack([np.bincount(row, self.vectors[places, f], len(counts)) for f in range(self.vectors.shape[1])], 1)
        squares = np.bincount(row, (self.vectors[places] ** 2).sum(1), len(counts))
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares)

    def scores(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(places, counts), -30, 30)))

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
        """Rounds of slopes of all buckets and of AdaGrad on log loss over those not at zero; seeded, so equal samples give equal models."""
        n, positive = len(rows), int(labels.sum())
        share = (positive + 0.5) / (n + 1)
        bias = float(np.log(share / (1 - share)))
        empty = cls(np.zeros(0, np.uint64), bias, np.zeros(0), np.zeros((0, FACTORS)))
        if not 0 < positive < n:
            return empty
        sizes = np.array([len(r) for r in rows])
        row = np.repeat(np.arange(n, dtype=np.int32), sizes)
        terms, _, at = distinct(np.concatenate(rows).astype(np.uint64), bits=32)
        total, hits = np.bincount(at).astype(np.float64), np.bincount(at, labels[row])
        each = np.split(at, np.cumsum(sizes)[:-1])
        inside = telling_pairs(each, labels, total, hits) | telling_pairs(each, 1 - labels, total, total - hits)
        rng = np.random.default_rng(SEED)
        weights, vectors = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS))
        vectors[inside] = rng.normal(0, PAIR_START, (int(inside.sum()), FACTORS))
        # Sums of squared slopes go on from round to round, else each round would begin with steps of full size.
        squares = [np.full(1, 1e-8), np.full(len(terms), 1e-8), np.full(vectors.shape, 1e-8)]
        for turn in range(ROUNDS):
            margins, sums = np.full(n, bias), np.zeros((n, FACTORS))
            if turn and inside.any():
                on = inside[at]
                counts = np.bincount(row[on], minlength=n)
                machine = cls(terms, bias, weights, vectors)
                margins = machine.margins(at[on], counts)
                sums = np.stack([np.bincount(row[on], vectors[at[on], f], n) for f in range(FACTORS)], 1)
            entering = cls._slopes(at, row, len(terms), labels, margins, sums) & (total >= LEAST_TEXTS) & ~inside
            if not inside.any() and not entering.any():
                return empty
            inside |= entering
            chosen = np.flatnonzero(inside)
            number = np.full(len(terms), -1)
            number[chosen] = np.arange(len(chosen))
            kept = [x[x >= 0] for x in (number[r] for r in each)]
            machine = cls(terms[chosen], bias, weights[chosen], vectors[chosen])
            squares[0], squares[1][chosen], squares[2][chosen] = machine._descend(kept, labels, rng, squares[0], squares[1][chosen], squares[2][chosen])
            bias, weights[chosen], vectors[chosen] = machine.bias, machine.weights, machine.vectors
        return machine

    @staticmethod
    def _slopes(at: np.ndarray, row: np.ndarray, size: int, labels: np.ndarray, margins: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The buckets whose weight or vector has a slope beyond the penalty, at zero, given the machine so far."""
        p = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
        error, spread = labels - p, p * (1 - p)
        if sums.any():
            spread = np.maximum(spread, error**2)  # rows that the machine is wrong and sure about vary more than it says
        beyond = np.abs(np.bincount(at, error[row], size)) > LEAST_Z * np.sqrt(np.bincount(at, spread[row], size))
        if sums.any():
            pull = np.stack([np.bincount(at, (error * sums[:, f])[row], size) for f in range(FACTORS)], 1)
            noise = np.bincount(at, (spread * (sums**2).sum(1))[row], size)
            beyond |= (pull**2).sum(1) > LEAST_Z**2 * noise
        return beyond

    def _descend(self, kept: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, grad_b: np.ndarray, grad_w: np.ndarray, grad_v: np.ndarray):
        n, size = len(kept), len(self.terms)
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for start in range(0, n, BATCH):
                part = order[start : start + BATCH]
                counts = np.array([len(kept[i]) for i in part])
                places = np.concatenate([kept[i] for i in part])
                error = self.scores(places, counts) - labels[part]
                row = np.repeat(np.arange(len(part)), counts)
                e = error[row]
                sums = np.stack([np.bincount(row, self.vectors[places, f], len(part)) for f in range(FACTORS)], 1)
                g_w = np.bincount(places, e, size) / len(part) + DECAY * self.weights / size
                pull = e[:, None] * (sums[row] - self.vectors[places])
                g_v = np.stack([np.bincount(places, pull[:, f], size) for f in range(FACTORS)], 1) / len(part) + DECAY * self.vectors / size
                g_b = float(error.mean())
                grad_b, grad_w, grad_v = grad_b + g_b**2, grad_w + g_w**2, grad_v + g_v**2
                self.bias -= STEP * g_b / float(grad_b[0]) ** 0.5
                self.weights -= STEP * g_w / np.sqrt(grad_w)
                self.vectors -= STEP * g_v / np.sqrt(grad_v)
        return grad_b, grad_w, grad_v


def _termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Terms()
    for batch in by_bytes(batches, "__text"):
        made = [np.array(memo.of(x), np.uint32).tobytes() for x in utf8(batch.column("__text"))]
        yield pa.RecordBatch.from_arrays([batch.column("__order"), batch.column("__label"), pa.array(made, pa.binary())], ["__order", "__label", "terms"])


def training_sample(labels: DataFrame, allowed, key: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` labelled ids that the column `allowed` lets into training, by a hash of the id."""
    usable = labels.select(F.col(f"`{key}`").alias("__of"), F.col(f"`{label}`").cast("int").alias("__label")).where(F.col("__of").isNotNull() & F.col("__label").isNotNull())
    usable = usable.where(allowed(F.col("__of"))).groupBy("__of").agg(F.max("__label").alias("__label"))
    return usable.orderBy(F.xxhash64("__of"), "__of").limit(rows)


def train(docs: DataFrame, labels: DataFrame, allowed, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """A model from the sample's texts; the sample, bounded by `rows`, is what is broadcast and collected."""
    sample = training_sample(labels, allowed, key, label, rows)
    texts = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))
    met = texts.join(F.broadcast(sample), F.col("__key") == F.col("__of"))
    one = met.groupBy(F.xxhash64("__of").alias("__order"), "__of").agg(F.first("__label").alias("__label"), F.min("__text").alias("__text"))
    termed = durable(one.select("__order", "__label", "__text").mapInArrow(_termed, "__order long, __label int, terms binary"))
    # The first rows by hash whose terms fit; sizes of at most `rows` rows are looked at.
    sizes = termed.select("__order", F.octet_length("terms").cast("long").alias("size")).orderBy("__order").toArrow()
    fits = np.cumsum(sizes["size"].to_numpy()) <= SAMPLE_BYTES
    last = int(sizes["__order"].to_numpy()[fits].max()) if fits.any() else -(1 << 63)
    found = termed.where(F.col("__order") <= last).toArrow().to_pydict()
    # Sorted, so that the model doesn't depend on the order in which tasks end.
    pairs = sorted(zip(found.pop("terms"), found.pop("__label")))
    return FactorizationMachine.fit([np.frombuffer(t, np.uint32) for t, _ in pairs], np.array([y for _, y in pairs], np.float64))


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = _Terms({int(t): i for i, t in enumerate(model.terms)})
        for batch in by_bytes(batches, "__text"):
            rows = [memo.of(x) for x in utf8(batch.column("__text"))]
            counts = np.array([len(r) for r in rows], np.int64)
            places = np.array([p for r in rows for p in r], np.int64)
            scores = model.scores(places, counts) if len(rows) else np.zeros(0)
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores, pa.float64())], [*names, "__score"])

    return score


def scored(docs: DataFrame, model: FactorizationMachine, keys: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """`keys` and the score of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = keyed(docs, keys, __text=F.col(f"`{text}`").cast("string"))
    found = kept.mapInArrow(_scored(shared), T.StructType(list(kept.drop("__text").schema.fields)).add("__score", "double"))
    return named(found.withColumnRenamed("__score", name), keys)


def not_toxic(docs: DataFrame, model: FactorizationMachine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with a score below the threshold, with the columns they had."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memo: list[_Terms] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        if not memo:
            memo.append(_Terms({int(t): i for i, t in enumerate(model.terms)}))

        def scores(part: list[bytes]) -> np.ndarray:
            rows = [memo[0].of(x) for x in part]
            return model.scores(np.array([p for r in rows for p in r], np.int64), np.array([len(r) for r in rows], np.int64))

        return each_part(texts, scores, pa.float64())

    return docs.where(score(F.col(f"`{text}`").cast("string")) < threshold)


def trainable(key, modulus: int = 3, left_out: int = 1):
    """True for ids that may be trained on: crc32 of the id's text isn't `left_out` modulo `modulus`."""
    return id_remainder(key, modulus) != left_out
