"""LM scoring: a weighted backoff automaton over smoothed n-grams.

The model is a hierarchy of Dirichlet-smoothed n-grams: P(w | g) = (c(gw) + m P(w | g')) / (c(g) + m), where g' is
g without its first word, down to P(w) = (c(w) + 1) / (N + V + 1). As an automaton every n-gram
seen in training that can be a context is a state; a seen continuation is an arc; any other word takes
the failure arc to the state of g' at the cost of log10(m / (c(g) + m)). A text is one left-to-right
traversal that carries the state and adds up log probabilities.

Counts are those of all training texts, none is pruned, so the automaton grows with the corpus and no worker
holds it whole. Rows are dealt into blocks of about `BLOCK_BYTES` by id and text. Each block asks how often its distinct n-grams,
as hashes, occur in training (`counts`), builds the part of the automaton that its own texts can reach and
traverses it, its texts in lockstep. N and V come with the same answers. Messages grow in proportion to the blocks.

Nulls and odd cases: a null or empty text is the end token alone; a null id counts as the empty text for the
split; without training rows every token has probability 1 (N = V = 0); repeated rows stay (one that makes more than a
thousandth of all rows is scored once and laid out again); an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import fold, hashed_words, utf8
from .counts import answer, distinct, hash_bits, looked_up

ORDER = 3
#: Strength of each order's prior, from order 2 on (the last one holds for all further orders).
STRENGTHS = (1000.0, 100.0)
BLOCK_BYTES = 12 << 20
#: Rows that are the same are scored once if they are more than one in HOT of all.
HOT = 1000
#: Steps that a text is traversed at once; longer ones go on in further lanes, warmed up with what came before.
LANE = 2048
_END, _START = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


class BlockGrams:
    """The n-grams of a block's texts, order by order, numbered in the order of their hashes of `bits` bits.

    `tokens` has a start, the words and an end for each text; `at[k]` gives for each token the number of the
    (k + 1)-gram that ends there, or -1 at a start or where the text doesn't reach back so far. Of a gram `prefix`
    and `suffix` are the numbers of the gram without its last and first word.
    """

    def __init__(self, texts: list[bytes], order: int, bits: int = 64):
        words, counts = hashed_words(texts)
        self.lengths = counts + 2
        self.starts = np.cumsum(self.lengths) - self.lengths
        n, cut = int(self.lengths.sum()), np.uint64(64 - bits)
        own = np.empty(n, np.uint64)
        inner = np.ones(n, bool)
        inner[self.starts] = inner[self.starts + self.lengths - 1] = False
        own[inner], own[self.starts], own[self.starts + self.lengths - 1] = words, _START, _END
        del words, inner
        values, _, self.tokens = distinct(own >> cut, bits=bits)
        self.first = int(np.searchsorted(values, _START >> cut))  # the start's number
        self.values, self.at, self.prefix, self.suffix = [values], [self.tokens], [None], [None]
        reaches, hashes = np.ones(n, bool), own
        for k in range(1, order):
            reaches[self.starts[self.lengths >= k] + k - 1] = False
            here = np.flatnonzero(reaches)
            longer = np.zeros(n, np.uint64)
            longer[here] = fold(hashes[here - 1], own[here])
            hashes = longer
            values, _, number = distinct(hashes[here] >> cut, bits=bits)
            at = np.full(n, -1, np.int32)
            at[here] = number
            prefix, suffix = np.empty(len(values), np.int32), np.empty(len(values), np.int32)
            prefix[number], suffix[number] = self.at[k - 1][here - 1], self.at[k - 1][here]
            self.values.append(values)
            self.at.append(at)
            self.prefix.append(prefix)
            self.suffix.append(suffix)

    def counts(self, k: int, times: np.ndarray) -> np.ndarray:
        """How often each (k + 1)-gram ends in the texts, each counted so many times."""
        weights = np.repeat(times, self.lengths)
        used = (self.at[k] >= 0) & (weights > 0)
        return np.bincount(self.at[k][used], weights[used], len(self.values[k])).astype(np.int64)


class BackoffAutomaton:
    """States, arcs and failure arcs for the n-grams of a block, from their counts in training.

    All n-grams are numbered through, shorter ones first. Those seen that can be a context are states, with
    `failure` and `weight`: where a state falls back to and at what cost. The arc of a state under a word is
    the n-gram of both; it is there if that was seen, with `value` and `target`. The root is the last state; it has an arc for each word.
    """

    def __init__(self, grams: BlockGrams, counts: list[np.ndarray], total: int, distinct_words: int, strengths: tuple[float, ...]):
        offsets = np.cumsum([0, *map(len, counts)])
        size, top = int(offsets[-1]), len(counts) - 1
        self.at = np.full((top + 1, len(grams.tokens)), -1, np.int32)  # by the state's length: the arc's number at each token
        self.root, self.seen = size, np.zeros(size + 1, bool)
        self.value, self.weight = np.zeros(size + 1), np.zeros(size + 1)
        self.target, self.failure = np.full(size + 1, size, np.int32), np.full(size + 1, size, np.int32)
        self.depth = np.zeros(size + 1, np.int8)
        probability = (counts[0] + 1) / (total + distinct_words + 1)
        for k, own in enumerate(counts):
            here, m = slice(offsets[k], offsets[k + 1]), strengths[min(k, len(strengths) - 1)]
            on = grams.at[k] >= 0
            self.at[k, on] = grams.at[k][on] + offsets[k]
            if k:
                prior = strengths[min(k - 1, len(strengths) - 1)]
                probability = (own + prior * probability[grams.suffix[k]]) / (counts[k - 1][grams.prefix[k]] + prior)
                shorter = grams.suffix[k] + np.int32(offsets[k - 1])
            self.seen[here] = (own > 0) | (k == 0)
            self.value[here] = np.log10(probability)
            if k < top:
                state = own > 0
                self.depth[here] = k + 1
                self.target[here] = np.where(state, np.arange(offsets[k], offsets[k + 1], dtype=np.int32), np.int32(size))
                self.weight[here] = np.log10(m / (own + m))
                if k:
                    self.failure[here] = shorter
            elif k:
                self.target[here] = shorter

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each lane's word, at the places `token`, and its next state."""
        score, out, rest = np.zeros(len(state)), np.empty(len(state), np.int32), None
        while len(state):
            arc = self.at[self.depth[state], token]
            hit = self.seen[arc]
            gain = np.where(hit, self.value[arc], self.weight[state])
            if rest is None:
                score += gain
                out[hit] = self.target[arc[hit]]
                rest = np.flatnonzero(~hit)
            else:
                score[rest] += gain
                out[rest[hit]] = self.target[arc[hit]]
                rest = rest[~hit]
            state, token = self.failure[state[~hit]], token[~hit]
        return score, out


def traverse(automaton: BackoffAutomaton, grams: BlockGrams, order: int) -> np.ndarray:
    """Each text's sum of log probabilities."""
    lanes = -(-(grams.lengths - 1) // LANE)
    text = np.repeat(np.arange(len(lanes)), lanes)
    begin = grams.starts[text] + 1 + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    size = np.minimum(LANE, grams.starts[text] + grams.lengths[text] - begin)
    by_length = np.argsort(-size, kind="stable")
    text, begin, size = text[by_length], begin[by_length], size[by_length]
    # The state before a lane's first word is that of the longest seen n-gram that ends there.
    state = np.full(len(text), automaton.root, np.int32)
    for ahead in range(max(order - 1, 1), 0, -1):
        on = begin - ahead >= grams.starts[text]
        state[on] = automaton.step(state[on], begin[on] - ahead)[1]
    total = np.zeros(len(text))
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left").tolist()  # lanes longer than t stand in front
    for t, n in enumerate(active):
        score, state = automaton.step(state[:n], begin[:n] + t)
        total[:n] += score
    return np.bincount(text, total, len(grams.lengths))


def _gathered(order: int, bits: int):
    """A block's distinct n-grams of each order and how often they occur in its training texts."""

    def gather(table: pa.Table):
        grams = BlockGrams(utf8(table["__text"]), order, bits)
        times = np.where(table["__train"].to_numpy(), table["__times"].to_numpy(), 0)
        for k in range(order):
            yield grams.values[k], grams.counts(k, times)

    return gather


def _scored(order: int, bits: int, strengths: tuple[float, ...], out: pa.Schema):
    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        grams, counts = BlockGrams(utf8(table["__text"]), order, bits), []
        table = table.drop_columns(["__text"])
        for k in range(order):
            sums, tokens, kinds = answer(told, k)
            counts.append(sums)
            if not k:
                # The start is a context, not a token.
                total, vocabulary = tokens - int(counts[0][grams.first]), kinds - int(counts[0][grams.first] > 0)
        unigrams = counts[0].copy()
        unigrams[grams.first] = 0
        logs = np.log10((unigrams + 1) / (total + vocabulary + 1))
        logs[grams.first] = 0.0
        base = np.add.reduceat(logs[grams.tokens], grams.starts)
        known = np.add.reduceat((unigrams > 0).astype(np.int64)[grams.tokens], grams.starts)
        sums = traverse(BackoffAutomaton(grams, counts, total, vocabulary, strengths), grams, order)
        made = [table["__id"], table["__held"], pa.array(grams.lengths - 1), pa.array(known), pa.array(np.full(len(base), total)), pa.array(base), pa.array(sums)]
        found = pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made], out.names[:-1])
        return found.append_column("__times", table["__times"]).cast(out)

    return score


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, strengths: tuple[float, ...] = STRENGTHS, block_bytes: int = BLOCK_BYTES, **routing) -> DataFrame:
    """`key`, held_out, n_tokens, n_known, train_tokens, base_score and score for each row; rows that aren't held out are trained on."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(f"`{key}`").alias("__id"), held_out.alias("__held"), F.col(f"`{text}`").cast("string").alias("__text"))
    rows = rows.select(F.xxhash64("__id", "__text").alias("__row"), "__id", "__held", (~F.col("__held")).alias("__train"), "__text")
    each = rows.groupBy("__row").agg(F.count("*").alias("n"), F.sum(F.octet_length("__text").cast("long")).alias("size"))
    size, count, most = each.agg(F.sum("size"), F.sum("n"), F.max("n")).first()
    blocks, bits = -(-(size or 0) // block_bytes) or 1, hash_bits((size or 0) // 4, 20)
    dealt = rows.withColumn("__times", F.lit(1).cast("long"))
    if most and most > 16 and most * HOT > count:
        # At most HOT of them: each has more than one in HOT of the rows.
        often = [r["__row"] for r in each.where((F.col("n") * HOT > count) & (F.col("n") > 16)).select("__row").collect()]
        once = rows.where(F.col("__row").isin(often)).groupBy(*rows.columns).agg(F.count("*").alias("__times"))
        dealt = dealt.where(~F.col("__row").isin(often)).unionByName(once)
    dealt = dealt.select(F.pmod("__row", F.lit(blocks)).alias("block"), "__id", "__held", "__train", "__times", "__text")
    schema = T.StructType([T.StructField("__id", rows.schema["__id"].dataType)]).add("held_out", "boolean")
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("__times", "long")):
        schema = schema.add(name, kind)
    found = looked_up(dealt, blocks, bits, _gathered(order, bits), _scored(order, bits, tuple(strengths), to_arrow_schema(schema)), schema, **routing)
    if most and most > 16 and most * HOT > count:
        found = found.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "__times")))
    return found.select(F.col("__id").alias(key), *[c for c in schema.names[1:-1]])
