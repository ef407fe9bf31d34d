"""Host-level quality rules: rule failures by domain, shrunk by an empirical beta prior, joined back to documents.

Text rules run in Arrow passes; everything on hosts is DataFrame work. A host's failure rate has a beta posterior, from the
prior of all hosts' rates. The host is rejected, with all its documents, if the rate is above `HOST_LIMIT` by `REJECT_Z` standard
deviations of the posterior, and watched if it is above the prior's mean by `WATCH_Z`: documents of a watched host are held to
the stricter limit `WATCHED_REPEAT_PERCENT`. So a host with few documents is judged by what it shows beyond chance only.

A domain may hold a third of all rows: it is counted with partial aggregation. The host table is
broadcast if counted small; else hosts with more than one in `HOT` of all rows, at most `HOT` of them, are broadcast, and the others joined.
`host_rules` reads the texts twice, once for the hosts and once for the rows, instead of writing all documents in between.

Nulls and odd cases: a null text has no words and fails; a null domain is a domain of its own; repeated
rows stay repeated; an empty table gives an empty result; extra columns are kept by `host_rules`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_bytes, durable, each_part, named, utf8

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
WATCHED_REPEAT_PERCENT = 10
#: The failure rate beyond which a host is rejected; standard deviations of the posterior for the verdicts (one-sided 95 % and 80 %).
HOST_LIMIT, REJECT_Z, WATCH_Z = 0.5, 1.645, 0.842
#: The prior counts for at least and at most so many documents.
STRENGTHS = (2.0, 100.0)
#: Rows of the host table up to which it is broadcast (counted first); beyond, hosts with more than one in HOT of the rows are.
FEW_HOSTS, HOT = 5_000, 1_000
_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of `window` words found at least twice, the first finding included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    # Exact ranks of windows of growing length: a pair of ranks is ranked again, so nothing is hashed.
    rank, length = code, 1
    while length < window:
        step = min(length, window - length)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank, length = np.unique(pair, return_inverse=True)[1], length + step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_features(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass")) if not joined.isascii() else len(joined)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "__text"):
        rows = np.array([text_features(x) for x in utf8(batch.column("__text"))], np.int64).reshape(-1, len(_FEATURES))
        rest = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in rest] + [pa.array(rows[:, i]) for i in range(len(_FEATURES))], [*rest, *_FEATURES])


def _failed(n_words: Column, n_repeat_words: Column, percent: int) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > percent * n_words)


def rule_features(docs: DataFrame, columns: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns, the five features, base_failed and strict_failed, a row for each row of `docs`."""
    kept = docs.select(*[c.alias(n) for n, c in columns.items()], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = kept.drop("__text").schema
    for name in _FEATURES:
        schema = schema.add(name, "long")
    limits = {"base_failed": MAX_REPEAT_PERCENT, "strict_failed": WATCHED_REPEAT_PERCENT}
    return kept.mapInArrow(_featured, schema).withColumns({n: _failed(F.col("n_words"), F.col("n_repeat_words"), p) for n, p in limits.items()})


def beta_prior(moments: tuple[int, float | None, float | None, float | None]) -> tuple[float, float]:
    """Alpha and beta by the method of moments from (hosts, mean rate, variance of rates, mean of 1/n).

    The binomial part of the variance is taken off first. Fewer than two hosts or no spread give the
    strongest prior around the mean.
    """
    hosts, mean, variance, inverse = moments
    mean = min(max(mean or 0.0, 1e-4), 1 - 1e-4)
    between = max(0.0, (variance or 0.0) - mean * (1 - mean) * (inverse or 0.0))
    strength = mean * (1 - mean) / between - 1 if hosts > 1 and between > 1e-9 else STRENGTHS[1]
    strength = min(max(strength, STRENGTHS[0]), STRENGTHS[1])
    return mean * strength, (1 - mean) * strength


def host_rates(features: DataFrame, host: str) -> DataFrame:
    """Each host's documents, failures, shrunk rate and verdicts; no host is dropped."""
    hosts = features.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    row = hosts.agg(F.count("*"), F.avg(rate), F.var_samp(rate), F.avg(1 / F.col("host_docs"))).first()  # one row
    alpha, beta = beta_prior(tuple(row))
    weight = F.col("host_docs") + F.lit(alpha + beta)
    shrunk = (F.col("host_failures") + F.lit(alpha)) / weight
    spread = F.sqrt(shrunk * (1 - shrunk) / (weight + 1))
    return hosts.withColumn("host_rate", shrunk).withColumns({"host_rejected": shrunk - REJECT_Z * spread > HOST_LIMIT, "host_watched": shrunk - WATCH_Z * spread > alpha / (alpha + beta)})


def _verdict(base_failed: Column, strict_failed: Column) -> Column:
    """Whether a document stays, with its host's verdict beside it."""
    return ~base_failed & ~F.coalesce("host_rejected", F.lit(False)) & ~(strict_failed & F.coalesce("host_watched", F.lit(False)))


def judged(docs: DataFrame, keys: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """`keys`, features, base_failed, host_docs, host_failures, host_rate, host_verdict and kept for each row of `docs`.

    kept is false if base_failed, else the verdict of the host and the stricter limit for watched ones.
    """
    own = {f"__key{i}": F.col(f"`{k}`") for i, k in enumerate(keys)} | {"__host": F.col(f"`{host}`").cast("string")}
    features = durable(rule_features(docs, own, text))
    hosts = durable(host_rates(features, "__host").withColumnRenamed("__host", "__of"))
    joined = _by_host(features, hosts)
    verdict = F.when(F.col("host_rejected"), "rejected").when(F.col("host_watched"), "watched").otherwise("usual")
    out = joined.withColumns({"host_verdict": verdict, "kept": _verdict(F.col("base_failed"), F.col("strict_failed"))})
    return named(out.select(*[c for c in own if c != "__host"], *_FEATURES, "base_failed", "host_docs", "host_failures", "host_rate", "host_verdict", "kept"), keys)


def host_rules(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns they had.

    Every row is judged by a struct of its own columns, so repeated rows, null ids and extra columns
    of any name come through; the struct rides along while only its text is read by the rules.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{host}`").cast("string").alias("__host"), F.col(f"`{text}`").cast("string").alias("__text"))
    features = packed.select("__host", "__text").mapInArrow(_host_failed, "__host string, base_failed boolean")
    hosts = host_rates(features, "__host").where("host_rejected or host_watched")
    hosts = durable(hosts.withColumnRenamed("__host", "__of"))
    passed = packed.withColumn("__level", _level_udf()(F.col("__text"))).where("__level < 2")
    return _by_host(passed, hosts).where(_verdict(F.lit(False), F.col("__level") == 1)).select("__row.*")


def _by_host(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows with column __host, left-joined with hosts by __of: broadcast if counted to be few, else for the hot ones."""
    counted = hosts.agg(F.count("*"), F.sum("host_docs")).first()
    if counted[0] <= FEW_HOSTS:
        return rows.join(F.broadcast(hosts), rows["__host"].eqNullSafe(hosts["__of"]), "left")
    hot = hosts.where(F.col("host_docs") * HOT > counted[1])
    cold = hosts.where(F.col("host_docs") * HOT <= counted[1])
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), rows["__host"].eqNullSafe(hot["__of"]), "left")
    there = marked.where("__hot").drop("__hot")
    rest = marked.where("__hot is null").select(*rows.columns)
    return there.unionByName(rest.join(cold, rest["__host"].eqNullSafe(cold["__of"]), "left"))


def failing(text: bytes) -> int:
    """2 if a text fails the rules, 1 if it fails only the stricter limit of watched hosts, else 0."""
    words = text.split()
    if len(words) < MIN_WORDS:
        return 2
    repeated = 100 * repeated_words(words)
    return int(repeated > WATCHED_REPEAT_PERCENT * len(words)) + int(repeated > MAX_REPEAT_PERCENT * len(words))


def _host_failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "__text"):
        yield pa.RecordBatch.from_arrays([batch.column("__host"), pa.array([failing(x) == 2 for x in utf8(batch.column("__text"))], pa.bool_())], ["__host", "base_failed"])


def _level_udf():
    """Said to be nondeterministic, else Spark pushes the filter on it below its projection and judges each text twice, by two Python workers a task."""
    return F.arrow_udf(lambda column: each_part(column, lambda texts: [failing(x) for x in texts], pa.int32()), "int").asNondeterministic()
