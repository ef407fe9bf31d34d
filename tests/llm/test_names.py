"""Keys of any name: those that the operators use inside or return, and names with dots."""

import pytest
from pyspark.sql import functions as F

from quern.llm import gif_media, html_extract, jaccard_join, lm_scoring, packing, piece_codec, quality_rules, token_counts, toxicity, url_filter
from quern.llm.common import named

NAMES = ["doc_id", "length", "__row", "rank", "n_tokens", "__text", "ids", "start", "score", "__host", "a.b", "media", "text_"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six seven eight nine ten eleven", None, "", "short"]
    row = lambda i, t: [F.lit(f"{n}-{i}").alias(n) for n in NAMES] + [F.lit(t).cast("string").alias("text"), F.lit(f"h{i % 2}").alias("source")]
    out = spark.range(1).select(*row(0, texts[0]))
    for i, t in enumerate(texts[1:], 1):
        out = out.unionByName(spark.range(1).select(*row(i, t)))
    return out


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: packing.pack(d, NAMES),
        lambda d: packing.pack(d, NAMES, keep_ids=False),
        lambda d: token_counts.token_counts(d, NAMES),
        lambda d: piece_codec.encode(d, NAMES),
        lambda d: gif_media.store(d, [n for n in NAMES if n != "media"]),
        lambda d: gif_media.frames(gif_media.store(d, [n for n in NAMES if n != "media"])),
        lambda d: gif_media.digests(gif_media.store(d, [n for n in NAMES if n != "media"])),
        lambda d: piece_codec.decode(piece_codec.encode(d, [n for n in NAMES if n != "ids"])),
        lambda d: quality_rules.judged(d, NAMES),
        lambda d: html_extract.extract(d, NAMES, "text"),
        lambda d: toxicity.scored(d, toxicity.FactorizationMachine.fit([], __import__("numpy").zeros(0)), NAMES),
    ],
)
def test_clashing_and_dotted_keys(docs, apply):
    out = apply(docs)
    rows = out.collect()
    assert len(rows) == 4 and len(set(out.columns)) == len(out.columns)
    for n in NAMES:
        # Left out above: the two that are then a column read back by name.
        assert sorted(map(str, (r[n] for r in rows))) == [f"{n}-{i}" for i in range(4)] or n in ("media", "ids")


@pytest.mark.parametrize("key", ["a.b", "score", "__id", "block"])
def test_one_key_of_any_name(docs, key):
    own = docs.withColumnRenamed("rank", "__id").withColumnRenamed("start", "block")
    for out in (jaccard_join.components_of(own, key), lm_scoring.score(own, F.lit(False), key, order=2), url_filter.filter_urls(own, url_filter.rule_table(own.sparkSession), key, "text")):
        assert out.columns[0] == key and out.count() == 4


def test_a_made_column_gives_way_to_a_key(spark):
    out = named(spark.range(1).selectExpr("1 as __key0", "2 as length", "3 as length_"), ["Length"])
    assert out.columns == ["Length", "length_", "length__"] and tuple(out.first()) == (1, 2, 3)
