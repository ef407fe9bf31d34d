"""URL filters: host-suffix and path-prefix expressions, equi-joined on short hash prefixes.

Each url is expanded into the expressions that a rule could have: its host's last k labels with
the first m characters of its path, for the shapes (k, m) that occur among the rules. Rules are grouped by four bytes of
their digest, as a number, and expressions meet them on that alone; the full digest confirms a rule in the group; the longest rule wins, and of
equal ones the blocking one.

All of it is DataFrame work. Rules are counted: up to `FEW_RULES` are broadcast and joined once a shape, so
urls aren't shuffled at all. More rules are joined to the exploded expressions of all shapes at once; there, equal rows are counted
before and laid out again after, so a url that holds a third of all rows is judged once, and skewed prefixes are split by adaptive joins.

A null url, or one without `://`, has an empty host and path, and no rule fits it; a rule without `/`
has no path and fits every path; null rules are passed over; repeated rows stay repeated; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import keyed, lower_ascii, named

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEFAULT = "allow"
#: Hexadecimal digits of the digest that the join is on.
PREFIX = 8
#: Rules up to which they are broadcast: a few MB.
FEW_RULES = 20_000


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _prepared(rules: DataFrame) -> DataFrame:
    slash = F.locate("/", F.col("rule"))
    host = lower_ascii(F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")))
    path = F.when(slash > 0, F.expr("substring(rule, locate('/', rule))")).otherwise(F.lit(""))
    known = rules.where("rule is not null and action is not null").select("rule", "action", host.alias("__h"), path.alias("__p"))
    best = F.max_by("action", F.when(F.col("action") == "block", 1).otherwise(0))
    known = known.groupBy("rule", "__h", "__p").agg(best.alias("action"))
    digest = _digest(F.col("__h"), F.col("__p"))
    return known.select("rule", "action", _labels(F.col("__h")).alias("k"), F.length("__p").alias("m"), digest.alias("digest"))


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX), 16, 10).cast("long")


def _best(rules: Column, digest: Column) -> Column:
    """The rule of a group that the digest confirms and that goes first, as a struct; null if none."""
    fits = F.filter(rules, lambda r: r["digest"] == digest)
    order = F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("length"), F.when(r["action"] == "block", 1).otherwise(0).alias("blocks"), r["rule"].alias("rule"), r["action"].alias("action")))
    return F.array_max(order)


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """`key`, host, path, rule, verdict for each row of `pages`; rules: columns action and rule."""
    known = _prepared(rules)
    # As many as there are pairs of a rule's number of labels and length of path, not as many as rules.
    counted = known.groupBy("k", "m").agg(F.count("*").alias("n")).collect()
    shapes = sorted((r["k"], r["m"]) for r in counted)
    groups = known.groupBy(_prefix(F.col("digest")).alias("rule_prefix")).agg(F.collect_set(F.struct("digest", "rule", "action")).alias("group"))
    rows = keyed(pages, [key], __url=F.col(f"`{url}`").cast("string"))
    few = sum(r["n"] for r in counted) <= FEW_RULES
    if not few:
        rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    rows = rows.withColumns({"host": url_host(F.col("__url")), "path": url_path(F.col("__url"))})
    expressions = [
        F.when(
            (_labels(F.col("host")) >= k) & (F.length("path") >= m) & (F.locate("://", F.col("__url")) > 0),
            _digest(F.substring_index("host", ".", -k), F.substring("path", 1, m) if m else F.lit("")),
        )
        for k, m in shapes
    ]
    if few:
        found = []
        for i, digest in enumerate(expressions):
            own = F.broadcast(groups.select(F.col("rule_prefix").alias(f"__p{i}"), F.col("group").alias(f"__g{i}")))
            rows = rows.withColumn(f"__e{i}", digest)
            rows = rows.join(own, _prefix(F.col(f"__e{i}")) == F.col(f"__p{i}"), "left").withColumn(f"__b{i}", _best(F.col(f"__g{i}"), F.col(f"__e{i}"))).drop(f"__p{i}", f"__g{i}", f"__e{i}")
            found.append(F.col(f"__b{i}"))
        none = F.lit(None).cast("struct<length:int,blocks:int,rule:string,action:string>")
        judged = rows.withColumn("__best", F.greatest(*found, none) if found else none)
    else:
        wide = rows.withColumn("__e", F.explode_outer(F.array_compact(F.array(*expressions)))).withColumn("__prefix", _prefix(F.col("__e")))
        met = wide.join(groups, F.col("__prefix") == F.col("rule_prefix"), "left").withColumn("__best", _best(F.col("group"), F.col("__e")))
        judged = met.groupBy("__key0", "__url").agg(*[F.first(c).alias(c) for c in ("__n", "host", "path")], F.max("__best").alias("__best"))
        judged = judged.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return named(judged.select("__key0", "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.action", F.lit(default)).alias("verdict")), [key])
