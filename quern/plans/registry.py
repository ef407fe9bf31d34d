"""The registered queries on modules made from the driver's tables, and the SQL that predicts them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rendering as R
from ..functions.parsing import content_hash, normal_newlines, parsed
from ..operators import edits, queries as Q
from ..operators.index import Index, tables_from
from ..operators.staging import shared_folder
from . import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _lines(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("int")


_DOC = "'/corpus/docs/' || doc_id || '.py'"
_NL = "(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))"
_MODULE = "'import os' || chr(10) || chr(10) || chr(10) || 'def doc_' || doc_id || '(limit: int = 10) -> str:' || chr(10) || '    r\"\"\"' || chr(10) || coalesce(text, '') || chr(10) || '\"\"\"' || chr(10) || '    return ''x''' || chr(10)"
_FUNCTION = _MODULE.replace("'import os' || chr(10) || chr(10) || chr(10) || ", "").removesuffix(" || chr(10)")
_TURNS = f"""turns AS (SELECT conv_id, turn, role, text, {_NL} AS nl,
  2 + coalesce(sum({_NL} + 6) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM conversations)"""
_METHOD = "'def ' || role || '(self):' || chr(10) || '    r\"\"\"' || chr(10) || regexp_replace(chr(10) || text, chr(10) || '    ', chr(10), 'g') || chr(10) || '\"\"\"' || chr(10) || '    return 0'"
_PARTS = "parts AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n, '/corpus/brand/' || regexp_extract(p_brand, '[0-9]+') || '.py' AS file_path FROM part)"


def docs(spark, sf_dir, staged=False):
    return tables_from(corpus.doc_modules(spark, sf_dir), staged)


def conversations(spark, sf_dir, staged=False):
    return tables_from(corpus.conversation_modules(spark, sf_dir), staged)


def brands(spark, sf_dir, staged=False):
    return tables_from(corpus.brand_modules(spark, sf_dir), staged)


# Hashes and records


@_query(f"SELECT {_DOC} AS file_path, sha256({_MODULE}) AS content_hash FROM documents")
def source_hash(spark, sf_dir):
    return docs(spark, sf_dir)["files"]


@_query(f"SELECT {_DOC} AS file_path, sha256({_MODULE}) AS content_hash FROM documents")
def newline_normalized_hash(spark, sf_dir):
    m = corpus.doc_modules(spark, sf_dir)
    windows = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return m.select("file_path", content_hash(normal_newlines(windows)).alias("content_hash"))


@_query(f"SELECT {_DOC} AS file_path, true AS unparsed, 'SyntaxError' AS error_type, 1 AS line FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT {_DOC}, false, NULL, NULL FROM documents WHERE doc_id % 2 <> 0")
def parse_errors(spark, sf_dir):
    m = corpus.doc_modules(spark, sf_dir)
    broken = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("def (:\n"), F.col("text"))).otherwise(F.col("text"))
    rows = m.select("file_path", parsed(broken).alias("p"))
    return rows.select("file_path", (~F.col("p.ok")).alias("unparsed"), F.col("p.error.type").alias("error_type"), F.col("p.error.line").alias("line"))


@_query(
    f"SELECT {_DOC} AS file_path, 'doc_' || doc_id AS name, 'def doc_' || doc_id || '(limit: int=10) -> str:' AS signature, sha256(coalesce(text, '')) AS doc_hash, 4 AS start_line, CAST(8 + {_NL} AS INTEGER) AS end_line, sha256({_FUNCTION}) AS code_hash FROM documents"
)
def functions_extract(spark, sf_dir):
    f = docs(spark, sf_dir)["functions"]
    return f.select("file_path", "name", "signature", _sha(F.col("docstring")).alias("doc_hash"), "start_line", "end_line", _sha(F.col("code")).alias("code_hash"))


@_query(f"WITH {_PARTS} SELECT file_path, 'p_' || p_partkey AS name, 'def p_' || p_partkey || '():' AS signature, p_name AS docstring, CAST(12 + 5 * (k - 1) AS INTEGER) AS start_line, CAST(14 + 5 * (k - 1) AS INTEGER) AS end_line FROM parts")
def functions_in_order(spark, sf_dir):
    return brands(spark, sf_dir)["functions"].select("file_path", "name", "signature", "docstring", "start_line", "end_line")


@_query("SELECT '/corpus/brand/' || regexp_extract(p_brand, '[0-9]+') || '.py' AS file_path, count(*) AS functions FROM part GROUP BY p_brand")
def functions_count_by_file(spark, sf_dir):
    return brands(spark, sf_dir)["functions"].groupBy("file_path").agg(F.count("*").alias("functions"))


@_query(
    """WITH b AS (SELECT DISTINCT '/corpus/brand/' || regexp_extract(p_brand, '[0-9]+') || '.py' AS file_path FROM part)
SELECT file_path, 0 AS ord, 1 AS start_line, 1 AS end_line, 'import os' AS code FROM b UNION ALL
SELECT file_path, 1, 2, 4, 'from sys import (' || chr(10) || '    argv,' || chr(10) || ')' FROM b"""
)
def imports_extract(spark, sf_dir):
    return brands(spark, sf_dir)["imports"]


@_query(
    """WITH b AS (SELECT p_brand, '/corpus/brand/' || regexp_extract(p_brand, '[0-9]+') || '.py' AS file_path, count(*) AS n FROM part GROUP BY p_brand)
SELECT file_path, 0 AS ord, 5 AS start_line, 5 AS end_line, 'BRAND = ''' || p_brand || '''' AS code FROM b UNION ALL
SELECT file_path, 1, CAST(12 + 5 * n AS INTEGER), CAST(13 + 5 * n AS INTEGER), 'if __name__ == "__main__":' || chr(10) || '    print(BRAND)' FROM b"""
)
def top_level_extract(spark, sf_dir):
    return brands(spark, sf_dir)["top_level_chunks"]


@_query(
    f"WITH {_TURNS} SELECT '/corpus/conv/' || conv_id || '.py' AS file_path, 'Conv' || conv_id AS name, 'class Conv' || conv_id || ':' AS signature, 1 AS start_line, CAST(max(first + nl + 4) AS INTEGER) AS end_line FROM turns GROUP BY conv_id"
)
def classes_extract(spark, sf_dir):
    return conversations(spark, sf_dir)["classes"].select("file_path", "name", "signature", "start_line", "end_line")


@_query(
    f"WITH {_TURNS} SELECT '/corpus/conv/' || conv_id || '.py' AS file_path, role AS name, 'def ' || role || '(self):' AS signature, sha256(text) AS doc_hash, CAST(first AS INTEGER) AS start_line, CAST(first + nl + 4 AS INTEGER) AS end_line, 'Conv' || conv_id AS class_name, 1 AS class_start_line FROM turns"
)
def methods_extract(spark, sf_dir):
    m = conversations(spark, sf_dir)["methods"]
    return m.select("file_path", "name", "signature", _sha(F.col("docstring")).alias("doc_hash"), "start_line", "end_line", "class_name", "class_start_line")


@_query(f"WITH {_TURNS} SELECT 'Conv' || conv_id AS class_name, role AS name, CAST(first AS INTEGER) AS start_line FROM turns")
def class_method_join(spark, sf_dir):
    t = conversations(spark, sf_dir, True)
    owner = t["classes"].select("file_path", F.col("name").alias("class_name"), F.col("start_line").alias("class_start_line"))
    return t["methods"].join(owner, ["file_path", "class_name", "class_start_line"]).select("class_name", "name", "start_line")


@_query("SELECT 'Conv' || conv_id AS class_name, string_agg(role, ',' ORDER BY turn) AS names FROM conversations GROUP BY conv_id")
def method_names_ordered(spark, sf_dir):
    n = Q.method_names(conversations(spark, sf_dir))
    return n.select(F.col("__owner").alias("class_name"), F.array_join("method_names", ",").alias("names"))


@_query(
    """WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role)
SELECT 'Conv' || conv_id AS class_name, string_agg('`' || role || '`', ', ' ORDER BY t) AS names FROM f GROUP BY conv_id"""
)
def method_names_distinct(spark, sf_dir):
    n = Q.method_names(conversations(spark, sf_dir))
    return n.select(F.col("__owner").alias("class_name"), R.name_list(F.col("method_names")).alias("names"))


@_query(
    f"""WITH {_PARTS} SELECT file_path, string_agg('`p_' || p_partkey || '`', ', ' ORDER BY k) || CASE WHEN max(n) > 30 THEN ' (and ' || (max(n) - 30) || ' more)' ELSE '' END AS names
FROM parts WHERE k <= 30 GROUP BY file_path"""
)
def function_names_capped(spark, sf_dir):
    f = brands(spark, sf_dir)["functions"]
    names = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "ord", "name"))), lambda x: x["name"])
    return f.groupBy("file_path").agg(R.name_list(names).alias("names"))


@_query(f"WITH {_TURNS} SELECT '/corpus/conv/' || conv_id || '.py' AS file_path, CAST(first AS INTEGER) AS start_line, sha256({_METHOD.replace('regexp_replace(chr(10) || text', 'substr(regexp_replace(chr(10) || text').replace(chr(39) + 'g' + chr(39) + ')', chr(39) + 'g' + chr(39) + '), 2)')}) AS code_hash FROM turns")
def definition_dedent(spark, sf_dir):
    return conversations(spark, sf_dir)["methods"].select("file_path", "start_line", _sha(F.col("code")).alias("code_hash"))


# Rendering


@_query("SELECT doc_id, CAST(length(coalesce(text, '')) // 4 + 1 AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", R.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


_TICKED = "coalesce(text, '') || repeat('`', CAST(doc_id % 6 AS INTEGER)) || 'x``'"
_TICKS = "greatest(3, greatest(CAST(doc_id % 6 AS INTEGER), 2) + 1)"


@_query(f"SELECT doc_id, sha256(repeat('`', {_TICKS}) || 'python' || chr(10) || {_TICKED} || chr(10) || repeat('`', {_TICKS})) AS block_hash FROM documents")
def fence_render(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    code = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), F.lit("x``"))
    return d.select("doc_id", _sha(R.fence(code)).alias("block_hash"))


@_query(f"SELECT {_DOC} AS file_path, '### function `doc_' || doc_id || '` (lines 4-' || (8 + {_NL}) || ')' AS heading FROM documents")
def heading_render(spark, sf_dir):
    f = docs(spark, sf_dir)["functions"]
    return f.select("file_path", R.heading("function", F.col("name"), F.col("start_line"), F.col("end_line")).alias("heading"))


@_query(f"SELECT {_DOC} AS file_path, CASE WHEN {_NL} < 0 THEN '' ELSE 'lines 4-' || (8 + {_NL}) END AS span, 'line 1' AS first FROM documents")
def line_label(spark, sf_dir):
    t = docs(spark, sf_dir, True)
    i = t["imports"].select("file_path", R.line_label(F.col("start_line"), F.col("end_line")).alias("first"))
    return t["functions"].select("file_path", R.line_label(F.col("start_line"), F.col("end_line")).alias("span")).join(i, "file_path")


# The eight read queries


def _paths(t: dict[str, DataFrame]) -> DataFrame:
    return t["files"].select("file_path")


_B = "'`' || regexp_extract(p_brand, '[0-9]+') || '.py`'"
_FENCE = "'```python' || chr(10) || {} || chr(10) || '```'"
_BRANDS = "WITH b AS (SELECT p_brand, '/corpus/brand/' || regexp_extract(p_brand, '[0-9]+') || '.py' AS file_path FROM part GROUP BY p_brand)"


@_query(f"{_BRANDS} SELECT file_path, {_FENCE.format(chr(39) + 'import os' + chr(39) + ' || chr(10) || ' + chr(39) + 'from sys import (' + chr(39) + ' || chr(10) || ' + chr(39) + '    argv,' + chr(39) + ' || chr(10) || ' + chr(39) + ')' + chr(39))} AS markdown FROM b")
def imports_markdown(spark, sf_dir):
    t = brands(spark, sf_dir, True)
    return Q.imports(t, _paths(t))


@_query("SELECT '/corpus/conv/' || conv_id || '.py' AS file_path, '`' || conv_id || '.py` has no module-level imports.' AS markdown FROM conversations GROUP BY conv_id")
def imports_none(spark, sf_dir):
    t = conversations(spark, sf_dir, True)
    return Q.imports(t, _paths(t))


_CHUNKS = "'BRAND = ''' || p_brand || '''' || chr(10) || chr(10) || 'if __name__ == \"__main__\":' || chr(10) || '    print(BRAND)'"


@_query(f"{_BRANDS} SELECT file_path, {_FENCE.format(_CHUNKS)} AS markdown FROM b")
def top_level_markdown(spark, sf_dir):
    t = brands(spark, sf_dir, True)
    return Q.top_level_chunks(t, _paths(t))


@_query(f"{_BRANDS} SELECT file_path, '## Classes in ' || {_B} || chr(10) || chr(10) || '### class `Tiny` (lines 8-9) — full source' || chr(10) || {_FENCE.format(chr(39) + 'class Tiny:' + chr(39) + ' || chr(10) || ' + chr(39) + '    pass' + chr(39))} AS markdown FROM b")
def classes_markdown(spark, sf_dir):
    t = brands(spark, sf_dir, True)
    return Q.classes(t, _paths(t))


_DOC_CODE = _FENCE.format(_FUNCTION)
_INDENTED = "substr(regexp_replace(chr(10) || '\"\"\"' || coalesce(text, '') || '\"\"\"', chr(10) || '([^' || chr(10) || ']*[^ ' || chr(9) || chr(10) || '])', chr(10) || '    \\1', 'g'), 2)"
_SHORT = _FENCE.format(f"'def doc_' || doc_id || '(limit: int=10) -> str:' || chr(10) || CASE WHEN coalesce(text, '') = '' THEN '' ELSE {_INDENTED} || chr(10) END || '    ...'")


@_query(
    f"""WITH r AS (SELECT doc_id, '### function `doc_' || doc_id || '` (lines 4-' || (8 + {_NL}) || ')' AS h, {_SHORT} AS o, {_DOC_CODE} AS c FROM documents)
SELECT '/corpus/docs/' || doc_id || '.py' AS file_path, sha256('## Functions in `' || doc_id || '.py`' || chr(10) || chr(10) || CASE WHEN length(o) // 4 < length(c) // 4 THEN h || chr(10) || o ELSE h || ' — full source' || chr(10) || c END) AS markdown_hash FROM r"""
)
def functions_markdown(spark, sf_dir):
    t = docs(spark, sf_dir, True)
    return Q.functions(t, _paths(t)).select("file_path", _sha(F.col("markdown")).alias("markdown_hash"))


@_query(f"SELECT {_DOC} AS file_path, CAST(CASE WHEN length({_SHORT}) // 4 < length({_DOC_CODE}) // 4 THEN 1 ELSE 0 END AS INTEGER) AS outlined FROM documents")
def outline_or_full(spark, sf_dir):
    t = docs(spark, sf_dir, True)
    return Q.functions(t, _paths(t)).select("file_path", F.when(F.contains("markdown", F.lit(" — full source\n")), 0).otherwise(1).alias("outlined"))


@_query(f"SELECT {_DOC} AS file_path, 'doc_' || doc_id AS name, sha256('### function `doc_' || doc_id || '` (lines 4-' || (8 + {_NL}) || ')' || chr(10) || {_DOC_CODE}) AS markdown_hash FROM documents")
def expand_function(spark, sf_dir):
    t = docs(spark, sf_dir, True)
    return Q.function_code(t, t["functions"].select("file_path", "name")).select("file_path", "name", _sha(F.col("markdown")).alias("markdown_hash"))


@_query(f"SELECT {_DOC} AS file_path, '**Error:** Function `nope` was not found in `' || doc_id || '.py`. Functions in this file: `doc_' || doc_id || '`.' AS markdown FROM documents")
def not_found_function(spark, sf_dir):
    t = docs(spark, sf_dir, True)
    return Q.function_code(t, _paths(t).withColumn("name", F.lit("nope"))).select("file_path", "markdown")


@_query(f"SELECT {_DOC} AS file_path, '**Error:** Class `Nope` was not found in `' || doc_id || '.py`. This file has no classes.' AS markdown FROM documents")
def not_found_class(spark, sf_dir):
    t = docs(spark, sf_dir, True)
    return Q.class_code(t, _paths(t).withColumn("class_name", F.lit("Nope"))).select("file_path", "markdown")


@_query(
    """WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role)
SELECT '/corpus/conv/' || conv_id || '.py' AS file_path, '**Error:** Method `nope` was not found in class `Conv' || conv_id || '`. Methods of this class: ' || string_agg('`' || role || '`', ', ' ORDER BY t) || '.' AS markdown FROM f GROUP BY conv_id"""
)
def not_found_method(spark, sf_dir):
    t = conversations(spark, sf_dir, True)
    asked = t["classes"].select("file_path", F.col("name").alias("class_name"), F.lit("nope").alias("name"))
    return Q.method_code(t, asked).select("file_path", "markdown")


@_query("SELECT doc_id, '**Error:** File `/none/' || doc_id || '.py` was not found in the index' AS markdown FROM documents")
def not_found_file(spark, sf_dir):
    t = docs(spark, sf_dir, True)
    asked = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("/none/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"))
    return Q.imports(t, asked).select("doc_id", "markdown")


#: A method's code without its margin, and as it stands in the module.
_OWN = _METHOD.replace("regexp_replace(chr(10) || text", "substr(regexp_replace(chr(10) || text").replace("'g')", "'g'), 2)")
_RAW = "'    def ' || role || '(self):' || chr(10) || '        r\"\"\"' || chr(10) || text || chr(10) || '\"\"\"' || chr(10) || '        return 0'"
_SPAN = "'(lines ' || CAST(first AS INTEGER) || '-' || CAST(first + nl + 4 AS INTEGER) || ')'"
_CONV = "'/corpus/conv/' || conv_id || '.py'"


@_query(
    f"""WITH {_TURNS}, m AS (SELECT conv_id, role, first, '### method `Conv' || conv_id || '.' || role || '` ' || {_SPAN} || chr(10) || {_FENCE.format(_OWN)} AS item FROM turns)
SELECT {_CONV} AS file_path, role AS name, sha256(string_agg(item, chr(10) || chr(10) ORDER BY first)) AS markdown_hash FROM m GROUP BY conv_id, role"""
)
def expand_method(spark, sf_dir):
    t = conversations(spark, sf_dir, True)
    asked = t["methods"].select("file_path", "class_name", "name").distinct()
    return Q.method_code(t, asked).select("file_path", "name", _sha(F.col("markdown")).alias("markdown_hash"))


_CLASS_TEXT = f"'class Conv' || conv_id || ':' || chr(10) || string_agg({_RAW}, chr(10) || chr(10) ORDER BY turn)"


@_query(
    f"""WITH {_TURNS}, c AS (SELECT conv_id, CAST(max(first + nl + 4) AS INTEGER) AS last, {_CLASS_TEXT} AS code FROM turns GROUP BY conv_id)
SELECT {_CONV} AS file_path, 'Conv' || conv_id AS class_name, sha256('### class `Conv' || conv_id || '` (lines 1-' || last || ')' || chr(10) || {_FENCE.format("code")}) AS markdown_hash FROM c"""
)
def expand_class(spark, sf_dir):
    t = conversations(spark, sf_dir, True)
    asked = t["classes"].select("file_path", F.col("name").alias("class_name"))
    return Q.class_code(t, asked).select("file_path", "class_name", _sha(F.col("markdown")).alias("markdown_hash"))


_METHOD_SHORT = _SHORT.replace("'def doc_' || doc_id || '(limit: int=10) -> str:'", "'def ' || role || '(self):'")


@_query(
    f"""WITH {_TURNS}, r AS (SELECT *, '### method `Conv' || conv_id || '.' || role || '` ' || {_SPAN} AS h, {_METHOD_SHORT} AS o, {_FENCE.format(_OWN)} AS c FROM turns),
m AS (SELECT *, CASE WHEN length(o) // 4 < length(c) // 4 THEN h || chr(10) || o ELSE h || ' — full source' || chr(10) || c END AS item FROM r)
SELECT {_CONV} AS file_path, 'Conv' || conv_id AS class_name,
  sha256('## Methods of `Conv' || conv_id || '` (lines 1-' || CAST(max(first + nl + 4) AS INTEGER) || ')' || chr(10) || chr(10) || string_agg(item, chr(10) || chr(10) ORDER BY first)) AS markdown_hash
FROM m GROUP BY conv_id"""
)
def class_methods_markdown(spark, sf_dir):
    t = conversations(spark, sf_dir, True)
    asked = t["classes"].select("file_path", F.col("name").alias("class_name"))
    return Q.class_methods(t, asked).select("file_path", "class_name", _sha(F.col("markdown")).alias("markdown_hash"))


@_query(f"{_BRANDS} SELECT file_path, 'Class `Tiny` (lines 8-9) has no methods.' AS markdown FROM b")
def class_methods_none(spark, sf_dir):
    t = brands(spark, sf_dir, True)
    return Q.class_methods(t, _paths(t).withColumn("class_name", F.lit("Tiny"))).select("file_path", "markdown")


# Ranking and unions


@_query(
    f"""WITH {_TURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS occurrence, count(*) OVER (PARTITION BY conv_id, role) AS times FROM turns)
SELECT '/corpus/conv/' || conv_id || '.py' AS file_path, role AS name, occurrence, times, CAST(first AS INTEGER) AS start_line FROM k"""
)
def pick_nth(spark, sf_dir):
    rows = Q.occurrences(conversations(spark, sf_dir)["methods"])
    return rows.select("file_path", "name", "occurrence", "times", "start_line")


@_query(
    f"""WITH {_TURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM turns)
SELECT conv_id, role, '**Error:** Method `' || role || '` in class `Conv' || conv_id || '` is defined ' || count(*) || ' times (' || string_agg(i || ': lines ' || CAST(first AS INTEGER) || '-' || CAST(first + nl + 4 AS INTEGER), ', ' ORDER BY i) || '). Pass `occurrence` to choose which one. Nothing was written.' AS message
FROM k GROUP BY conv_id, role HAVING count(*) > 1"""
)
def pick_ambiguous(spark, sf_dir):
    m = corpus.conversation_modules(spark, sf_dir)
    roles = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id", "role").agg(F.count("*").alias("n")).where("n > 1")
    args = F.to_json(F.struct(F.concat(F.lit("Conv"), F.col("conv_id").cast("string")).alias("cls_name"), F.col("role").alias("method_name"), F.lit("def f(self):\n    pass").alias("new_code")))
    return m.join(roles, "conv_id").select("conv_id", "role", edits.edited(F.col("text"), F.lit("replace_method"), args, F.col("file_path"))["message"].alias("message"))


@_query(
    f"""WITH {_PARTS} SELECT file_path, 'p_' || p_partkey AS name, 'function' AS kind FROM parts UNION ALL SELECT DISTINCT file_path, 'Tiny', 'class' FROM parts"""
)
def union_defs(spark, sf_dir):
    return Q.union_of_definitions(brands(spark, sf_dir, True)).select("file_path", "name", "kind")


# Incremental maintenance


def _index(spark: SparkSession) -> Index:
    return Index(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}", 8)


def _next_version(m: DataFrame) -> DataFrame:
    """Every fifth module gets another function name, the one after it a syntax error."""
    renamed = F.replace(F.col("text"), F.lit("def doc_"), F.lit("def new_"))
    broken = F.concat(F.lit("def (:\n"), F.col("text"))
    text = F.when(F.col("doc_id") % 5 == 0, renamed).when(F.col("doc_id") % 5 == 1, broken).otherwise(F.col("text"))
    return m.withColumn("text", text)


@_query(f"SELECT {_DOC} AS file_path, doc_id % 5 = 0 AS changed, CASE WHEN doc_id % 5 = 1 THEN 'SyntaxError' END AS error_type FROM documents")
def incremental_changed(spark, sf_dir):
    index, m = _index(spark), corpus.doc_modules(spark, sf_dir)
    index.refresh(m)
    got = index.refresh(_next_version(m))
    return got.select("file_path", "changed", F.col("error.type").alias("error_type"))


@_query(f"SELECT {_DOC} AS file_path, CASE WHEN doc_id % 5 = 0 THEN 'new_' ELSE 'doc_' END || doc_id AS name, 4 AS start_line FROM documents")
def broken_file_keeps_rows(spark, sf_dir):
    index, m = _index(spark), corpus.doc_modules(spark, sf_dir)
    index.refresh(m)
    index.refresh(_next_version(m))
    return index.tables()["functions"].select("file_path", "name", "start_line")


@_query(f"SELECT {_DOC} AS file_path, false AS changed FROM documents")
def refresh_unchanged(spark, sf_dir):
    index, m = _index(spark), corpus.doc_modules(spark, sf_dir)
    index.refresh(m)
    return index.refresh(m).select("file_path", "changed")


# Edits


@_query(
    f"""WITH n AS (SELECT *, 1 + CAST((length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'import os', ''))) // 9 AS INTEGER) AS n_matches FROM documents)
SELECT doc_id, n_matches, CASE WHEN n_matches = 1 THEN 'changed' ELSE 'refused' END AS status, CASE WHEN n_matches = 1 THEN sha256(replace({_MODULE}, 'import os', 'import sys')) END AS text_hash, CASE WHEN n_matches = 1 THEN 1 END AS line FROM n"""
)
def replace_text(spark, sf_dir):
    m = corpus.doc_modules(spark, sf_dir)
    r = m.select("doc_id", edits.replace_text(F.col("text"), F.lit("import os"), F.lit("import sys")).alias("r"))
    return r.select("doc_id", "r.n_matches", "r.status", _sha(F.col("r.new_text")).alias("text_hash"), "r.line")


@_query("SELECT doc_id, CAST((length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'th', ''))) // 2 AS INTEGER) AS n_matches FROM documents")
def replace_text_ambiguous(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", edits.replace_text(F.coalesce("text", F.lit("")), F.lit("th"), F.lit("ht"))["n_matches"].alias("n_matches"))


def _edit(m: DataFrame, key: str, operation: str, **arguments) -> DataFrame:
    args = F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in arguments.items()]))
    r = m.select(key, edits.edited(F.col("text"), F.lit(operation), args, F.col("file_path")).alias("r"))
    return r.select(key, "r.status", _sha(F.col("r.new_text")).alias("text_hash"), "r.message")


_HEAD = "'import os' || chr(10) || chr(10) || chr(10)"


def _name() -> Column:
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))


@_query(
    f"SELECT doc_id, 'changed' AS status, sha256({_HEAD} || 'def f():' || chr(10) || '    return 1' || chr(10)) AS text_hash, 'Replaced function `doc_' || doc_id || '` (was lines 4-' || (8 + {_NL}) || ', now lines 4-5) in `' || doc_id || '.py`. The file was re-indexed.' AS message FROM documents"
)
def replace_function(spark, sf_dir):
    return _edit(corpus.doc_modules(spark, sf_dir), "doc_id", "replace_function", function_name=_name(), new_code="def f():\n    return 1")


@_query(
    f"""WITH {_TURNS}, e AS (SELECT conv_id, max(first + nl + 4) AS last FROM turns GROUP BY conv_id)
SELECT conv_id, 'changed' AS status, sha256('class C:' || chr(10) || '    x = 1' || chr(10)) AS text_hash, 'Replaced class `Conv' || conv_id || '` (was lines 1-' || CAST(last AS INTEGER) || ', now lines 1-2) in `' || conv_id || '.py`. The file was re-indexed.' AS message FROM e"""
)
def replace_class(spark, sf_dir):
    name = F.concat(F.lit("Conv"), F.col("conv_id").cast("string"))
    return _edit(corpus.conversation_modules(spark, sf_dir), "conv_id", "replace_class", cls_name=name, new_code="class C:\n    x = 1")


@_query(
    f"SELECT doc_id, 'changed' AS status, sha256({_MODULE} || chr(10) || chr(10) || 'def g():' || chr(10) || '    return 2' || chr(10)) AS text_hash, 'Added function `g` (lines ' || (11 + {_NL}) || '-' || (12 + {_NL}) || ') in `' || doc_id || '.py`. The file was re-indexed.' AS message FROM documents"
)
def add_function(spark, sf_dir):
    return _edit(corpus.doc_modules(spark, sf_dir), "doc_id", "add_function", new_code="def g():\n    return 2")


@_query(
    f"SELECT doc_id, 'changed' AS status, sha256({_MODULE} || chr(10) || chr(10) || 'class K:' || chr(10) || '    x = 1' || chr(10)) AS text_hash, 'Added class `K` (lines ' || (11 + {_NL}) || '-' || (12 + {_NL}) || ') in `' || doc_id || '.py`. The file was re-indexed.' AS message FROM documents"
)
def add_class(spark, sf_dir):
    return _edit(corpus.doc_modules(spark, sf_dir), "doc_id", "add_class", new_code="class K:\n    x = 1")


@_query(
    f"SELECT doc_id, 'changed' AS status, sha256('import os' || chr(10) || 'import sys' || substr({_MODULE}, 10)) AS text_hash, 'Added 1 import statement(s) (lines 2-2) in `' || doc_id || '.py`. The file was re-indexed.' AS message FROM documents"
)
def add_imports(spark, sf_dir):
    return _edit(corpus.doc_modules(spark, sf_dir), "doc_id", "add_imports", imports="import os\nimport sys")


@_query("SELECT doc_id, 'unchanged' AS status, CAST(NULL AS VARCHAR) AS text_hash, 'All of these imports are already present; `' || doc_id || '.py` was left unchanged.' AS message FROM documents")
def add_imports_present(spark, sf_dir):
    return _edit(corpus.doc_modules(spark, sf_dir), "doc_id", "add_imports", imports="import os")


@_query(f"SELECT doc_id, 'changed' AS status, sha256('import os' || chr(10)) AS text_hash, 'Deleted function `doc_' || doc_id || '` (was lines 4-' || (8 + {_NL}) || ') in `' || doc_id || '.py`. The file was re-indexed.' AS message FROM documents")
def delete_definition(spark, sf_dir):
    return _edit(corpus.doc_modules(spark, sf_dir), "doc_id", "delete_definition", name=_name())


#: A brand's module up to its tiny class, that class, its functions and its guard.
_BRAND = "'import os' || chr(10) || 'from sys import (' || chr(10) || '    argv,' || chr(10) || ')' || chr(10) || 'BRAND = ' || chr(39) || p_brand || chr(39) || chr(10) || chr(10) || chr(10)"
_TINY = "'class Tiny:' || chr(10) || '    pass' || chr(10)"
_DEFS = "string_agg('def p_' || p_partkey || '():' || chr(10) || '    \"\"\"' || p_name || '\"\"\"' || chr(10) || '    return ' || p_size || chr(10) || chr(10) || chr(10), '' ORDER BY p_partkey)"
_GUARD = "'if __name__ == \"__main__\":' || chr(10) || '    print(BRAND)' || chr(10)"
_BRAND_TEXT = f"WITH b AS (SELECT p_brand, count(*) AS n, {_DEFS} AS defs FROM part GROUP BY p_brand)"
_IN_BRAND = "in `' || regexp_extract(p_brand, '[0-9]+') || '.py`. The file was re-indexed.'"


@_query(
    f"""{_BRAND_TEXT} SELECT p_brand, 'changed' AS status, sha256({_BRAND} || {_TINY} || chr(10) || '    def m(self):' || chr(10) || '        pass' || chr(10) || chr(10) || chr(10) || defs || {_GUARD}) AS text_hash,
'Added method `m` to class `Tiny` (lines 11-12) {_IN_BRAND} AS message FROM b"""
)
def add_method(spark, sf_dir):
    return _edit(corpus.brand_modules(spark, sf_dir), "p_brand", "add_method", cls_name="Tiny", new_code="def m(self):\n    pass")


@_query(
    f"""{_BRAND_TEXT} SELECT p_brand, 'changed' AS status, sha256({_BRAND} || {_TINY} || chr(10) || chr(10) || defs || 'def g():' || chr(10) || '    pass' || chr(10) || chr(10) || chr(10) || {_GUARD}) AS text_hash,
'Added function `g` (lines ' || (10 + 5 * n + 2) || '-' || (10 + 5 * n + 3) || ') {_IN_BRAND} AS message FROM b"""
)
def main_guard_anchor(spark, sf_dir):
    return _edit(corpus.brand_modules(spark, sf_dir), "p_brand", "add_function", new_code="def g():\n    pass")


@_query(f"""{_BRAND_TEXT} SELECT p_brand, 'changed' AS status, sha256({_BRAND} || defs || {_GUARD}) AS text_hash, 'Deleted class `Tiny` (was lines 8-9) {_IN_BRAND} AS message FROM b""")
def delete_before_sibling(spark, sf_dir):
    return _edit(corpus.brand_modules(spark, sf_dir), "p_brand", "delete_definition", name="Tiny")


@_query(
    f"""WITH {_TURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS occurrence FROM turns),
e AS (SELECT a.conv_id, a.role AS name, a.occurrence, a.first, a.nl, b.turn, CASE WHEN a.turn = b.turn THEN '    def other(self):' || chr(10) || '        return 1' ELSE {_RAW.replace("|| role ||", "|| b.role ||").replace("|| text ||", "|| b.text ||")} END AS code
FROM k a JOIN turns b ON a.conv_id = b.conv_id)
SELECT conv_id, name, occurrence, 'changed' AS status, sha256('class Conv' || conv_id || ':' || chr(10) || string_agg(code, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS text_hash,
'Replaced method `Conv' || conv_id || '.' || name || '` (was lines ' || CAST(first AS INTEGER) || '-' || CAST(first + nl + 4 AS INTEGER) || ', now lines ' || CAST(first AS INTEGER) || '-' || CAST(first + 1 AS INTEGER) || ') in `' || conv_id || '.py`. The file was re-indexed.' AS message
FROM e GROUP BY conv_id, name, occurrence, first, nl"""
)
def replace_method(spark, sf_dir):
    """Each method of each class, by its name and which of that name it is."""
    m = corpus.conversation_modules(spark, sf_dir)
    asked = Q.occurrences(tables_from(m)["methods"]).select("file_path", "class_name", "name", "occurrence")
    args = F.to_json(F.struct(F.col("class_name").alias("cls_name"), F.col("name").alias("method_name"), F.lit("def other(self):\n    return 1").alias("new_code"), "occurrence"))
    r = m.join(asked, "file_path").select("conv_id", "name", "occurrence", edits.edited(F.col("text"), F.lit("replace_method"), args, F.col("file_path")).alias("r"))
    return r.select("conv_id", "name", "occurrence", "r.status", _sha(F.col("r.new_text")).alias("text_hash"), "r.message")
