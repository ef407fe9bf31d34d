import pytest
from pyspark.sql import functions as F

from quern.operators import queries as Q
from quern.operators.index import tables_from


@pytest.fixture(scope="module")
def tables(spark, sample):
    many = "".join(f"def f{i}():\n    return '{'x' * 60}'\n\n" for i in range(33))
    rows = [("/a/shelf.py", sample), ("/a/empty.py", ""), ("/a/ticks.py", 'def t():\n    """Use ```` here, and a long text that makes the outline dear enough."""\n'), ("/a/many.py", many), ("/a/twice.py", "def f(): pass\ndef f(): return 1\n")]
    return {k: v.cache() for k, v in tables_from(spark.createDataFrame(rows, "file_path string, text string")).items()}


def ask(spark, tables, query, **request):
    return query(tables, spark.createDataFrame([request])).first()["markdown"]


def test_imports_and_chunks(spark, tables):
    assert ask(spark, tables, Q.imports, file_path="/a/shelf.py") == "```python\nimport os\nfrom sys import (\n    argv,\n)\n```"
    assert ask(spark, tables, Q.imports, file_path="/a/empty.py") == "`empty.py` has no module-level imports."
    assert ask(spark, tables, Q.top_level_chunks, file_path="/a/shelf.py").count("\n\n") == 3
    assert ask(spark, tables, Q.top_level_chunks, file_path="/a/empty.py") == "`empty.py` has no other module-level code."
    assert ask(spark, tables, Q.imports, file_path="/a/none.py") == "**Error:** File `/a/none.py` was not found in the index"


def test_classes_take_the_cheaper_form(spark, tables):
    got = ask(spark, tables, Q.classes, file_path="/a/shelf.py")
    assert got.startswith("## Classes in `shelf.py`\n\n### class `Tiny` (lines 33-34) — full source\n```python\nclass Tiny:\n    pass\n```\n\n### class `Shelf` (lines 37-")
    assert got.endswith('class Shelf(dict, metaclass=type):\n    """A shelf."""\n    ...\n```\nMethods: `__init__`, `load`, `text`')
    assert ask(spark, tables, Q.classes, file_path="/a/empty.py") == "`empty.py` has no classes."


def test_functions(spark, tables):
    got = ask(spark, tables, Q.functions, file_path="/a/shelf.py")
    assert "### function `weigh` (lines 15-16)\n```python\ndef weigh(item: str='pot') -> int:\n    ...\n```" in got
    assert '    """Carry things.\n\n    Twice if asked to."""\n    ...' in got
    assert "`````python" in ask(spark, tables, Q.functions, file_path="/a/ticks.py")
    assert ask(spark, tables, Q.functions, file_path="/a/empty.py") == "`empty.py` has no top-level functions."


def test_class_methods(spark, tables):
    got = ask(spark, tables, Q.class_methods, file_path="/a/shelf.py", class_name="Shelf")
    assert got.startswith("## Methods of `Shelf` (lines 37-") and got.count("### method `Shelf.load`") == 2
    assert ask(spark, tables, Q.class_methods, file_path="/a/shelf.py", class_name="Tiny") == "Class `Tiny` (lines 33-34) has no methods."
    assert ask(spark, tables, Q.class_methods, file_path="/a/shelf.py", class_name="No") == "**Error:** Class `No` was not found in `shelf.py`. Classes in this file: `Tiny`, `Shelf`."
    assert ask(spark, tables, Q.class_methods, file_path="/a/empty.py", class_name="No") == "**Error:** Class `No` was not found in `empty.py`. This file has no classes."


def test_code(spark, tables):
    assert ask(spark, tables, Q.function_code, file_path="/a/twice.py", name="f") == "### function `f` (line 1)\n```python\ndef f(): pass\n```\n\n### function `f` (line 2)\n```python\ndef f(): return 1\n```"
    assert ask(spark, tables, Q.class_code, file_path="/a/shelf.py", class_name="Tiny") == "### class `Tiny` (lines 33-34)\n```python\nclass Tiny:\n    pass\n```"
    assert ask(spark, tables, Q.method_code, file_path="/a/shelf.py", class_name="Shelf", name="load").count("### method `Shelf.load`") == 2
    assert ask(spark, tables, Q.method_code, file_path="/a/shelf.py", class_name="Shelf", name="x") == "**Error:** Method `x` was not found in class `Shelf`. Methods of this class: `__init__`, `load`, `text`."
    assert ask(spark, tables, Q.method_code, file_path="/a/shelf.py", class_name="Tiny", name="x").endswith("This class has no methods.")
    missing = ask(spark, tables, Q.function_code, file_path="/a/many.py", name="g")
    assert missing.endswith("`f28`, `f29` (and 3 more).")


def test_filters_reach_the_scan_below_the_parser(spark, tmp_path, sample):
    spark.createDataFrame([("/a/x.py", sample), ("/a/y.py", "")], "file_path string, text string").write.parquet(str(tmp_path / "s"))
    rows = tables_from(spark.read.parquet(str(tmp_path / "s")))["functions"].where("file_path = '/a/x.py'")
    plan = rows._jdf.queryExecution().toString()
    assert "EqualTo(file_path,/a/x.py)" in plan
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("ArrowEvalPython") == 1
    assert rows.count() == 2


def test_functions_in_sql(spark):
    from quern.functions.sql import register

    register(spark)
    row = spark.sql("""SELECT parse_module('def f(): pass').functions[0].name AS name, count_tokens('abcd') AS tokens,
        apply_edit('x = 1\\n', 'replace_text', '{"old_text": "1", "new_text": "2"}', 'm.py').new_text AS text""").first()
    assert (row["name"], row["tokens"], row["text"]) == ("f", 2, "x = 2\n")


def test_nth_definition(spark):
    text = "def a(): pass\n\n\ndef b(): pass\n\n\ndef a(): return 2\n\n\nclass b: pass\n"
    t = tables_from(spark.createDataFrame([("/m.py", text), ("/n.py", "def a(): pass\n")], "file_path string, text string"))
    asked = [("/m.py", "a", 1), ("/m.py", "a", 2), ("/m.py", "a", 3), ("/m.py", "a", None), ("/m.py", "c", None), ("/n.py", "a", None), ("/n.py", "a", 0)]
    rows = Q.nth(t["functions"], spark.createDataFrame(asked, "file_path string, name string, occurrence int")).collect()
    got = {(r["file_path"], r["name"], r["occurrence"]): (r["status"], r["definition"] and r["definition"]["start_line"]) for r in rows}
    assert got == dict(zip(asked, [("found", 1), ("found", 7), ("beyond", None), ("ambiguous", None), ("missing", None), ("found", 1), ("beyond", None)]))
    both = Q.occurrences(Q.union_of_definitions(t)).where("file_path = '/m.py' and name = 'b'").collect()
    assert sorted((r["kind"], r["occurrence"], r["times"]) for r in both) == [("class", 2, 2), ("function", 1, 2)]


@pytest.mark.parametrize("query", ["imports_markdown", "top_level_markdown", "classes_markdown", "functions_markdown", "class_methods_markdown", "expand_function", "expand_class", "expand_method"])
def test_reads_parse_once(spark, query):
    from quern.plans import registry

    plan = registry.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan  # parsed before, into what the tables share


def test_count_tokens_with_and_without_a_tokenizer(spark):
    import public_tokenizers

    from quern.functions.tokens import count_tokens

    df = spark.createDataFrame([("hello world, hello",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(count_tokens(F.col("t"))).collect()] == [5, None, 1]
    assert [r[0] for r in df.select(count_tokens(F.col("t"), "no such encoding")).collect()] == [5, None, 1]
    assert [r[0] for r in df.select(count_tokens(F.col("t"), public_tokenizers.path("byte_bpe_50k.json"))).collect()] == [4, None, 0]
