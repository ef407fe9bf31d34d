import ast

from hypothesis import given, settings, strategies as st

from quern.functions.parsing import Module, parse_module


def test_records_of_a_module(sample):
    m = Module(sample)
    assert [(i["start_line"], i["end_line"], i["code"]) for i in m.imports] == [(2, 2, "import os"), (3, 5, "from sys import (\n    argv,\n)")]
    assert [c["code"].split("\n")[0] for c in m.top_level_chunks] == ['"""Shelves and what stands on them."""', "LIMIT = 3", "try:", 'if __name__ == "__main__":']
    assert [(f["name"], f["start_line"], f["end_line"]) for f in m.functions] == [("weigh", 15, 16), ("carry", 19, 30)]
    assert [(c["name"], c["docstring"]) for c in m.classes] == [("Tiny", None), ("Shelf", "A shelf.")]
    assert [(x["name"], x["class_name"], x["class_start_line"]) for x in m.methods] == [(n, "Shelf", 37) for n in ("__init__", "load", "load", "text")]


def test_headers_are_in_normal_form(sample):
    m = Module(sample)
    assert m.functions[0]["signature"] == "def weigh(item: str='pot') -> int:"
    assert m.functions[1]["signature"] == "@staticmethod\n@os.fspath\nasync def carry(things, *, twice: bool=False):"
    assert m.classes[1]["signature"] == "@os.fspath\nclass Shelf(dict, metaclass=type):"
    assert m.methods[1]["signature"] == "@property\ndef load(self):"


def test_margin_is_cut_only_where_it_stands(sample):
    assert Module(sample).methods[3]["code"] == 'def text(self):\n    return """\nunder\nover\n"""'


def test_definitions_inside_others():
    m = Module("if 1:\n    def a():\n        class B:\n            def c(self): pass\n        def d(): pass\nclass E:\n    class F:\n        def g(self): pass\n")
    assert [f["name"] for f in m.functions] == ["a"]
    assert [c["name"] for c in m.classes] == ["B", "E", "F"]
    assert [(x["name"], x["class_name"]) for x in m.methods] == [("c", "B"), ("g", "F")]


def test_statements_that_share_a_line_and_wide_letters():
    m = Module("import os; import sys  # both\nx = 'é'; y = 'ü'\n")
    assert [i["code"] for i in m.imports] == ["import os", "import sys"]
    assert [c["code"] for c in m.top_level_chunks] == ["x = 'é'", "y = 'ü'"]


def test_failures_are_told_not_raised():
    assert parse_module("")["ok"] and parse_module("")["functions"] == []
    bad = parse_module("x = 1\ndef (:\n")
    assert not bad["ok"] and bad["error"]["type"] == "SyntaxError" and bad["error"]["line"] == 2
    assert not parse_module("\0")["ok"] and not parse_module(None)["ok"]
    assert not parse_module("(" * 5000 + ")" * 5000)["ok"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["def f():\n    pass\n", "class C:\n    def m(self): return 1\n", "x = 1\n", "import os\n", "# note\n", "\n", "if x:\n    def g(): pass\n"]), max_size=8))
def test_spans_cut_the_code_out_of_the_text(parts):
    text = "".join(parts)
    m = Module(text)
    for d in [*m.functions, *m.classes, *m.methods]:
        assert ast.dump(ast.parse(d["code"]).body[0]).startswith(("FunctionDef", "ClassDef"))
        assert len(d["code"].split("\n")) == d["end_line"] - d["start_line"] + 1
