"""From the text of a module to records: the one part that needs Python on the executors."""

from __future__ import annotations

import ast
import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from ..schemas import PARSED

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
DEFINITIONS = (*FUNCTIONS, ast.ClassDef)
IMPORTS = (ast.Import, ast.ImportFrom)


def first_line(node: ast.stmt) -> int:
    """Where a definition begins, decorators included."""
    marks = getattr(node, "decorator_list", ())
    return min((node.lineno, *(m.lineno for m in marks)))


def header(node: ast.stmt) -> str:
    """Decorators and the def or class line, in normal form, without the body."""
    stub = type(node)(**{**dict(ast.iter_fields(node)), "body": [ast.Pass()]})
    ast.copy_location(stub, node)
    text = ast.unparse(stub)
    return text[: text.rindex("\n")]


def cut_margin(lines: list[str]) -> str:
    """The lines without the first one's indentation; those that don't have it stay as they are."""
    margin = lines[0][: -len(lines[0].lstrip())] if lines[0].strip() else lines[0]
    return "\n".join(x.removeprefix(margin) for x in lines)


@dataclass
class Module:
    """A parsed text and the records that the index keeps of it, in source order."""

    text: str
    tree: ast.Module = field(init=False)
    lines: list[str] = field(init=False)
    imports: list[dict] = field(default_factory=list)
    top_level_chunks: list[dict] = field(default_factory=list)
    classes: list[dict] = field(default_factory=list)
    functions: list[dict] = field(default_factory=list)
    methods: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.tree = ast.parse(self.text)
        self.lines = self.text.split("\n")
        raw = None
        for stmt in self.tree.body:
            if isinstance(stmt, DEFINITIONS):
                continue
            raw = raw or [x.encode() for x in self.lines]
            kind = self.imports if isinstance(stmt, IMPORTS) else self.top_level_chunks
            kind.append({"ord": len(kind), "start_line": stmt.lineno, "end_line": stmt.end_lineno, "code": _segment(raw, stmt)})
        self._collect()

    def _collect(self) -> None:
        """Definitions before what is inside them. Each carries the nearest definition around it.

        A function is top-level if no definition is around it, a method if a class is; others are part of
        the function that they stand in.
        """
        todo: list[tuple[ast.AST, dict | str | None]] = [(self.tree, None)]
        while todo:
            node, around = todo.pop()
            if isinstance(node, DEFINITIONS):
                is_class = isinstance(node, ast.ClassDef)
                if is_class or around is None:
                    rows = self.classes if is_class else self.functions
                    record = self._record(node, len(rows))
                    rows.append(record)
                elif isinstance(around, dict):
                    record = self._record(node, len(self.methods))
                    self.methods.append(record | {"class_name": around["name"], "class_start_line": around["start_line"]})
                around = record if is_class else "function"
            todo.extend((child, around) for child in reversed([*ast.iter_child_nodes(node)]))

    def _record(self, node: ast.stmt, ord_: int) -> dict:
        start, end = first_line(node), node.end_lineno
        return {
            "ord": ord_,
            "name": node.name,
            "signature": header(node),
            "docstring": ast.get_docstring(node),
            "start_line": start,
            "end_line": end,
            "code": cut_margin(self.lines[start - 1 : end]),
        }


def _segment(raw: list[bytes], stmt: ast.stmt) -> str:
    """The statement's exact text; columns count UTF-8 bytes."""
    part = raw[stmt.lineno - 1 : stmt.end_lineno]
    part[-1] = part[-1][: stmt.end_col_offset]
    part[0] = part[0][stmt.col_offset :]
    return b"\n".join(part).decode()


def parse_module(text: str | None) -> dict:
    """A value of `schemas.PARSED`. What can't be parsed gives ok = false and the reason, never an exception."""
    empty = {"imports": [], "top_level_chunks": [], "classes": [], "functions": [], "methods": []}
    if text is None:
        return {"ok": False, "error": {"type": "UnicodeDecodeError", "line": None, "msg": "not valid UTF-8"}, **empty}
    try:
        m = Module(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return {"ok": False, "error": {"type": type(e).__name__, "line": getattr(e, "lineno", None), "msg": getattr(e, "msg", None) or str(e)}, **empty}
    return {"ok": True, "error": None, **{k: getattr(m, k) for k in empty}}


@functools.cache
def _parser():
    return F.udf(parse_module, PARSED, useArrow=True)


def parsed(text: Column) -> Column:
    """The parser as a scalar function, so that filters on other columns pass below it."""
    return _parser()(text)


def normal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
