"""Markdown from index rows, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Names that are listed before the rest is only counted.
NAME_LIMIT = 30


def token_estimate(text: Column) -> Column:
    return (F.floor(F.length(text) / 4) + 1).cast("int")


def fence(code: Column, language: str = "python") -> Column:
    """A code block whose fence is longer than any run of backticks in the code."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`+)"), F.lit(1)), F.length)
    ticks = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(ticks, F.lit(language + "\n"), code, F.lit("\n"), ticks)


def line_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("line "), start.cast("string"))).otherwise(F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string")))


def name_list(names: Column, limit: int = NAME_LIMIT) -> Column:
    """Distinct names in order, quoted; those beyond the limit are counted."""
    unique = F.array_distinct(names)
    shown = F.array_join(F.transform(F.slice(unique, 1, limit), lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")
    more = F.size(unique) - limit
    return F.when(more > 0, F.concat(shown, F.lit(" (and "), more.cast("string"), F.lit(" more)"))).otherwise(shown)


def heading(kind: str, label: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit(f"### {kind} `"), label, F.lit("` ("), line_label(start, end), F.lit(")"))


def indented(text: Column, margin: str = "    ") -> Column:
    """Lines that hold more than white space get the margin."""
    lines = F.split(text, "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"(?U)\S"), F.concat(F.lit(margin), x)).otherwise(x)), "\n")


def outline(signature: Column, docstring: Column) -> Column:
    """Header and docstring, the body elided."""
    quoted = F.when(F.length(docstring) > 0, indented(F.concat(F.lit('"""'), docstring, F.lit('"""'))))
    return F.concat_ws("\n", signature, quoted, F.lit("    ..."))


def cheaper(head: Column, short: Column, code: Column) -> Column:
    """The outline if it is estimated to cost fewer tokens than the source, else the source, marked as such."""
    full = fence(code)
    return F.when(token_estimate(short) < token_estimate(full), F.concat(head, F.lit("\n"), short)).otherwise(F.concat(head, F.lit(" — full source\n"), full))


def code_item(head: Column, code: Column) -> Column:
    return F.concat(head, F.lit("\n"), fence(code))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def error(message: Column) -> Column:
    return F.concat(F.lit("**Error:** "), message)


def in_order(rows: Column, sep: str) -> Column:
    """Joins collected structs (start_line, ord, ..., text) by position."""
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["text"]), sep)
