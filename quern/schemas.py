"""Schemas of the parser's result and of the index tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: Version of the table layout; an index of another version is dropped and built again.
SCHEMA_VERSION = 2

_SPAN = "ord int, start_line int, end_line int, code string"
_DEFINITION = "ord int, name string, signature string, docstring string, start_line int, end_line int, code string"
_METHOD = f"{_DEFINITION}, class_name string, class_start_line int"


def _array(fields: str) -> str:
    return "array<struct<" + ", ".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">>"


PARSED = (
    "struct<ok:boolean, error:struct<type:string,line:int,msg:string>, "
    f"imports:{_array(_SPAN)}, top_level_chunks:{_array(_SPAN)}, classes:{_array(_DEFINITION)}, "
    f"functions:{_array(_DEFINITION)}, methods:{_array(_METHOD)}>"
)

#: Index tables in the order in which they are written. Owners of methods are known by name and first line.
TABLES: dict[str, str] = {
    "files": "file_path string, content_hash string",
    "imports": f"file_path string, {_SPAN}",
    "top_level_chunks": f"file_path string, {_SPAN}",
    "classes": f"file_path string, {_DEFINITION}",
    "functions": f"file_path string, {_DEFINITION}",
    "methods": f"file_path string, {_METHOD}",
}
CHILD_TABLES = tuple(t for t in TABLES if t != "files")


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
