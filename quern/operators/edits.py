"""Bulk edits as a table operation: sources joined with edits, new texts as rows; nothing is written here."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.editing import apply_edit

RESULT = "struct<status:string,new_text:string,message:string>"


def _edited(text: str, operation: str, arguments: str, file_name: str) -> dict:
    if text is None:
        return {"status": "refused", "new_text": None, "message": f"**Error:** `{file_name}` could not be read."}
    return apply_edit(text, operation, json.loads(arguments), file_name)


@functools.cache
def _editor():
    return F.udf(_edited, RESULT, useArrow=True)


def edited(text: Column, operation: Column, arguments: Column, file_name: Column) -> Column:
    """status, new_text and message; `arguments` is a JSON object."""
    return _editor()(text, operation, arguments, file_name)


def bulk_edit(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (file_path, operation, arguments as JSON) on sources (file_path, text), one for each file.

    A file that several edits name is refused for all of them, as their order would be open; a file that isn't
    among the sources is refused as not existing.
    """
    times = edits.groupBy("file_path").agg(F.count("*").alias("__n"))
    joined = edits.join(times, "file_path").join(sources.select("file_path", "text", F.lit(True).alias("__there")), "file_path", "left")
    none = F.struct(F.lit("refused").alias("status"), F.lit(None).cast("string").alias("new_text"), F.concat(F.lit("**Error:** `"), F.col("file_path"), F.lit("` is not an existing Python (.py) file.")).alias("message"))
    twice = F.struct(F.lit("refused").alias("status"), F.lit(None).cast("string").alias("new_text"), F.lit("**Error:** Several edits name this file. Nothing was written.").alias("message"))
    result = F.when(F.col("__there").isNull(), none).when(F.col("__n") > 1, twice).otherwise(edited(F.col("text"), F.col("operation"), F.col("arguments"), F.col("file_path")))
    return joined.select("file_path", "operation", result.alias("r")).select("file_path", "operation", "r.*")


def replace_text(text: Column, old: Column, new: Column) -> Column:
    """The text replacement natively: status, new_text, n_matches, line. Needs no parser."""
    n = F.when(F.length(old) > 0, ((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("int")).otherwise(0)
    before = F.call_function("substring_index", text, old, F.lit(1))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    status = F.when(n != 1, "refused").when(old == new, "unchanged").otherwise("changed")
    return F.struct(status.alias("status"), F.when(status == "changed", F.replace(text, old, new)).alias("new_text"), n.alias("n_matches"), F.when(n == 1, line).alias("line"))
