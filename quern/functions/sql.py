"""The engine's functions for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.edits import _editor
from .parsing import _parser


def register(spark: SparkSession) -> None:
    """parse_module(text), apply_edit(text, operation, arguments as JSON, file name) and count_tokens(text)."""
    spark.udf.register("parse_module", _parser())
    spark.udf.register("apply_edit", _editor())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION count_tokens(t STRING) RETURNS INT RETURN CAST(FLOOR(LENGTH(t) / 4) + 1 AS INT)")
