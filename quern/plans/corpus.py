"""Modules made from the driver's tables, so that SQL can predict what the engine finds in them.

documents: one function each, the text as its docstring. conversations: one class each, a method named by role for
each turn. parts: one module for each brand, with imports, constants, a tiny class, a function for each part and
a main guard. All are built from `file_path` and `text`, with native expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

Q = '"""'


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines: 1 import, 4 def, 5 docstring, 6.. text, then its end and the return. The closing
    quotes stand at the margin, so that the cleaned docstring is the text."""
    d = _table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    text = F.concat(F.lit("import os\n\n\ndef doc_"), name, F.lit(f"(limit: int = 10) -> str:\n    r{Q}\n"), F.coalesce("text", F.lit("")), F.lit(f"\n{Q}\n    return 'x'\n"))
    return d.select(F.concat(F.lit("/corpus/docs/"), name, F.lit(".py")).alias("file_path"), text.alias("text"), "doc_id")


def conversation_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class header, then six lines and the text's for each turn, in order."""
    c = _table(spark, sf_dir, "conversations")
    method = F.concat(F.lit("    def "), F.col("role"), F.lit(f"(self):\n        r{Q}\n"), F.col("text"), F.lit(f"\n{Q}\n        return 0\n"))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", method.alias("m")))).alias("t"))
    body = F.array_join(F.transform("t", lambda x: x["m"]), "\n")
    name = F.col("conv_id").cast("string")
    return turns.select(F.concat(F.lit("/corpus/conv/"), name, F.lit(".py")).alias("file_path"), F.concat(F.lit("class Conv"), name, F.lit(":\n"), body).alias("text"), "conv_id")


def brand_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two imports, a constant, a tiny class; functions of three lines and two blank ones in order of p_partkey; a guard."""
    p = _table(spark, sf_dir, "part")
    function = F.concat(F.lit("def p_"), F.col("p_partkey").cast("string"), F.lit(f"():\n    {Q}"), F.col("p_name"), F.lit(f"{Q}\n    return "), F.col("p_size").cast("string"), F.lit("\n\n\n"))
    parts = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", function.alias("f")))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["f"]), "")
    brand = F.regexp_extract("p_brand", "[0-9]+", 0)
    head = F.concat(F.lit("import os\nfrom sys import (\n    argv,\n)\nBRAND = '"), F.col("p_brand"), F.lit("'\n\n\nclass Tiny:\n    pass\n\n\n"))
    text = F.concat(head, body, F.lit('if __name__ == "__main__":\n    print(BRAND)\n'))
    return parts.select(F.concat(F.lit("/corpus/brand/"), brand, F.lit(".py")).alias("file_path"), text.alias("text"), "p_brand")
