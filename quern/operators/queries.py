"""The read queries, over all requested files at once.

Each takes the index tables and a table of requests and returns the requests with their Markdown. Joins
are on the file, so they use the tables' bucketing by file; what is gathered for one row is
one file's definitions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rendering as R

Index = Mapping[str, DataFrame]


def _found(index: Index, requests: DataFrame) -> DataFrame:
    known = index["files"].select("file_path", F.lit(True).alias("__known"))
    return requests.join(known, "file_path", "left")


def _missing(path: Column) -> Column:
    return R.error(F.concat(F.lit("File `"), path, F.lit("` was not found in the index")))


def _answer(rows: DataFrame, requests: DataFrame, text: Column) -> DataFrame:
    path = F.col("file_path")
    return rows.select(*requests.columns, F.when(F.col("__known").isNull(), _missing(path)).otherwise(text).alias("markdown"))


def _per_file(table: DataFrame, text: Column, sep: str, name: str = "__text") -> DataFrame:
    row = F.struct("start_line", "ord", text.alias("text"))
    return table.groupBy("file_path").agg(R.in_order(F.collect_list(row), sep).alias(name))


def _names(table: DataFrame, keys: list[str], name: str) -> DataFrame:
    row = F.struct("start_line", "ord", F.col("name").alias("text"))
    return table.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["text"]).alias(name))


def imports(index: Index, requests: DataFrame) -> DataFrame:
    """The import statements of module level, in one block."""
    joined = _found(index, requests).join(_per_file(index["imports"], F.col("code"), "\n"), "file_path", "left")
    none = F.concat(F.lit("`"), R.base_name(F.col("file_path")), F.lit("` has no module-level imports."))
    return _answer(joined, requests, F.when(F.col("__text").isNull(), none).otherwise(R.fence(F.col("__text"))))


def top_level_chunks(index: Index, requests: DataFrame) -> DataFrame:
    """Other code of module level, in one block."""
    joined = _found(index, requests).join(_per_file(index["top_level_chunks"], F.col("code"), "\n\n"), "file_path", "left")
    none = F.concat(F.lit("`"), R.base_name(F.col("file_path")), F.lit("` has no other module-level code."))
    return _answer(joined, requests, F.when(F.col("__text").isNull(), none).otherwise(R.fence(F.col("__text"))))


def method_names(index: Index) -> DataFrame:
    """Each class's method names in order, on the owner's name and first line."""
    owner = ["file_path", F.col("class_name").alias("__owner"), F.col("class_start_line").alias("__owner_line")]
    row = index["methods"].select(*owner, "start_line", "ord", "name")
    return _names(row, ["file_path", "__owner", "__owner_line"], "method_names")


def _with_methods(index: Index) -> DataFrame:
    names = method_names(index).withColumnsRenamed({"__owner": "name", "__owner_line": "start_line"})
    return index["classes"].join(names, ["file_path", "name", "start_line"], "left")


def class_items(index: Index) -> DataFrame:
    """Each class as an item: outline with method names, or full source."""
    rows = _with_methods(index)
    listed = F.when(F.size("method_names") > 0, F.concat(F.lit("\nMethods: "), R.name_list(F.col("method_names")))).otherwise("")
    short = F.concat(R.fence(R.outline(F.col("signature"), F.col("docstring"))), listed)
    head = R.heading("class", F.col("name"), F.col("start_line"), F.col("end_line"))
    return rows.withColumn("item", R.cheaper(head, short, F.col("code")))


def _items(table: DataFrame, kind: str, label: Column) -> Column:
    head = R.heading(kind, label, F.col("start_line"), F.col("end_line"))
    return R.cheaper(head, R.fence(R.outline(F.col("signature"), F.col("docstring"))), F.col("code"))


def classes(index: Index, requests: DataFrame) -> DataFrame:
    joined = _found(index, requests).join(_per_file(class_items(index), F.col("item"), "\n\n"), "file_path", "left")
    base = R.base_name(F.col("file_path"))
    none = F.concat(F.lit("`"), base, F.lit("` has no classes."))
    some = F.concat(F.lit("## Classes in `"), base, F.lit("`\n\n"), F.col("__text"))
    return _answer(joined, requests, F.when(F.col("__text").isNull(), none).otherwise(some))


def functions(index: Index, requests: DataFrame) -> DataFrame:
    rows = index["functions"].withColumn("item", _items(index["functions"], "function", F.col("name")))
    joined = _found(index, requests).join(_per_file(rows, F.col("item"), "\n\n"), "file_path", "left")
    base = R.base_name(F.col("file_path"))
    none = F.concat(F.lit("`"), base, F.lit("` has no top-level functions."))
    some = F.concat(F.lit("## Functions in `"), base, F.lit("`\n\n"), F.col("__text"))
    return _answer(joined, requests, F.when(F.col("__text").isNull(), none).otherwise(some))


def _no_class(available: Column, name: Column) -> Column:
    hint = F.when(F.size(available) > 0, F.concat(F.lit(" Classes in this file: "), R.name_list(available), F.lit("."))).otherwise(" This file has no classes.")
    return R.error(F.concat(F.lit("Class `"), name, F.lit("` was not found in `"), R.base_name(F.col("file_path")), F.lit("`."), hint))


def _owned(index: Index, requests: DataFrame) -> DataFrame:
    """Requests with the classes of the requested name, `__c` null where there is none."""
    c = index["classes"].select("file_path", F.col("name").alias("class_name"), F.struct("start_line", "end_line", "ord", "code", "name").alias("__c"))
    return _found(index, requests).join(c, ["file_path", "class_name"], "left")


def _class_names(index: Index) -> DataFrame:
    return _names(index["classes"], ["file_path"], "__available")


def class_methods(index: Index, requests: DataFrame) -> DataFrame:
    """Methods of every class of the requested name. Requests: file_path, class_name."""
    m = index["methods"]
    label = F.concat(F.col("class_name"), F.lit("."), F.col("name"))
    own = m.withColumn("item", _items(m, "method", label)).groupBy("file_path", "class_name", F.col("class_start_line").alias("__line"))
    own = own.agg(R.in_order(F.collect_list(F.struct("start_line", "ord", F.col("item").alias("text"))), "\n\n").alias("__items"))
    rows = _owned(index, requests).withColumn("__line", F.col("__c.start_line")).join(own, ["file_path", "class_name", "__line"], "left")
    where = R.line_label(F.col("__c.start_line"), F.col("__c.end_line"))
    none = F.concat(F.lit("Class `"), F.col("class_name"), F.lit("` ("), where, F.lit(") has no methods."))
    some = F.concat(F.lit("## Methods of `"), F.col("class_name"), F.lit("` ("), where, F.lit(")\n\n"), F.col("__items"))
    part = F.when(F.col("__c").isNotNull(), F.when(F.col("__items").isNull(), none).otherwise(some))
    text = R.in_order(F.collect_list(F.when(part.isNotNull(), F.struct(F.col("__c.start_line"), F.col("__c.ord"), part.alias("text")))), "\n\n")
    grouped = rows.groupBy(*requests.columns).agg(F.max("__known").alias("__known"), text.alias("__text"), F.count("__c").alias("__n"))
    joined = grouped.join(_class_names(index), "file_path", "left")
    return _answer(joined, requests, F.when(F.col("__n") == 0, _no_class(F.col("__available"), F.col("class_name"))).otherwise(F.col("__text")))


def function_code(index: Index, requests: DataFrame) -> DataFrame:
    """Source of all functions of the requested name. Requests: file_path, name."""
    f = index["functions"]
    item = R.code_item(R.heading("function", F.col("name"), F.col("start_line"), F.col("end_line")), F.col("code"))
    own = f.groupBy("file_path", "name").agg(R.in_order(F.collect_list(F.struct("start_line", "ord", item.alias("text"))), "\n\n").alias("__text"))
    joined = _found(index, requests).join(own, ["file_path", "name"], "left").join(_names(f, ["file_path"], "__available"), "file_path", "left")
    hint = F.when(F.size("__available") > 0, F.concat(F.lit(" Functions in this file: "), R.name_list(F.col("__available")), F.lit("."))).otherwise(" This file has no top-level functions.")
    none = R.error(F.concat(F.lit("Function `"), F.col("name"), F.lit("` was not found in `"), R.base_name(F.col("file_path")), F.lit("`."), hint))
    return _answer(joined, requests, F.coalesce("__text", none))


def class_code(index: Index, requests: DataFrame) -> DataFrame:
    """Source of all classes of the requested name. Requests: file_path, class_name."""
    item = R.code_item(R.heading("class", F.col("name"), F.col("start_line"), F.col("end_line")), F.col("code"))
    own = index["classes"].groupBy("file_path", F.col("name").alias("class_name")).agg(R.in_order(F.collect_list(F.struct("start_line", "ord", item.alias("text"))), "\n\n").alias("__text"))
    joined = _found(index, requests).join(own, ["file_path", "class_name"], "left").join(_class_names(index), "file_path", "left")
    return _answer(joined, requests, F.coalesce("__text", _no_class(F.col("__available"), F.col("class_name"))))


def method_code(index: Index, requests: DataFrame) -> DataFrame:
    """Source of all methods of the requested name in the classes of the requested name.

    Requests: file_path, class_name, name.
    """
    label = F.concat(F.col("class_name"), F.lit("."), F.col("name"))
    item = R.code_item(R.heading("method", label, F.col("start_line"), F.col("end_line")), F.col("code"))
    row = F.struct("class_start_line", "start_line", "ord", item.alias("text"))
    own = index["methods"].groupBy("file_path", "class_name", "name").agg(R.in_order(F.collect_list(row), "\n\n").alias("__text"))
    order = F.struct("class_start_line", "start_line", "ord", F.col("name").alias("text"))
    known = index["methods"].groupBy("file_path", "class_name").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]).alias("__methods"))
    there = index["classes"].groupBy("file_path", F.col("name").alias("class_name")).agg(F.count("*").alias("__n"))
    joined = _found(index, requests).join(own, ["file_path", "class_name", "name"], "left").join(known, ["file_path", "class_name"], "left").join(there, ["file_path", "class_name"], "left")
    joined = joined.join(_class_names(index), "file_path", "left")
    hint = F.when(F.size("__methods") > 0, F.concat(F.lit(" Methods of this class: "), R.name_list(F.col("__methods")), F.lit("."))).otherwise(" This class has no methods.")
    none = R.error(F.concat(F.lit("Method `"), F.col("name"), F.lit("` was not found in class `"), F.col("class_name"), F.lit("`."), hint))
    return _answer(joined, requests, F.when(F.col("__n").isNull(), _no_class(F.col("__available"), F.col("class_name"))).otherwise(F.coalesce("__text", none)))


def union_of_definitions(index: Index) -> DataFrame:
    """Functions, then classes, each tagged with its kind."""
    columns = ["file_path", "name", "start_line", "end_line", "ord"]
    first = index["functions"].select(*columns, F.lit("function").alias("kind"), F.lit(0).alias("kind_rank"))
    return first.unionByName(index["classes"].select(*columns, F.lit("class").alias("kind"), F.lit(1).alias("kind_rank")))


def occurrences(defs: DataFrame) -> DataFrame:
    """Definitions with `times`, how many of their file (and class) have their name, and `occurrence`, which of these each is, from 1.

    For functions, classes and methods alike, and for their union, where functions come first.
    """
    keys = [c for c in ("file_path", "class_name", "class_start_line", "name") if c in defs.columns]
    order = [c for c in ("kind_rank", "start_line", "ord") if c in defs.columns]
    same = Window.partitionBy(*keys)
    return defs.withColumns({"occurrence": F.row_number().over(same.orderBy(*order)).cast("long"), "times": F.count("*").over(same)})


def nth(defs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (file_path, name, occurrence, and class_name for methods) with the definition that they mean.

    Without an occurrence a name must be there once. `status` is found, missing, ambiguous or beyond; but for found the definition is null.
    """
    keys = [c for c in ("file_path", "class_name", "name") if c in requests.columns]
    rows = occurrences(defs)
    there = rows.groupBy(*keys).agg(F.max("times").alias("times"))
    asked = requests.join(there, keys, "left").withColumn("__at", F.coalesce(F.col("occurrence").cast("long"), F.when(F.col("times") == 1, F.lit(1).cast("long"))))
    own = rows.select(*keys, F.col("occurrence").alias("__at"), F.struct(*[c for c in defs.columns if c not in keys]).alias("definition"))
    joined = asked.join(own, [*keys, "__at"], "left")
    status = F.when(F.col("times").isNull(), "missing").when(F.col("__at").isNull(), "ambiguous").when(F.col("definition").isNull(), "beyond").otherwise("found")
    return joined.select(*requests.columns, status.alias("status"), "times", "definition")
