"""Numbers of tokens of texts: the estimate, or a tokenizer's own count where one is asked for and there."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rendering import token_estimate


def _encoding(name: str):
    """The tokenizer of this name, or of this file (.json); None where the library or the file isn't there."""
    try:
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            found = Tokenizer.from_file(name)
            return lambda text: len(found.encode(text, add_special_tokens=False))
        import tiktoken

        found = tiktoken.get_encoding(name)
        return lambda text: len(found.encode(text, disallowed_special=()))
    except Exception:  # whatever the library says when it has no such vocabulary
        return None


def count_tokens(text: Column, encoding: str | None = None) -> Column:
    """Tokens of each text by the named encoding; without one, or where it can't be loaded, the estimate. Null stays null."""
    if encoding is None or _encoding(encoding) is None:
        return token_estimate(text)
    loaded: list = []

    @F.arrow_udf("int")
    def count(column):
        import pyarrow as pa

        if not loaded:
            loaded.append(_encoding(encoding))
        return pa.array([None if x is None else loaded[0](x) for x in column.to_pylist()], pa.int32())

    return count(text)
