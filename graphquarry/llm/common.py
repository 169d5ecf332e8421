"""Helpers shared by the operators: words, and what the library has for shared folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard, shared_dir

__all__ = ["WORD_REGEX", "WHITESPACE", "aside", "cut", "discard", "shared_dir", "lower_ascii", "utf8", "held_out"]

#: Java form of a word: a run of characters other than space and U+0009 to U+000D.
WORD_REGEX = "[^ \\t-\\r]+"
WHITESPACE = " \t\n\x0b\x0c\r"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with its own columns of these names out of the way, and what puts df's columns back as they were, with more after them."""
    moved = {c: f"_own_{c}" for c in df.columns if c in names}
    back = [F.col(moved.get(c, c)).alias(c) for c in df.columns]
    return df.withColumnsRenamed(moved), lambda out, *more: out.select(*back, *more)
