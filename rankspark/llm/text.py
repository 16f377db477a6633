"""Column expressions on document texts shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of every contract: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(name: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Plain ASCII takes the fast built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_space(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def count_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text: each word with the space behind it shrinks to one character."""
    return F.length(F.regexp_replace(strip_space(text), f"[^{SPACE}]+[{SPACE}]*", "x")).cast("long")


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
