"""Text measures of commands, user names and file paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# (?U) makes \s match all Unicode white space; x1c-x1f are white space in Python but not in Java.
SPECIAL_CHAR = r"(?U)[^a-zA-Z0-9\s\x1c-\x1f]"


def special_char_ratio(text: Column) -> Column:
    """Share of characters that are neither ASCII letters, digits nor white space; 0 for empty or null."""
    length = F.nullif(F.char_length(text), F.lit(0))
    return F.coalesce(F.regexp_count(text, F.lit(SPECIAL_CHAR)) / length, F.lit(0.0))


def path_depth(path: Column) -> Column:
    """Number of parts between slashes; 1 without a slash or for null."""
    return F.size(F.split(F.coalesce(path, F.lit("None")), "/"))


def file_extension(path: Column) -> Column:
    """What follows the last dot of the whole path, else ``no_extension``."""
    return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise("no_extension")
