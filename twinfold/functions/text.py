"""Text expressions, all inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
GAP = r"[^\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Longest runs of letters and digits of the lower-cased text; null for null, [] for a wordless text."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def bare(c: Column) -> Column:
    """The words joined without anything between; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), GAP, "")


def strip_punctuation(c: Column) -> Column:
    return F.translate(c, string.punctuation, "")


def split_spaces(c: Column) -> Column:
    """Split at every single space: empty tokens stay, '' gives ['']."""
    return F.split(c, " ", -1)


def tokens(c: Column) -> Column:
    """Split at runs of white space; null and blank give []."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def clean_tokens(c: Column) -> Column:
    """Lower case, ASCII punctuation deleted, split at white space."""
    return tokens(strip_punctuation(F.lower(c)))
