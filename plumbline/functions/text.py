"""Tokens and normalised texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\p{Z}\t-\r\x1c-\x1f\x85"
# the word-punctuation tokenizer: a run of letters, digits and underscores, or of other non-space characters
TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]+"


def token_count(text: Column) -> Column:
    """Number of tokens; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def squeeze(text: Column) -> Column:
    """Lower case, white space runs made one blank, trimmed."""
    low = F.lower(text)
    uneven = text.rlike(rf"[{SPACE}&&[^ ]]|  ")  # most texts have single blanks only
    return F.btrim(F.when(uneven, F.regexp_replace(low, rf"[{SPACE}]+", " ")).otherwise(low))


def source_key(source: Column) -> Column:
    """A source name without surrounding blanks, in lower case."""
    return F.lower(F.btrim(source))
