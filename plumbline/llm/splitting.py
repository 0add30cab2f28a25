"""Cutting long texts at natural boundaries.

A text is read as a string of classes, one character for each token: what boundary, if any, follows it. On
that string one regular expression takes piece after piece: its alternatives, in order of boundary strength,
consume up to the limit with bounded quantifiers and give back characters until they stand at a paragraph, a
line or a sentence end; then any boundary, then a single token. The quantifiers range over single characters,
which the matcher counts in a loop, so neither the limit nor the length of a text deepens its stack. Pieces
are slices of the array of tokens; overlap is looked back up from where a piece begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import SPACE, WORD

_OTHER = rf"[^{WORD}{SPACE}]++"
_INLINE = rf"[ {SPACE}&&[^\n]]"
_UNIT = rf"(?:\A[{SPACE}]*+)?(?:[{WORD}]++|{_OTHER})[{SPACE}]*+"
# (pattern, replacement), one after the other: o a token, s one before a sentence end, each with the blanks
# after it; then no blanks are left but those at the start of the text or of a line
_CLASSES = [
    (rf"(?:[{WORD}]++|{_OTHER}(?:(?<![.!?…])|(?![{SPACE}]))){_INLINE}*+", "o"),
    (rf"[^o{SPACE}]++{_INLINE}*+", "s"),
    (rf"{_INLINE}++", ""),
]
# p a paragraph end, l a line end
_LINES = [("o\n\n", "p"), ("s\n\n", "p"), ("o\n", "l"), ("s\n", "l"), ("\n", "")]


def boundary_classes(text: Column) -> Column:
    """One character for each token of ``text``: p, l or s where a paragraph, line or sentence ends after it, else o."""
    for pattern, replacement in _CLASSES:
        text = F.regexp_replace(text, pattern, replacement)
    for written, kind in _LINES:
        text = F.replace(text, F.lit(written), F.lit(kind))
    return text


def piece_pattern(limit: int) -> str:
    """A match is the longest run of at most ``limit`` classes that ends at the strongest boundary.

    Strong boundaries count only in the second half of the room, so that pieces do not get short.
    """
    low, most = max(0, limit // 2 - 1), limit - 1
    ends = [rf"[plso]{{1,{limit}}}$", *(rf"[plso]{{{low},{most}}}{x}" for x in ("p", "l", "s")), rf"[plso]{{0,{most}}}[pls]", rf"[plso]{{{limit}}}"]
    return "|".join(ends)


def split_texts(df: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 64) -> DataFrame:
    """One row per piece of every text of more than ``limit`` tokens: (key, ``piece_no``, ``piece``,
    ``piece_tokens``, ``forced``).

    Consecutive pieces share ``overlap`` tokens; a piece with its overlap has at most ``limit`` tokens,
    and without the overlaps the pieces put together are the text again. ``forced`` is 1 where a piece
    ends inside of a sentence because no boundary (a line feed; white space directly after ``. ! ? …``)
    lies within the limit. Shorter, null and empty texts give no rows. A token is never cut, however many
    characters it has. Any limit and length will do. Rows are independent: repeated keys are cut
    separately, and nothing is shuffled.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below limit")
    # no text has more tokens than characters
    classed = df.where(F.length(text) > limit).select(F.col(key).alias("k"), F.col(text).alias("t"), boundary_classes(F.col(text)).alias("classes"))
    # a condition on the classes would be pushed below and compute them twice; without one, short texts have no pieces
    over = F.length("classes") > limit
    read = classed.select(
        "k",
        F.when(over, F.regexp_extract_all("t", F.lit(_UNIT), F.lit(0))).alias("tokens"),
        F.when(over, F.regexp_extract_all("classes", F.lit(piece_pattern(limit - overlap)), F.lit(0))).alias("cores"),
    )
    # (first token, tokens, whether a boundary ends it) of each piece; the sums run once over the pieces
    sizes = F.transform("cores", lambda c: F.length(c))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    placed = read.select("k", "tokens", "cores", starts.alias("starts"))
    pieces = F.transform("cores", lambda c, i: F.struct(
        (i + 1).alias("piece_no"),
        F.array_join(F.slice("tokens", F.greatest(F.lit(1), F.get("starts", i) + 1 - overlap), F.length(c) + F.least(F.get("starts", i), F.lit(overlap))), "").alias("piece"),
        (F.length(c) + F.least(F.get("starts", i), F.lit(overlap))).alias("piece_tokens"),
        ((i < F.size("cores") - 1) & c.endswith("o")).cast("int").alias("forced"),
    ))
    return placed.select(F.col("k").alias(key), F.explode(pieces).alias("x")).select(key, "x.*")
