"""Recognising written timestamps with JVM-side expressions only.

``tidy``, ``parse`` and ``finish`` turn any text into the wall clock in microseconds (null when no existing
date and time is named), the zone name that still has to be resolved (null when the offset already
gives the answer) and the offset in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names in English, Russian (genitive and nominative) and German.
MONTHS = {
    1: "january jan января январь januar jän",
    2: "february feb февраля февраль februar",
    3: "march mar марта март märz mär",
    4: "april apr апреля апрель",
    5: "may мая май mai",
    6: "june jun июня июнь juni",
    7: "july jul июля июль juli",
    8: "august aug августа август",
    9: "september sep sept сентября сентябрь",
    10: "october oct октября октябрь oktober okt",
    11: "november nov ноября ноябрь",
    12: "december dec декабря декабрь dezember dez",
}
# Zone abbreviations as offsets in seconds.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -18000, "EDT": -14400, "CET": 3600, "CEST": 7200, "MSK": 10800}
MAX_OFFSET_S = 18 * 3600

SPACE = r"[\p{Z}\t-\r\x1c-\x1f\x85]"
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}$"

_ZONE = r"((?:Z|[A-Z]{3,4})|[+-]\d{2}(?::?\d{2})?|[A-Z][A-Z_+-]*(?:/[A-Z0-9_+-]+)+|\[[A-Z0-9_/+-]+\]|[+-]\d{2}:?\d{2}\[[A-Z0-9_/+-]+\])?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?(AM|PM)\b)?"
# every form rewrites to year|month|day|hour|minute|second|fraction|am/pm|zone
_FORMS = [
    (rf"(?i)^(\d{{4}})([-./])(\d{{1,2}})\2(\d{{1,2}})(?:(?:T|,? ){_TIME} ?{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"(?i)^(\d{{1,2}})[.-](\d{{1,2}})[.-](\d{{4}}|\d{{2}})(?:(?:T|,? ){_TIME} ?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(?iu)^(?:\p{{L}}{{2,9}}\.?, ?)?(\d{{1,2}})\.? (\p{{L}}+)\.?,? (\d{{4}})(?:,? {_TIME} ?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(?iu)^(?:\p{{L}}{{2,9}}\.?, ?)?(\p{{L}}+)\.? (\d{{1,2}}),? (\d{{4}})(?:,? {_TIME} ?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))? ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
]
_SLASHED = rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:(?:T|,? ){_TIME} ?{_ZONE})?$"
_EPOCH = r"^(\d{10}|\d{13}|\d{16})(?:[.](\d{1,6})\d*)?$"


# The white space characters of Unicode.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.btrim(c, F.lit(SPACES))


def tidy(text: Column) -> Column:
    """Without surrounding white space, inner runs of it made one blank."""
    s = strip(text)
    return F.when(s.rlike(rf"{SPACE}{{2}}|[\t\n\xa0]"), F.regexp_replace(s, rf"{SPACE}+", " ")).otherwise(s)


def parse(s: Column, mdy: Column) -> Column:
    """A ``tidy`` value as the parts of its form, led by c (canonical), w (written) or e (Unix time).

    ``mdy``: whether slashed dates have the month first. Null where no form matches.
    """
    canonical = s.rlike(CANONICAL)
    record = F.when(canonical, F.concat(F.lit("c|"), s))
    for pattern, order in _FORMS[:2]:
        record = record.when(s.rlike(pattern), F.regexp_replace(s, pattern, "w|" + order))
    record = record.when(
        s.rlike(_SLASHED),
        F.when(mdy, F.regexp_replace(s, _SLASHED, "w|$3|$1|$2|$4|$5|$6|$7|$8|$9")).otherwise(
            F.regexp_replace(s, _SLASHED, "w|$3|$2|$1|$4|$5|$6|$7|$8|$9")
        ),
    )
    record = record.when(s.rlike(_EPOCH), F.regexp_replace(s, _EPOCH, "e|$1|$2"))
    for pattern, order in _FORMS[2:]:
        record = record.when(s.rlike(pattern), F.regexp_replace(s, pattern, "w|" + order))
    return F.split(record, r"\|")


def finish(df: DataFrame, p: str, naive: str, prefix: str) -> DataFrame:
    """From the parts in column ``p`` to ``<prefix>us`` (wall clock in microseconds), ``<prefix>zone`` and
    ``<prefix>offset``; ``naive``: the column with the zone of values that write none.

    Every step is a column of its own and has a lambda, which Spark evaluates outside of whole-stage code:
    as one generated method the steps are too long for the JVM to compile, and thirty times slower.
    """
    kind = F.col(p)[0]
    col = lambda name: F.col(prefix + name)
    at = lambda i: F.get(p, F.lit(i))
    names = F.create_map(*[F.lit(x) for m, words in MONTHS.items() for w in words.split() for x in (w, f"{m:02d}")])
    short = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    written = kind == "w"
    out = df.withColumns({
        prefix + "dated": F.forall(F.slice(p, 5, 2), lambda x: x == ""),
        prefix + "hour": F.when(F.length(at(8)) == 0, at(4)).when(
            at(4).try_cast("int").between(1, 12),
            (at(4).try_cast("int") % 12 + F.when(F.upper(at(8)) == "PM", 12).otherwise(0)).cast("string"),
        ),
        prefix + "month": F.coalesce(F.try_element_at(names, F.lower(at(2))), F.lpad(at(2), 2, "0")),
        prefix + "zn": F.when(written & (at(4) != ""), at(9)).otherwise("UTC"),
    })
    clock = F.when(col("dated"), "00:00:00").otherwise(
        F.concat(F.lpad(col("hour"), 2, "0"), F.lit(":"), at(5), F.lit(":"), F.rpad(at(6), 2, "0"), F.lit("."), F.rpad(F.substring(at(7), 1, 6), 6, "0"))
    )
    two = lambda a: F.array_join(F.transform(a, lambda x: F.when(x == "", x).otherwise(F.lpad(x, 2, "0"))), "-")
    digits = F.translate(F.substring_index(col("zn"), "[", 1), ":", "")
    out = out.withColumns({
        prefix + "text": F.when(written, F.concat(F.lpad(at(1), 4, "20"), two(F.array(F.lit(""), col("month"), at(3))), F.lit(" "), clock)).when(
            kind == "c", at(1)
        ),
        prefix + "epoch": F.when(kind == "e", F.rpad(F.concat(at(1), at(2)), 16, "0").try_cast("long")),
        prefix + "sign": F.when(F.substring(col("zn"), 1, 1) == "-", -1).when(F.substring(col("zn"), 1, 1) == "+", 1),
        prefix + "hhmm": F.when(F.substring(col("zn"), 1, 1).isin("+", "-"), F.rpad(F.substring(digits, 2, 4), 4, "0").cast("int")),
        prefix + "bare": F.btrim(col("zn"), F.lit("[]")),
    })
    minutes = col("hhmm") % 100
    seconds = F.floor(col("hhmm") / 100) * 3600 + minutes * 60
    out = out.withColumns({
        prefix + "us": F.coalesce(F.unix_micros(col("text").try_cast("timestamp")), col("epoch")),
        prefix + "offset": F.when(col("sign").isNotNull(), F.when((minutes < 60) & (seconds <= MAX_OFFSET_S), (col("sign") * seconds).cast("int")))
        .when(col("bare") != "", F.try_element_at(short, F.upper(col("bare"))))
        .when(F.col(naive) == "UTC", 0),
        prefix + "zone": F.when(col("sign").isNull(), F.when(col("bare") != "", col("bare")).otherwise(F.col(naive))),
    })
    return out.withColumn(prefix + "zone", F.when(col("offset").isNull(), col("zone")))
