"""Scalar normalisers as Column expressions: dates, identities, money, numbers, keys.

Every function takes a string Column and gives null where nothing is recognised. Patterns carry
``(?U)`` so that digits and white space are the Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the separators of information.
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trimmed(c: Column) -> Column:
    """Unicode white space off both ends."""
    # By characters, not by pattern: a pattern is tried at every place of the string.
    return F.trim(c, F.lit(_SPACE))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null (not ``''``) where there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("int").cast("string"), 2, "0")


_YMD = r"(?U)(\d{4})\s*[年\-/.]\s*(\d{1,2})\s*[月\-/.]\s*(\d{1,2})"
_YM = r"(?U)(\d{4})\s*[年\-/.]\s*(\d{1,2})\s*[月\-/.]?"


def normalize_date(c: Column) -> Column:
    """``yyyy-MM-dd`` from year, month and day in any usual writing; ``yyyy-MM`` only from ``yyyy-m`` at the end."""
    s = trimmed(c)
    full = F.concat_ws("-", F.regexp_extract(s, _YMD, 1), _two(F.regexp_extract(s, _YMD, 2)), _two(F.regexp_extract(s, _YMD, 3)))
    short = F.concat_ws("-", F.regexp_extract(s, _YM, 1), _two(F.regexp_extract(s, _YM, 2)))
    return F.when(s.rlike(_YMD), full).when(s.rlike(r"(?U)\d{4}[-/.]\d{1,2}$"), short)


def normalize_date_strict(c: Column) -> Column:
    """As above with month 1-12 and day 1-31 checked; a missing day is the first."""
    s = trimmed(c)
    with_day = r"(?U)(\d{4})\s*[.\-/年]\s*(\d{1,2})\s*[.\-/月]\s*(\d{1,2})?"
    month_only = r"(?U)(\d{4})\s*[.\-/年]\s*(\d{1,2})\s*月?"

    def built(pattern: str, day: Column) -> Column:
        month = F.regexp_extract(s, pattern, 2)
        sound = month.cast("int").between(1, 12) & day.cast("int").between(1, 31)
        return F.when(s.rlike(pattern) & sound, F.concat_ws("-", F.regexp_extract(s, pattern, 1), _two(month), _two(day)))

    day = F.coalesce(F.nullif(F.regexp_extract(s, with_day, 3), F.lit("")), F.lit("1"))
    return F.coalesce(built(with_day, day), built(month_only, F.lit("1")))


def normalize_phone(c: Column) -> Column:
    d = digits_of(c)
    return F.when((F.length(d) == 11) & d.startswith("1"), d)


def normalize_id_number(c: Column) -> Column:
    """An embedded 17 digits plus digit or X, case kept; else 18 digits in all."""
    s, d = trimmed(c), digits_of(c)
    return F.coalesce(found(s, r"(?U)\b(\d{17}[\dXx])\b"), F.when(F.length(d) == 18, d))


def normalize_student_id(c: Column) -> Column:
    d = digits_of(c)
    return F.when(F.length(d).between(6, 12), d)


def parse_money(c: Column) -> Column:
    return found(F.replace(c, F.lit(","), F.lit("")), r"(?U)(\d+(?:\.\d+)?)").try_cast("double")


def months_to_years(c: Column) -> Column:
    return F.bround(trimmed(c).try_cast("double") / 12, 2)


_LOOSE_DATE = r"[0-9]{4}[^\d]{0,2}[0-9]{1,2}[^\d]{0,2}[0-9]{1,2}"
_FROM_TO = rf"(?U)自\s*({_LOOSE_DATE})\s*(?:至|到|~|\-|—)\s*({_LOOSE_DATE})"
_TO = rf"(?U)({_LOOSE_DATE})\s*(?:至|到|~|\-|—)\s*({_LOOSE_DATE})"


def extract_date_range(c: Column) -> Column:
    """``struct(start, end)`` of the first range, one that opens with 自 preferred."""

    def ends(pattern: str) -> Column:
        return F.struct(*[normalize_date(F.regexp_extract(c, pattern, k)).alias(n) for k, n in ((1, "start"), (2, "end"))])

    return F.when(c.rlike(_FROM_TO), ends(_FROM_TO)).when(c.rlike(_TO), ends(_TO)).otherwise(
        F.struct(F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"))
    )


def normalize_identity(kind: Column, c: Column) -> Column:
    """By field type: ids upper-cased, phones of any 11 digits, student ids of 6-20 digits, anything else trimmed."""
    s, d = trimmed(c), digits_of(c)
    as_id = F.when(s.rlike(r"(?U)^\d{17}[\dXx]$"), F.upper(s)).when(F.length(d) == 18, d)
    return F.when(s == "", None).otherwise(
        F.when(kind == "ID_NUMBER", as_id)
        .when(kind == "PHONE", F.when(F.length(d) == 11, d))
        .when(kind == "STUDENT_ID", F.when(F.length(d).between(6, 20), d))
        .otherwise(s)
    )


def safe_number(c: Column) -> Column:
    """A whole or decimal number that fills the string, commas aside."""
    s = F.replace(trimmed(c), F.lit(","), F.lit(""))
    return F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))


def first_number(c: Column) -> Column:
    """The string's own number, or the first number in it."""
    # Most strings have no digit or are a number as they stand: they need none of the rest.
    loose = F.coalesce(safe_number(c), found(c, r"(-?[0-9]+(?:\.[0-9]+)?)").try_cast("double"))
    return F.when(c.rlike("[0-9]"), F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), c.try_cast("double")).otherwise(loose))


_SEMESTER = r"(?U)(20\d{2})\s*[-/]\s*(20\d{2})\s*[-]?\s*([12一二])"


def parse_semester(c: Column) -> Column:
    """``struct(academic_year, term)``, null where there is none."""
    # The three groups by one pattern: year-year-term.
    even = F.regexp_replace(c, rf"(?s)\A.*?{_SEMESTER}.*\z", "$1-$2-$3")

    def parts(x: Column) -> Column:
        term = F.when(F.substring(x, 11, 1).isin("1", "一"), "1").otherwise("2")
        return F.struct(F.substring(x, 1, 9).alias("academic_year"), term.alias("term"))

    return F.when(c.rlike(_SEMESTER), F.get(F.transform(F.array(even), parts), F.lit(0)))


def cache_key(c: Column) -> Column:
    """md5 of the first 2000 characters."""
    return F.md5(F.encode(F.substring(c, 1, 2000), "UTF-8"))


def text_preview(c: Column, n: int) -> Column:
    """The first ``n`` characters and how many more there are."""
    more = F.concat(F.substring(c, 1, n), F.lit("... (+"), (F.length(c) - n).cast("string"), F.lit(" chars)"))
    return F.when(F.length(c) > n, more).otherwise(c)
