"""Scalar functions as Column expressions; none runs Python."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions import rules

_FULLWIDTH = "０１２３４５６７８９"
#: The characters that count as white space at the ends of a text.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any script at both ends (Spark's trim knows only the blank)."""
    return F.btrim(x, F.lit(SPACES))


def blank_as_null(x: Column) -> Column:
    return F.when(x != "", x)


def money(x: Column) -> Column:
    """An amount as a whole number: thousands commas dropped, cents cut off, 0 for what isn't a number. One _ may stand between digits.

    A short text from a sign or digit to a digit is tried as a whole number first: with 15 characters at most, the double
    that any other text goes through has the same whole part.
    """
    text = F.coalesce(x.cast("string"), F.lit(""))
    short = F.ascii(text).between(43, 57) & F.ascii(F.right(text, F.lit(1))).between(48, 57) & (F.octet_length(text) <= 15)
    plain = F.translate(strip(F.translate(text, ",", "")), _FULLWIDTH, "0123456789")
    number = plain.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$")
    return F.coalesce(F.when(short, text.try_cast("bigint")), F.when(number, F.translate(plain, "_", "").try_cast("double").try_cast("bigint")), F.lit(0).cast("bigint"))


def whole_number(x: Column) -> Column:
    """A sequence number, cut to a whole number; null for what isn't one."""
    return x.try_cast("double").try_cast("bigint")


def sheet_number(x: Column) -> Column:
    """A cell of a numeric column: a whole number by the rules of `money` where it reads as one, else the text as it is."""
    value = money(x)
    return F.when((value != 0) | strip(x).rlike(r"^[+-]?0+(\.0*)?$"), value.cast("string")).otherwise(x)


def has_any(x: Column, words: Iterable[str]) -> Column:
    """Whether a text contains one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def first_hit(x: Column, words: Column) -> Column:
    """The first word of an array that a text contains; null if none."""
    return F.get(F.filter(words, lambda w: x.contains(w)), F.lit(0))


def file_parts(name: Column) -> tuple[Column, Column]:
    """(unit, month) of a file name x_unit_month.ext: the second-last part, and the last part's first five characters."""
    parts = F.split(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "_")
    last = F.element_at(parts, -1)
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.when(F.length(last) >= 5, F.left(last, F.lit(5))).otherwise("")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))


def tenant(name: Column) -> Column:
    """The unit of a file name, else the name, else a default."""
    return F.coalesce(blank_as_null(file_parts(name)[0]), blank_as_null(name), F.lit("_default"))


def department(x: Column) -> Column:
    """A department's name in one form: aliases resolved, then the words for office, room and centre taken out in turn."""
    own = strip(F.coalesce(x, F.lit("")))
    named = own
    for alias, name in rules.DEPARTMENT_ALIASES.items():
        named = F.when(own == alias, name).otherwise(named)
    for word in rules.DEPARTMENT_WORDS:
        named = F.replace(named, F.lit(word), F.lit(""))
    return named


def title_department(x: Column, table: dict[str, str] | None = None) -> Column:
    """The department of a title: of the whole title, else of the longest listed title in it (the first listed of equal length); null if none."""
    table = rules.TITLE_DEPARTMENTS if table is None else table
    title = strip(F.coalesce(x, F.lit("")))
    out = F.lit(None).cast("string")
    for name in reversed(sorted(table, key=lambda k: -len(k))):  # the outermost test is made first
        out = F.when(title.contains(name), table[name]).otherwise(out)
    exact = F.lit(None).cast("string")
    for name, value in table.items():
        exact = F.when(title == name, value).otherwise(exact)
    return F.when(title != "", F.coalesce(exact, out))


def title_head(x: Column) -> Column:
    """The main post: the text before the first 兼."""
    return F.split_part(strip(F.coalesce(x, F.lit(""))), F.lit("兼"), F.lit(1))


def is_formal(title: Column) -> Column:
    head = title_head(title)
    return ~has_any(head, rules.EXCLUDED_TITLES) & has_any(head, rules.FORMAL_TITLES)


def without_leading_number(title: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\d+\s*", ""))


def one_letter_apart(a: Column, b: Column) -> Column:
    """Equal lengths and one character that differs."""
    return (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 1)


def is_number_cell(x: Column) -> Column:
    return x.rlike(r"(?U)^\d+$")


def is_scanned_number(x: Column) -> Column:
    """A number in scanned text, with stray marks behind it."""
    return x.rlike(r"(?U)^[\d,]+[\s._,\-/|]*$")


def from_first_thousand(numbers: Column) -> Column:
    """Numbers from the first that reaches 1000 on (grade points come before pay); null if none does."""
    at = F.array_position(F.transform(numbers, lambda n: n >= 1000), F.lit(True))
    return F.when(at > 0, F.slice(numbers, at.cast("int"), F.greatest(F.size(numbers), F.lit(1))))


def sum_check(gross: Column, *parts: Column) -> tuple[Column, Column]:
    """(passes, difference): null and 0 without a gross amount."""
    total = F.lit(0).cast("bigint")
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
    some = F.coalesce(gross, F.lit(0)) != 0
    return F.when(some, total == gross), F.when(some, gross - total).otherwise(F.lit(0).cast("bigint"))


def sorted_set(items: Column) -> Column:
    """Trimmed, not blank, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != "")))


def escaped(x: Column) -> Column:
    """Text for HTML."""
    out = F.coalesce(x.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def poll_seconds(jobs: Column, idle_seconds: Column) -> Column:
    """Seconds until a worker should ask again."""
    return F.when((jobs > 0) | (idle_seconds < rules.ACTIVE_WINDOW), rules.POLL_ACTIVE).otherwise(rules.POLL_IDLE)


def in_order(items: Column, sep: str = "、") -> Column:
    """The texts of an array of (..., text), joined in the order of what stands before them."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), sep)


def clamp(x: Column, low: int = rules.POLL_ACTIVE, high: int = rules.POLL_IDLE) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
