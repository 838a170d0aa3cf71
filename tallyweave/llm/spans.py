"""Spans of regular expressions in texts as array columns, made by Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


#: Matches whose lengths are summed one by one for a place; the sums of whole blocks are made once.
BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def most_of(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0).cast("long"))


def before(values: Column, body: Callable[[Callable[[Column], Column]], Column], fold: Callable[[Column], Column] = sum_of, both: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """`body` given a function of i: the sum of the first i values (or what `fold` makes of an array, and `both` of two results)."""
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda b: fold(F.slice(v, b * BLOCK + 1, BLOCK)))
    starts = lambda w: F.transform(w, lambda _, b: fold(F.slice(w, F.lit(1), b)))
    at = lambda v, s: lambda i: both(F.get(s, F.floor(i / BLOCK).cast("int")), fold(F.slice(v, i - i % BLOCK + 1, i % BLOCK)))
    return bound(values, lambda v: bound(bound(blocks(v), starts), lambda s: body(at(v, s))))


def matches(text: Column, pattern: str, kind: str, rank: int, holds: Callable[[Column, Column], Column] | None = None, group: int = 0) -> Column:
    """Spans (start, rank, kind, stop) of all leftmost non-overlapping matches, in code points, for which `holds(match, group)`.

    Spark gives no places of matches, but the text between them and the matches themselves; their lengths add up to the
    places. Texts without a match, nearly all, take one pass.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.zip_with(F.split(text, pattern, -1), F.arrays_zip(found.alias("whole"), inner.alias("inner")), lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), m["whole"].alias("whole"), m["inner"].alias("inner")))

    def placed(x: Column) -> Column:
        units = F.transform(x, lambda s: s["gap"] + F.coalesce(F.length(s["whole"]), F.lit(0)))

        def spans(sums: Callable[[Column], Column]) -> Column:
            at = F.transform(x, lambda s, i: F.struct((sums(i) + s["gap"]).alias("start"), s["whole"].alias("whole"), s["inner"].alias("inner")))
            kept = F.filter(at, lambda s: s["whole"].isNotNull() & (F.lit(True) if holds is None else holds(s["whole"], s["inner"])))
            return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (s["start"] + F.length(s["whole"])).alias("stop")))

        return before(units, spans)

    return F.when(text.rlike(pattern), bound(steps, placed).cast(SPAN)).otherwise(F.array().cast(SPAN))


def ordered(*parts: Column) -> Column:
    """All spans by start, then kind as listed."""
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(of_kind(spans, kind)).cast("long")


def masked(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """The text with every span replaced by `mask(span)`; a span that begins inside the one before it only extends it.

    Pieces are made one by one and joined once, so that many spans take time in proportion.
    """
    gap = lambda s, at: F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int"))
    # `reach(i)`: how far the first i spans go.
    piece = lambda reach: lambda s, i: F.when(s["start"] >= reach(i), F.concat(gap(s, reach(i)), mask(s))).otherwise("")
    pieces = lambda reach: F.concat(F.array_join(F.transform(spans, piece(reach)), ""), F.substring(text, (reach(F.size(spans)) + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, before(F.transform(spans, lambda s: s["stop"]), pieces, most_of, F.greatest)).otherwise(text)
