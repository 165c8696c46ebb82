"""Column functions on text: match positions, search helpers, folding. All positions are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,text:string>>"
#: Two noncharacters, which no pattern tells apart; code points of a chunk.
MARK, STAND_IN, CHUNK = "\uffff", "\ufffe", 4096

#: Letters with marks and the compatibility signs that folding maps: fixed values, from and to in the same order.
FOLD_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿºª "
FOLD_TO = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyoa "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: expressions that use a part often stay small. Not by get, which asks for its
    type, and so goes through the whole body, for every row; element_at asks once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_spans() -> Column:
    return F.array().cast(SPANS)


def prefix_sums(values: Column) -> Column:
    """Running totals of an array of numbers, by shifts of 1, 2, 4, ... places: n log n steps, no growing array."""
    n = F.size(values)
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        by = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), by), F.slice(acc, F.lit(1), n - by)), lambda a, b: a + b)

    return F.aggregate(rounds, values, step)


def running_max(values: Column) -> Column:
    """Running maxima of an array of numbers that are not negative, by the same shifts."""
    n = F.size(values)
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        by = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), by), F.slice(acc, F.lit(1), n - by)), lambda a, b: F.greatest(a, b))

    return F.aggregate(rounds, values, step)


def unmarked(text: Column) -> Column:
    """The text with another noncharacter in place of MARK; its length and all matches stay."""
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)


def finditer(text: Column, pattern: str) -> Column:
    """All matches of a pattern that never matches the empty string, as (start, end, text); end is exclusive.

    One pass of the pattern puts MARK around each match; a split at MARK gives gaps and matches by turns, and running totals
    of their lengths are the positions. The time is near linear in the text and the matches.
    """

    def spans(parts: Column) -> Column:
        def at(ends: Column, marked: Column) -> Column:
            def one(i: Column) -> Column:
                start, end = F.get(ends, i - 1), F.get(ends, i)
                own = F.when(marked, cut(text, start, end)).otherwise(F.get(parts, i))
                return F.struct(start.alias("start"), end.alias("end"), own.alias("text"))

            return F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), one)

        ends = prefix_sums(F.transform(parts, F.length))
        found = let(F.struct(ends.alias("ends"), F.contains(text, F.lit(MARK)).alias("marked")), lambda x: at(x["ends"], x["marked"]))
        # The most common case without running totals: one match.
        start, end = F.length(F.get(parts, F.lit(0))), F.length(F.get(parts, F.lit(0))) + F.length(F.get(parts, F.lit(1)))
        own = F.when(F.contains(text, F.lit(MARK)), cut(text, start, end)).otherwise(F.get(parts, F.lit(1)))
        single = F.array(F.struct(start.alias("start"), end.alias("end"), own.alias("text")))
        return F.when(F.size(parts) == 1, empty_spans()).when(F.size(parts) == 3, single).otherwise(found)

    return let(F.split(F.regexp_replace(unmarked(text), pattern, f"{MARK}$0{MARK}"), MARK, -1), spans)


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points: places far inside are reached without counting from the start."""
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def cut_chunks(pieces: Column, start: Column, end: Column) -> Column:
    """text[start:end] of a text in chunks; the work depends on the width only."""
    low = F.greatest(start, F.lit(0)).cast("int")
    at, last = F.floor(low / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    two = F.concat(F.get(pieces, at), F.coalesce(F.get(pieces, at + 1), F.lit("")))
    local = F.when(last == at, F.get(pieces, at)).when(last == at + 1, two).otherwise(F.array_join(F.slice(pieces, at + 1, last - at + 1), ""))
    several = F.coalesce(cut(local, low - at * CHUNK, end - at * CHUNK), F.lit(""))
    return F.when(end > low, F.when(F.size(pieces) == 1, cut(F.get(pieces, F.lit(0)), low, end)).otherwise(several)).otherwise("")


def bisect(values: Column, x: Column) -> Column:
    """How many of the ascending values are below x."""
    n = F.size(values)
    steps = F.when(n > 0, F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["low"] + acc["high"], 1)
        less = F.get(values, mid) < x
        narrowed = F.struct(F.when(less, mid + 1).otherwise(acc["low"]).alias("low"), F.when(less, acc["high"]).otherwise(mid).alias("high"))
        return F.when(acc["low"] < acc["high"], narrowed).otherwise(acc)

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), step, lambda acc: acc["low"])


def half_overlaps(x: Column, spans: Column, starts: Column) -> Column:
    """Whether one of the spans, which are sorted and start at `starts`, overlaps x by half of their hull.

    Such a span starts less than x's length before x, and before x ends: only these are looked at.
    """

    def between(low: Column) -> Column:
        high = bisect(starts, x["end"])
        return let(high, lambda h: F.when(h > low, F.exists(F.sequence(low, h - 1), lambda i: iou(F.get(spans, i), x) >= 0.5)).otherwise(False))

    return F.when(F.size(spans) == 0, False).otherwise(let(bisect(starts, 2 * x["start"] - x["end"]), between))


def has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match (or a group of it); '' if there is none."""
    return F.regexp_extract(text, pattern, group)


def before(text: Column, pattern: str) -> Column:
    """What stands before the first match; the whole text if there is none. Not by split, which compiles its pattern for every row."""
    return F.when(has(text, pattern), first(text, rf"\A((?s:.*?))(?:{pattern})", 1)).otherwise(text)


def after(text: Column, pattern: str) -> Column:
    """What stands after the first match."""
    return F.substr(text, F.length(before(text, pattern)) + F.length(first(text, pattern)) + 1)


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with 0-based code points; bounds are kept inside the text."""
    low = F.greatest(start, F.lit(0))
    return F.substr(text, low + 1, F.greatest(end - low, F.lit(0)))


def ends_with_break(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def compact(text: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def null_if_empty(text: Column) -> Column:
    return let(text, lambda x: F.when(x != "", x))


def fold(text: Column) -> Column:
    """Letters without marks in upper case, single blanks, no blanks around '/', and number signs as 'N '."""
    plain = F.upper(F.translate(F.coalesce(text, F.lit("")), FOLD_FROM, FOLD_TO))
    plain = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    plain = F.regexp_replace(plain, r"(?U)\s*/\s*", "/")
    return F.regexp_replace(plain, r"(?U)\bN\s*[º°.O]\s*", "N ")


def fold_ascii(text: Column) -> Column:
    """Letters without marks in upper case; all but A-Z and 0-9 goes."""
    return F.regexp_replace(F.upper(F.translate(F.coalesce(text, F.lit("")), FOLD_FROM, FOLD_TO)), "[^A-Z0-9]+", "")


def single_edit(a: Column, b: Column) -> Column:
    """Equal lengths and exactly one different sign."""
    return (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 1)


def normal_id(value: Column) -> Column:
    """An id without blanks at its ends and, if it is all digits, without zeros in front."""
    v = F.trim(value.cast("string"))
    return F.when(has(v, r"^[0-9]+$"), F.regexp_replace(v, r"^0+(?=.)", "")).otherwise(v)


def preview(text: Column, start: Column, end: Column, width: int) -> Column:
    """A span with `width` signs around it and dots where the text goes on."""
    low, high = F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text))
    return F.concat(F.when(low > 0, "…").otherwise(""), cut(text, low, high), F.when(high < F.length(text), "…").otherwise(""))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two spans over the hull of both."""
    overlap = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.when(hull > 0, overlap / hull).otherwise(0.0)
