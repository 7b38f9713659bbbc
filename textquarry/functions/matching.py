"""Match predicates and snippets as column expressions.

Positions are 1-based and count characters; 0 means no match. A case-insensitive literal compares lower-cased text; where lower-casing
changes a text's length, ``original_span`` leads back to the characters that were lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.regex import InvalidPattern, compile_pattern  # noqa: F401

SNIPPET_CONTEXT = 30
ELLIPSIS = "..."
# fixed values: the markup around a hit in a snippet
MARK_OPEN = "<mark class='bg-yellow-500/30 text-yellow-300 px-0.5 rounded font-semibold'>"
MARK_CLOSE = "</mark>"


def java_pattern(pattern: str, match_case: bool = False) -> str:
    """``pattern``, of the linear-time dialect of functions.regex, for Spark's expressions; case is folded unless ``match_case``."""
    return compile_pattern(pattern, match_case).java


def regex_matches(text: Column, pattern: str, match_case: bool = False) -> Column:
    """Whether ``pattern`` is in ``text``; it is only tried on texts that hold one of the literals that every match needs."""
    found = compile_pattern(pattern, match_case)
    tried = text.rlike(found.java)
    if not found.literals:
        return tried
    held, low = F.lit(False), F.lower(text) if found.fold else text
    for x in found.literals:
        held |= F.contains(low, F.lit(x))
    return held & tried


def literal_position(text: Column, keyword: str, match_case: bool = False) -> Column:
    if match_case:
        return F.locate(keyword, text)
    # both sides are lower-cased by the same function; the keyword's side folds to a constant
    return F.call_function("locate", F.lower(F.lit(keyword)), F.lower(text))


def original_span(text: Column, position: Column, length: Column) -> Column:
    """struct(hit_pos, hit_len) in ``text`` of a span of the lower-cased text: the characters that it came from, in whole.

    No character gets shorter, so the text is read to the span's end only. ``İ`` alone becomes two characters, and the dots that it
    leaves are counted; where lengths show that a locale changes others, running sums of all characters' lower-cased lengths say where each of them went.
    """
    position = position.cast("int")
    last = (position + length - 1).cast("int")
    head = F.substring(text, F.lit(1), last)
    dot, none = F.lit("\u0307"), F.lit("")
    wide = F.replace(F.replace(head, dot, F.lit(".")), F.lit("İ"), F.lit("i\u0307"))  # as long as the lower-cased head, with no other dots

    def source(at: Column) -> Column:
        upto = F.substring(wide, F.lit(1), at)
        return at - F.length(upto) + F.length(F.replace(upto, dot, none))

    first = source(position)
    counted = F.struct(first.alias("hit_pos"), (source(last) - first + 1).alias("hit_len"))
    sizes = F.transform(F.regexp_extract_all(head, F.lit("(?s)."), F.lit(0)), lambda c: F.length(F.lower(c)))
    zero = F.lit(0)
    start = F.struct(zero.alias("end"), zero.alias("before"), zero.alias("upto"))
    summed = F.aggregate(sizes, start, lambda a, n: F.struct(
        (a["end"] + n).alias("end"), (a["before"] + (a["end"] + n < position).cast("int")).alias("before"), (a["upto"] + (a["end"] < last).cast("int")).alias("upto")),
        lambda a: F.struct((a["before"] + 1).alias("hit_pos"), (a["upto"] - a["before"]).alias("hit_len")))
    return F.when(F.length(F.lower(head)) == F.length(wide), counted).otherwise(summed)


def regex_position(text: Column, pattern: str, match_case: bool = False) -> Column:
    return F.regexp_instr(text, F.lit(java_pattern(pattern, match_case)))


def regex_hit(text: Column, pattern: str, match_case: bool = False) -> Column:
    return F.regexp_substr(text, F.lit(java_pattern(pattern, match_case)))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def snippet(text: Column, position: Column, length: Column, radius: int = SNIPPET_CONTEXT, mark_open: str = MARK_OPEN, mark_close: str = MARK_CLOSE) -> Column:
    """The hit with ``radius`` characters on both sides, HTML-escaped, the hit in mark tags, ellipses where it is cut."""
    n = F.length(text)
    start = F.least(position, n + 1)
    end = F.least(start + length, n + 1)  # exclusive
    first = F.greatest(F.lit(1), start - radius)
    last = F.least(n + 1, end + radius)
    return F.concat(
        F.when(first > 1, ELLIPSIS).otherwise(""), escape_html(F.substring(text, first, start - first)),
        F.lit(mark_open), escape_html(F.substring(text, start, end - start)), F.lit(mark_close),
        escape_html(F.substring(text, end, last - end)), F.when(last <= n, ELLIPSIS).otherwise(""))
