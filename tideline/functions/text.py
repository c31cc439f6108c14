"""Text functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words of a text, each word padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    both, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def without_tags(html: Column, instead: str) -> Column:
    """Every run from a ``<`` to the next ``>`` replaced, in one pass: what is before a ``>`` is cut at its first ``<``.

    A pattern for such a run looks from every ``<`` to the end of a text that has no ``>``; this never looks back.
    """
    parts = F.split(html, ">")
    last = F.size(parts) - 1
    kept = lambda p, i: F.when(i == last, p).when(F.instr(p, "<") > 0, F.concat(F.substring_index(p, "<", 1), F.lit(instead))).otherwise(F.concat(p, F.lit(">")))
    return F.array_join(F.transform(parts, kept), "")


def strip_html(html: Column) -> Column:
    """Tags become spaces, four entities their characters, runs of white space one space."""
    text = without_tags(html, " ")
    for entity, char in (("&nbsp;", " "), ("&#160;", " "), ("&rsquo;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def after(text: Column, pattern: str) -> Column:
    """What follows the first match of a pattern, or null."""
    return F.get(F.split(text, pattern, 2), F.lit(1))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def compact_upper(text: Column) -> Column:
    """Without white space, in capitals: strengths to compare by."""
    return F.upper(F.regexp_replace(text, r"(?U)\s+", ""))


def title_case(text: Column) -> Column:
    """Lower case, then a capital after every word boundary, hyphens and slashes included."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def without_quotes(message: Column) -> Column:
    """A message with its quoted parts blanked, so that like messages are equal."""
    return F.regexp_replace(message, '"[^"]*"', '"…"')


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, or null."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, '^"|"$', "")


def allowed(email: Column, entries: list[str]) -> Column:
    """Is the address in a list of addresses and @domains?"""
    e = F.lower(F.trim(email))
    low = [x.strip().lower() for x in entries if x.strip()]
    return F.coalesce(e.isin(low) | F.concat(F.lit("@"), F.substring_index(e, "@", -1)).isin(low), F.lit(False))
