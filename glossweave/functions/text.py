"""Text functions as Column expressions. Lengths are code points; white space is Unicode white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display names of language codes.
LANGUAGE_NAMES = {"la": "Latin", "fr": "French", "grc": "Ancient Greek", "el": "Greek", "de": "German", "it": "Italian", "es": "Spanish", "en": "English"}

_EDGES = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """White space of any kind off both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(text, _EDGES, "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def collapse(text: Column) -> Column:
    """Each run of white space becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines at every line boundary character; a boundary at the very end opens no further line."""
    parts = F.split(text, "\r\n|[\n\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def slugify(title: Column) -> Column:
    dashed = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit("book"))


def normalize_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def escape_xml(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_html(text: Column) -> Column:
    """As escape_xml, and the double quote for attribute values."""
    return F.replace(escape_xml(text), F.lit('"'), F.lit("&quot;"))


def language_name(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.upper(code))


def truncate(text: Column, limit: int = 300) -> Column:
    """Stripped; cut at `limit` code points with an ellipsis where longer."""
    whole = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(whole) > limit, F.concat(rstrip(F.substring(whole, 1, limit)), F.lit("…"))).otherwise(whole)


def join_segments(segments: Column) -> Column:
    """The text of one side of a bead: its segments joined by spaces, stripped."""
    return strip(F.array_join(segments, " "))


def word_tokens(text: Column) -> Column:
    """Letters and letter-like numerals of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), F.lit(1))


def ordered_join(position: Column, value: Column, separator: str) -> Column:
    """Aggregate: values of the group in order of position, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v")))), lambda x: x["v"]), separator)


NUMBER = "([0-9]+)"


def parse_range(text: Column) -> Column:
    """'2-5', '2:5' or '3' as a (first, last) struct; null where nothing is given."""
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    first = F.try_element_at(numbers, F.lit(1)).cast("int")
    return F.when(first.isNotNull(), F.struct(first.alias("first"), F.coalesce(F.try_element_at(numbers, F.lit(2)).cast("int"), first).alias("last")))
