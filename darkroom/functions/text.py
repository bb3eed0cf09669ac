"""Text clean-up used by routing, judging and grounding reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkroom.functions import fixed

UNICODE = "(?U)"
ANY_CASE = "(?iU)"


def strip(c: Column) -> Column:
    """Whitespace off both ends, Unicode spaces included."""
    return F.btrim(c, F.lit(fixed.BLANK_CHARS))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, UNICODE + r"\s+", " "))


def clean_instruction(c: Column) -> Column:
    """Drop the punctuation and politeness at both ends and collapse the spaces."""
    bare = strip(F.btrim(strip(c), F.lit(fixed.CLOSING_CHARS)))
    bare = F.regexp_replace(bare, ANY_CASE + fixed.POLITE_START, "")
    return collapse(F.regexp_replace(bare, ANY_CASE + fixed.POLITE_END, ""))


def literal_map(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in entries.items() for part in pair])


def named_colour(c: Column) -> Column:
    """``#rrggbb`` for a hex value or a known name, else null."""
    word = F.lower(strip(c))
    return F.when(word.rlike(fixed.COLOUR_PATTERN), word).otherwise(
        F.try_element_at(literal_map(fixed.COLOURS), word)
    )


def normalise_subject(c: Column) -> Column:
    """Lower case, one space, no closing punctuation, leading articles dropped once each."""
    text = collapse(F.btrim(strip(F.lower(c)), F.lit(fixed.CLOSING_CHARS)))
    for article in fixed.SUBJECT_ARTICLES:
        text = F.regexp_replace(text, f"^{article}", "")
    return F.coalesce(text, F.lit(""))


def normalise_phrase(c: Column) -> Column:
    """Lower case, trimmed, ending in exactly one period; empty stays empty."""
    text = strip(F.rtrim(F.lower(strip(c)), F.lit(".")))
    return F.when(text == "", F.lit("")).otherwise(F.concat(text, F.lit(".")))


def word_count(c: Column) -> Column:
    """Words between whitespace; 0 for blank text."""
    text = strip(c)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, UNICODE + r"\s+")))


LINE_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"


def line_count(c: Column) -> Column:
    """Lines of a document; a final line break does not open another line."""
    body = F.regexp_replace(c, LINE_BREAK + r"\z", "")
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(body, LINE_BREAK)))
