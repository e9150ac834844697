"""Chapter headings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import lines, strip


def number(text: Column) -> Column:
    """A chapter number in ASCII or full-width digits, or kanji up to fifteen; else null."""
    plain = strip(F.translate(text, P.FULL_WIDTH, P.ASCII))
    kanji = F.array_position(F.array(*map(F.lit, P.KANJI_NUMBERS)), plain)
    return F.when(kanji > 0, kanji.cast("int")).when(F.regexp_like(plain, F.lit(r"^[0-9]+$")), plain.try_cast("int"))


def first_h1(markdown: Column) -> Column:
    """The heading if the first line that isn't blank is a level-one heading; else null."""
    first = F.get(F.filter(F.transform(lines(markdown), strip), lambda x: x != ""), F.lit(0))
    return F.when(first.startswith("# "), strip(F.substring(first, 3, 2**31 - 1)))


def heading_count(markdown: Column) -> Column:
    """Chapter headings on a page; more than one make it a table of contents."""
    return F.regexp_count(markdown, F.lit(P.ANY_HEADING))


def classify(heading: Column) -> Column:
    """struct(kind, chapter_number); kind is null for other headings."""
    kind = (
        F.when(F.regexp_like(heading, F.lit(P.CHAPTER)) | F.regexp_like(heading, F.lit(P.NUMBERED)), "chapter")
        .when(F.regexp_like(heading, F.lit(P.PREFACE)), "preface")
        .when(F.regexp_like(heading, F.lit(P.AFTERWORD)), "afterword")
        .when(F.regexp_like(heading, F.lit(P.INDEX)), "index")
    )
    named = F.regexp_extract(heading, P.CHAPTER, 1)
    return F.struct(kind.alias("kind"), number(F.when(named != "", named).otherwise(F.regexp_extract(heading, P.NUMBERED, 1))).alias("chapter_number"))


def clean_title(heading: Column, kind: Column) -> Column:
    """The title without its number or trailing page number; as it was if nothing is left."""
    text = strip(heading)
    unnamed = strip(F.regexp_replace(text, rf"(?U)^第\s*[{P.NUMERALS}]+\s*章\s*", ""))
    bare = strip(F.regexp_replace(text, r"(?U)^[1-9][0-9]?(?=\D)", ""))
    other = strip(F.regexp_replace(text, r"(?U)[\d\s]+$", ""))
    cleaned = F.when(kind == "chapter", F.when(unnamed != text, unnamed).otherwise(bare)).otherwise(other)
    return F.coalesce(F.nullif(cleaned, F.lit("")), text)
