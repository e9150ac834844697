"""Text rules as columns; null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The lines of a text by every Unicode line end; an end of the last line adds none."""
    parts = F.split(text, r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\u0085  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def escape_markdown(text: Column) -> Column:
    """On one line, with a backslash before what Markdown gives a meaning."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit("")), P.MARKDOWN_SPECIAL, r"\\$1")


def plaintext(markdown: Column) -> Column:
    """Without Markdown marks.  The order of the rules matters: emphasis goes before horizontal rules."""
    for pattern, by in P.PLAIN_RULES:
        markdown = F.regexp_replace(markdown, pattern, by)
    return markdown


def slug(title: Column) -> Column:
    """A title as part of a file name, NAME_CHARS characters at most (the cut may leave a last _)."""
    out = F.regexp_replace(F.translate(title, P.NAME_BLANKS, "_" * len(P.NAME_BLANKS)), P.NOT_IN_NAMES, "_")
    return F.substring(F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", ""), 1, P.NAME_CHARS)


def chapter_filename(order: Column, kind: Column, title: Column) -> Column:
    return F.concat(F.format_string("%02d", order), F.lit("_"), kind, F.lit("_"), slug(title), F.lit(".md"))


def page_filename(page_index: Column, ending: str) -> Column:
    return F.concat(F.lit("page_"), F.format_string("%04d", page_index + 1), F.lit(ending))


def is_japanese(text: Column) -> Column:
    return F.regexp_like(text, F.lit(P.JAPANESE))


def sha8(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 8)


def image_basenames(markdown: Column, has_assets: Column) -> Column:
    """Image references cut to their last path component, on pages that have assets."""
    # a trailing slash or a lone dot is no component
    cut = F.regexp_replace(markdown, r"!\[([^\]]*)\]\((?:[^)]*/)?([^)/]+)/*\)", "![$1]($2)")
    return F.when(has_assets, cut).otherwise(markdown)


def replace_found(text: Column, pattern: str, groups: int, by: Callable[[list[Column]], Column]) -> Column:
    """Every finding of a pattern replaced by what `by` makes of its groups; each is looked at once."""
    found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(f"g{i}") for i in range(groups)))
    new = F.transform(found, lambda f: by([f[f"g{i}"] for i in range(groups)]))
    between = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(between, new, lambda t, n: F.concat(t, F.coalesce(n, F.lit("")))), "")


def replace_first(text: Column, needle: Column, by: Column) -> Column:
    """The first finding of a literal replaced; an empty needle is found at the start."""
    at = F.position(needle, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), by, F.substr(text, at + F.length(needle)))).otherwise(text)
