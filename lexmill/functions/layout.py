"""Kinds of lines and blocks of a parsed page, and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that open captions, mark affiliations, abstracts and running heads.
CAPTION = r"(?i)^\s*(figure|fig\.?|table|tab\.?)\s*[0-9]+"
AFFILIATION = r"(?i)\b(university|institute|department|laboratory|school of|college|academy)\b|@|\be-?mail\b|\bcorresponding author\b"
ABSTRACT = r"(?i)^\s*(abstract|summary)\b"
NOISE = r"(?i)^\s*(vol\.|volume\s|issn|isbn|doi\b|https?://|www\.|page\s+[0-9]+|[0-9]+\s*$|copyright|©|received\b|accepted\b|available online)"


def heading_like(c: Column) -> Column:
    """A short line that is numbered or begins with a capital, without a closing full stop."""
    return (F.length(F.trim(c)).between(3, 120)) & c.rlike(r"^\s*([0-9]+(\.[0-9]+)*\.?\s+\S|\p{Lu})") & ~c.rlike(r"[.;,:]\s*$")


def equation_like(c: Column) -> Column:
    """More operators and Greek letters than a fifth of the signs that are no space, and an equals sign or arrow."""
    signs = F.length(F.regexp_replace(c, r"[^=+*/^∑∫∂√≤≥≈±×÷→α-ωΑ-Ω_{}\\-]", ""))
    return c.rlike(r"[=≤≥≈→]") & (signs * 5 > F.length(F.regexp_replace(c, r"\s", "")))


def block_kind(text: Column, font_size: Column, body_size: Column) -> Column:
    """caption, list, equation, heading or paragraph, the first that fits; a heading is larger than the body's text."""
    large = F.coalesce(font_size >= body_size * 1.15, F.lit(False))
    numbered = text.rlike(r"^\s*[0-9]+(\.[0-9]+)*\.?\s+\p{Lu}")
    return (
        F.when(text.rlike(CAPTION), "caption")
        .when(text.rlike(r"^\s*([-*•–]\s+|\(?[0-9a-z]{1,2}[.)]\s+)\S") & ~(numbered & large), "list")
        .when(equation_like(text), "equation")
        .when(heading_like(text) & (large | numbered), "heading")
        .otherwise("paragraph")
    )


def line_kind(c: Column) -> Column:
    """Lines of a first page: blank, noise, abstract, affiliation or text."""
    return F.when(F.coalesce(F.trim(c) == "", F.lit(True)), "blank").when(c.rlike(NOISE), "noise").when(c.rlike(ABSTRACT), "abstract").when(c.rlike(AFFILIATION), "affiliation").otherwise("text")


def split_authors(c: Column) -> Column:
    """Names of an author line, without markers, numbers and titles; one-letter rests are left out."""
    bare = F.regexp_replace(c, r"[0-9*†‡§¶]+|\((?:[^)]*)\)|(?i)\b(dr|prof|phd|msc)\b\.?", "")
    parts = F.split(F.regexp_replace(bare, r"(?i)\s+(and|&)\s+|\s*;\s*|、", ","), r"\s*,\s*")
    return F.filter(F.transform(parts, lambda s: F.btrim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) > 1)


def table_markdown(rows: Column) -> Column:
    """A table (array of arrays of cells), its first row as the header; bars in cells are escaped. Empty: null."""
    cell = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\s*\n\s*|\|", " ")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.concat_ws("\n", line(F.get(rows, F.lit(0))), rule, F.when(F.size(body) > 0, F.array_join(body, "\n"))))


def block_markdown(kind: Column, text: Column, level: Column) -> Column:
    """A block as Markdown lines: headings by level, equations in $$, lists and captions marked."""
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)), F.lit(6))), F.lit(" "), text))
        .when(kind == "equation", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .when(kind == "list", F.concat(F.lit("- "), F.regexp_replace(text, r"^\s*([-*•–]|\(?[0-9a-z]{1,2}[.)])\s+", "")))
        .when(kind == "caption", F.concat(F.lit("*"), text, F.lit("*")))
        .otherwise(text)
    )
