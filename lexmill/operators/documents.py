"""Building documents: paragraphs, sections, chunks, and checks of a parse."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

#: Token limits of a chunk, and what counts as a token.
TARGET, SOFT, HARD = 400, 650, 900
_WORD = re.compile(r"[A-Za-z0-9]+(?:['\-][A-Za-z0-9]+)*")
_CJK = re.compile("[一-鿿぀-ヿ]")


def count_tokens(s: str) -> int:
    return len(_WORD.findall(s)) + len(_CJK.findall(s))


def section_paths(sections: DataFrame, spark: SparkSession) -> DataFrame:
    """Titles from the root to each section (paper_id, section_id, parent_section_id, title), by a recursive query.

    A section whose parent is missing begins its path itself, whatever its depth; one on a circle of parents, or below
    one, is its own path. Sections of a paper must differ in their ids.
    """
    own = sections.select("paper_id", "section_id", "parent_section_id", "title")
    known = own.select("paper_id", F.col("section_id").alias("parent_section_id")).distinct()
    top = own.where("parent_section_id is null").unionByName(own.where("parent_section_id is not null").join(known, ["paper_id", "parent_section_id"], "left_anti"))
    levels = (own.groupBy("paper_id").count().agg(F.max("count")).first()[0] or 1) + 1  # no path is longer
    if int(spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000")) >= 0:
        spark.conf.set("spark.sql.cteRecursionRowLimit", -1)  # rows, not levels: a large table has many
    found = spark.sql(
        f"""
        WITH RECURSIVE up MAX RECURSION LEVEL {levels} AS (
          SELECT paper_id, section_id, array(title) AS path, 0 AS depth FROM {{top}}
          UNION ALL
          SELECT s.paper_id, s.section_id, concat(u.path, array(s.title)), u.depth + 1
          FROM {{own}} s JOIN up u ON s.paper_id = u.paper_id AND s.parent_section_id = u.section_id)
        SELECT paper_id, section_id, path, depth FROM up""",
        top=top,
        own=own,
    )
    circle = own.join(found.select("paper_id", "section_id"), ["paper_id", "section_id"], "left_anti").select("paper_id", "section_id", F.array("title").alias("path"), F.lit(0).alias("depth"))
    return found.unionByName(circle)


def merge_paragraphs(items: DataFrame, doc: str = "paper_id", order: str = "order") -> DataFrame:
    """Paragraph items joined while font, geometry and text allow; one row a paragraph, by gaps and islands.

    Items: item_type, text, page, x0, y0, y1, font_size. A sentence end closes a paragraph, a hyphen carries it on.
    """
    w = Window.partitionBy(doc).orderBy(order)
    prev = lambda c: F.lag(c).over(w)
    font = F.coalesce(F.abs(F.col("font_size") - prev("font_size")) <= F.greatest(F.lit(0.8), 0.15 * F.greatest("font_size", prev("font_size"))), F.lit(True))
    near = F.coalesce(F.abs(F.col("x0") - prev("x0")) <= 20, F.lit(True)) & F.when(F.col("page") == prev("page"), F.coalesce(F.col("y0") - prev("y1") <= F.greatest(F.lit(40.0), 3.5 * F.coalesce(prev("font_size"), F.lit(11.0))), F.lit(True))).otherwise(True)
    clean = T.clean_text(F.col("text"))
    ended = F.rtrim(prev("_clean")).rlike(r"[.!?。！？:：]$")
    joins = (F.col("item_type") == "paragraph") & (prev("item_type") == "paragraph") & font & near & ~ended
    marked = items.withColumn("_clean", clean).withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    grouped = marked.withColumn("_par", F.sum("_new").over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_clean").alias("t")))), lambda s: s["t"])
    text = F.aggregate(parts, F.lit(""), lambda acc, t: F.when(acc == "", t).when(acc.endswith("-"), F.concat(F.regexp_replace(acc, "-$", ""), t)).otherwise(F.concat_ws(" ", acc, t)))
    return grouped.groupBy(doc, "_par").agg(F.min(order).alias(order), F.first("item_type").alias("item_type"), text.alias("text"), F.count("*").alias("items")).drop("_par")


def split_overlong(text: str, most: int) -> list[tuple[int, int]]:
    """Ranges of at most `most` tokens: whole sentences where they fit, else equal shares of characters."""
    cuts, at = [], 0
    for m in re.finditer(r"[.!?][ \n]*", text):
        cuts.append((at, m.end()))
        at = m.end()
    if at < len(text) or not cuts:
        cuts.append((at, len(text)))
    joined: list[list[int]] = []
    for s, e in cuts:
        n = count_tokens(text[s:e])
        if joined and joined[-1][2] + n <= most:
            joined[-1][1], joined[-1][2] = e, joined[-1][2] + n
        else:
            joined.append([s, e, n])
    out = []
    for s, e, _ in joined:
        parts = max(1, -(-count_tokens(text[s:e]) // most)) if e - s > 1 else 1
        size = max(1, (e - s) // parts)
        out += [(min(e, s + k * size), e if k == parts - 1 else min(e, s + (k + 1) * size)) for k in range(parts)]
    return out


def duplicate_ratio(blocks: DataFrame, by: list[str], text: Column) -> DataFrame:
    """Share of rows whose cleaned, lowered text occurs more than once in the group, over all rows; empty texts never do."""
    norm = F.lower(T.clean_text(F.coalesce(text, F.lit(""))))
    counted = blocks.select(*by, norm.alias("_norm")).groupBy(*by, "_norm").agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(F.sum("_n").alias("blocks"), F.coalesce(F.sum(F.when((F.col("_n") > 1) & (F.col("_norm") != ""), F.col("_n"))), F.lit(0)).alias("duplicates")).withColumn("ratio", F.round(F.try_divide("duplicates", "blocks"), 6))


def page_coverage(blocks: DataFrame, pages: DataFrame, minimum: int = 10) -> DataFrame:
    """Share of a document's pages with enough text (doc, page_count; blocks: doc, page, text); null where unknown."""
    size = blocks.groupBy("doc", "page").agg(F.sum(F.length(F.trim("text"))).alias("chars")).where(F.col("chars") >= minimum)
    spine = pages.select("doc", "page_count", F.explode_outer(F.when(F.col("page_count") > 0, F.sequence(F.lit(1), "page_count"))).alias("page"))
    found = spine.join(size, ["doc", "page"], "left")
    return found.groupBy("doc", "page_count").agg(F.round(F.when(F.first("page_count") > 0, F.count("chars") / F.first("page_count")), 6).alias("ratio"))


def reading_order(items: DataFrame, gap: float = 40.0) -> DataFrame:
    """Column number by gaps between left edges within a page, then rank by column, y, x."""
    xs = items.select("page", "x0").distinct()
    by_x = Window.partitionBy("page").orderBy("x0")
    columns = xs.withColumn("_new", F.when(F.col("x0") - F.lag("x0").over(by_x) > gap, 1).otherwise(0)).withColumn("column", F.sum("_new").over(by_x)).drop("_new")
    order = Window.partitionBy("page").orderBy("column", "y0", "x0")
    return items.join(columns, ["page", "x0"]).withColumn("rank", F.row_number().over(order))


def markdown_items(text: Iterator[str]) -> list[tuple[str, str]]:
    """(item type, text) of Markdown lines: headings, list items, table rows, paragraphs."""
    out = []
    for line in text:
        s = line.strip()
        if s:
            kind = "heading" if re.match(r"#{1,6}\s", s) else "list" if re.match(r"([-*+]|[0-9]+[.)])\s", s) else "table" if s.startswith("|") else "paragraph"
            out.append((kind, re.sub(r"^(#{1,6}|[-*+]|[0-9]+[.)])\s+", "", s)))
    return out
