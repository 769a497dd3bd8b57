"""Citation queries: BibTeX records out of text, and references rendered and taken apart again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import citations as C
from lexmill.functions.citation_text import reference_fields
from lexmill.registry import query
from lexmill.sources import bibliography as B
from lexmill.sources.tables import table


@query("bibtex_records", """SELECT l_orderkey::VARCHAR AS file, 'l' || l_linenumber AS key, CASE WHEN l_linenumber % 2 = 0 THEN 'book' ELSE 'article-journal' END AS type,
  'Part ' || l_partkey || ' in {braces} of ' || l_suppkey AS title, ['Supplier' || l_suppkey, 'Clerk'] AS families, year(l_shipdate)::INTEGER AS year,
  'Orders of ' || l_orderkey || ', part ' || l_linenumber AS container_title, l_partkey || '--' || (l_partkey + l_suppkey) AS page, 'parsed' AS status
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL)""".replace(" in {braces} of ", " in braces of "))
def bibtex_records(spark: SparkSession, d: str) -> DataFrame:
    """Each order as BibTeX text of its lines, with a macro, read record by record."""
    # dealt by order once, so that lines and then orders are grouped where they are
    dealt = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").repartition("l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_shipdate").alias("t"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "Book").otherwise("article")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("null")) for x in parts])
    line, part, supplier = F.col("l_linenumber"), F.col("p"), F.col("s")
    text = said(
        "@", kind, "{l", line, ",\n title = {Part ", part, " in {{braces} of} ", supplier, "}, author = {Supplier", supplier, " and Clerk},\n year = ", F.year("t"),
        ", journal = o # \", part \" # ", line, ",\n pages = \"", part, "--{", part + supplier, "}\"}\n",
    )
    files = lines.groupBy("l_orderkey").agg(F.concat(said("@string{o = {Orders} # { of ", F.col("l_orderkey"), "}}\n"), F.array_join(F.sort_array(F.collect_list(text)), "")).alias("text"))
    told = B.bibtex_files(files, "l_orderkey", "text")
    return told.select("file", "key", "type", "title", F.transform("authors", lambda a: a["family"]).alias("families"), "year", "container_title", "page", "status")


_FIRST = ["Stone, Ann", "Rivers, Bob Lee", "Weir, Cleo", "Óg, Dara"]


def _initials(style: str) -> str:
    return "" if style == "mla" else "list_transform(a, lambda x: split_part(x, ', ', 1) || ', ' || array_to_string(list_transform(string_split(split_part(x, ', ', 2), ' '), lambda g: g[1] || '.'), ' ')) AS a, "


_EXPECTED = f"""SELECT p_partkey, year, title, journal, volume, pages, a FROM (SELECT p_partkey, (1950 + p_size)::VARCHAR AS year, p_name || '. With ' || p_partkey || ' parts, and more' AS title, p_type AS journal, p_size::VARCHAR AS volume,
  p_partkey || '-' || (p_partkey + 9) AS pages, {_FIRST}[p_partkey % 2 + 1:p_partkey % 2 + 1 + p_partkey % 3 % 2] AS a FROM part)"""


@query("reference_round_trip", " UNION ALL ".join(f"""SELECT p_partkey, '{s}' AS style, {"a" if s == "mla" else _initials(s).removesuffix(" AS a, ")} AS authors, title, year, journal, volume, pages, 'partial' AS status FROM ({_EXPECTED})""" for s in ("apa", "mla", "gb_t")))
def reference_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Parts as references in three styles, each line taken apart without being told its style."""
    part = table(spark, d, "part")
    names = F.array(*map(F.lit, _FIRST))
    authors = F.slice(names, (F.col("p_partkey") % 2 + 1).cast("int"), (1 + F.col("p_partkey") % 3 % 2).cast("int"))
    key = F.col("p_partkey")
    parts = dict(authors=authors, year=(1950 + F.col("p_size")).cast("string"), title=F.concat("p_name", F.lit(". With "), key.cast("string"), F.lit(" parts, and more")), journal=F.col("p_type"), volume=F.col("p_size").cast("string"), pages=F.concat_ws("-", key.cast("string"), (key + 9).cast("string")), doi=F.lit(None).cast("string"))
    lines = [part.select("p_partkey", C.render(style, **parts).alias("line")) for style in ("apa", "mla", "gb_t")]
    every = reduce(DataFrame.unionAll, lines).repartition(4 * spark.sparkContext.defaultParallelism)  # parts fill few splits, their lines take long
    told = every.select("p_partkey", reference_fields("line").alias("f"))
    return told.select("p_partkey", *[F.col("f")[n].alias(n) for n in ("style", "authors", "title", "year", "journal", "volume", "pages", "status")])
