"""Citation records: parsing BibTeX and RIS, dates and names, and rendering in three styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of the RIS format and the fields that they fill.
RIS_FIELDS = {"TI": "title", "T1": "title", "PY": "year", "Y1": "year", "JO": "journal", "T2": "journal", "VL": "volume", "IS": "issue", "SP": "page", "DO": "doi"}
BIBTEX_FIELDS = ["title", "author", "year", "journal", "volume", "number", "pages", "doi"]


def citation_format(raw: Column) -> Column:
    """bibtex, ris, csl_json or text, by how the record begins."""
    c = F.ltrim(raw)
    return F.when(c.rlike(r"^@[A-Za-z]+\s*\{"), "bibtex").when(c.rlike(r"^TY  - "), "ris").when(c.rlike(r"^[\[{]"), "csl_json").otherwise("text")


def bibtex_field(raw: Column, name: str) -> Column:
    """Value of a field in braces (one level nested) or quotes, or a bare number; braces inside are dropped. Null if absent."""
    pattern = rf"(?is)(?:^|[,{{\s]){name}\s*=\s*(?:\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}|\"([^\"]*)\"|([0-9]+))"
    found = F.concat(*[F.regexp_extract(raw, pattern, k) for k in (1, 2, 3)])
    return F.nullif(F.btrim(F.regexp_replace(F.regexp_replace(found, r"[{}]", ""), r"\s+", " ")), F.lit(""))


def bibtex(raw: Column) -> Column:
    """Struct of BIBTEX_FIELDS, with authors as an array of names."""
    authors = F.split(bibtex_field(raw, "author"), r"\s+and\s+")
    fields = [bibtex_field(raw, f).alias(f) for f in BIBTEX_FIELDS if f != "author"]
    return F.struct(F.transform(authors, normal_name).alias("authors"), *fields)


def ris(raw: Column) -> Column:
    """Struct of title, year, journal, volume, issue, page, doi and authors of a RIS record; first tag of a kind wins."""
    lines = F.filter(F.split(raw, r"\r?\n"), lambda s: s.rlike(r"^[A-Z][A-Z0-9]  - "))
    pairs = F.transform(lines, lambda s: F.struct(F.substring(s, 1, 2).alias("tag"), F.btrim(F.regexp_replace(s, r"^[A-Z][A-Z0-9]  - ", "")).alias("v")))
    value = lambda f: F.nullif(F.get(F.transform(F.filter(pairs, lambda p: p["tag"].isin([t for t, n in RIS_FIELDS.items() if n == f])), lambda p: p["v"]), F.lit(0)), F.lit(""))
    authors = F.transform(F.filter(pairs, lambda p: p["tag"].isin("AU", "A1")), lambda p: normal_name(p["v"]))
    fields = [value(f).alias(f) for f in dict.fromkeys(RIS_FIELDS.values()) if f != "year"]
    return F.struct(authors.alias("authors"), F.nullif(F.regexp_extract(value("year"), r"[0-9]{4}", 0), F.lit("")).alias("year"), *fields)


def normal_name(name: Column) -> Column:
    """`Family, Given` of a name in either order; a single word stays."""
    c = F.btrim(F.regexp_replace(name, r"\s+", " "))
    return F.when(c.contains(",") | ~c.contains(" "), c).otherwise(F.concat(F.substring_index(c, " ", -1), F.lit(", "), F.regexp_replace(c, r" [^ ]+$", "")))


def issued(parts: Column) -> Column:
    """ISO date, as far as known, of a date-parts array [year, month, day]; null without a plausible year."""
    y, m, d = (F.get(parts, F.lit(i)) for i in range(3))
    year = F.when(y.between(1000, 9999), F.lpad(y.cast("string"), 4, "0"))
    month = F.when(m.between(1, 12), F.lpad(m.cast("string"), 2, "0"))
    day = F.when(month.isNotNull() & d.between(1, 31), F.lpad(d.cast("string"), 2, "0"))
    return F.when(year.isNotNull(), F.concat_ws("-", year, month, day))


def _initials(name: Column, dot: str) -> Column:
    """`Family, G. H.` of `Family, Given Hidden`."""
    family, given = F.btrim(F.substring_index(name, ",", 1)), F.btrim(F.regexp_extract(name, r",\s*(.*)$", 1))
    letters = F.transform(F.filter(F.split(given, r"[\s.\-]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit(dot)))
    return F.when(given == "", family).otherwise(F.concat(family, F.lit(", " if dot else " "), F.array_join(letters, " ")))


def render(style: str, authors: Column, year: Column, title: Column, journal: Column, volume: Column, pages: Column, doi: Column) -> Column:
    """A record as one line of style apa, mla or gb_t; parts that are null are left out with their punctuation."""
    n = F.size(authors)
    if style == "apa":
        names = F.transform(authors, lambda a: _initials(a, "."))
        who = F.when(n == 1, F.get(names, F.lit(0))).when(n > 1, F.concat(F.array_join(F.slice(names, 1, n - 1), ", "), F.lit(", & "), F.element_at(names, -1)))
        return F.concat_ws(" ", who, F.concat(F.lit("("), F.coalesce(year, F.lit("n.d.")), F.lit(").")), F.concat(title, F.lit(".")), F.concat(F.concat_ws(", ", journal, volume, pages), F.lit(".")), F.concat(F.lit("https://doi.org/"), doi))
    if style == "mla":
        who = F.when(n == 1, F.get(authors, F.lit(0))).when(n == 2, F.concat(F.get(authors, F.lit(0)), F.lit(", and "), F.get(authors, F.lit(1)))).when(n > 2, F.concat(F.get(authors, F.lit(0)), F.lit(", et al")))
        return F.concat_ws(" ", F.concat(who, F.lit(".")), F.concat(F.lit('"'), title, F.lit('."')), F.concat(F.concat_ws(", ", journal, F.concat(F.lit("vol. "), volume), year, F.concat(F.lit("pp. "), pages)), F.lit(".")))
    if style != "gb_t":
        raise ValueError(f"unknown style {style}")
    names = F.transform(F.slice(authors, 1, 3), lambda a: _initials(a, ""))
    who = F.when(n > 0, F.concat(F.array_join(names, ", "), F.when(n > 3, ", et al").otherwise("")))
    place = F.concat(F.concat_ws(", ", journal, year, volume), F.coalesce(F.concat(F.lit(": "), pages), F.lit("")))
    return F.concat_ws(" ", F.concat(who, F.lit(".")), F.concat(title, F.lit("[J].")), F.concat(place, F.lit(".")))


def warnings(authors: Column, year: Column, title: Column) -> Column:
    """Names of the missing parts that a citation needs."""
    gone = lambda c: F.coalesce(c == "", F.lit(True))
    return F.array_compact(F.array(F.when(F.coalesce(F.size(authors) == 0, F.lit(True)), "missing_authors"), F.when(gone(year), "missing_year"), F.when(gone(title), "missing_title")))
