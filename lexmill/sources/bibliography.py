"""Bibliography files of many records, BibTeX and RIS, read record by record.

The text reader splits files at the mark that begins (BibTeX) or ends (RIS) a record, wherever block borders lie, so a large
file is read by many tasks and a record that spans two of them by one. Macros (`@string`) hold for their whole file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

# Month macros of BibTeX, entry and reference types, and the fields of both formats under one name each.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
TYPES = {"article": "article-journal", "inproceedings": "paper-conference", "incollection": "paper-conference", "conference": "paper-conference", "proceedings": "paper-conference", "book": "book", "inbook": "chapter", "phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report"}
RIS_TYPES = {"JOUR": "article-journal", "CPAPER": "paper-conference", "CONF": "paper-conference", "BOOK": "book", "CHAP": "chapter", "THES": "thesis", "RPRT": "report", "ELEC": "webpage"}
FIELDS = {"journal": "container_title", "booktitle": "container_title", "volume": "volume", "number": "issue", "pages": "page", "publisher": "publisher", "address": "publisher_place", "doi": "doi", "url": "url", "language": "language"}
RIS_TAGS = {"JO": "container_title", "JF": "container_title", "T2": "container_title", "VL": "volume", "IS": "issue", "PB": "publisher", "CY": "publisher_place", "DO": "doi", "UR": "url", "L1": "url", "LA": "language"}

FILE_GROUPS = 4096  # files whose macros are resolved together: a task a file would be too small
_PART = StructType([StructField("text", StringType()), StructField("macro", StringType())])
_FIELD = StructType([StructField("name", StringType()), StructField("parts", ArrayType(_PART))])
ENTRY = StructType([StructField("kind", StringType()), StructField("key", StringType()), StructField("fields", ArrayType(_FIELD)), StructField("complete", BooleanType())])


_BLANK = {"": re.compile(r"\s*"), ",": re.compile(r"[\s,]*")}
_WORD = re.compile(r"[^\s{}(),=#\"]+")
_SIGN = re.compile(r"\\.|[{}\"]", re.S)  # an escaped sign is one of its own
_INNER = r"\{(?:[^{}\\]++|\{[^{}\\]*+\})*+\}"  # braces within a value, two deep
_NAME, _BRACED, _QUOTED = r"[^\s{}(),=#\"]+", rf"\{{((?:[^{{}}\\]++|{_INNER})*+)\}}", rf'"((?:[^"{{}}\\]++|{_INNER})*+)"'
_VALUE = rf"(?:{_BRACED}|{_QUOTED}|({_NAME}))"
_FIELDS = re.compile(rf"(({_NAME})\s*=\s*(?:{_VALUE}(?=\s*[,}})])|({_VALUE}(?:\s*#\s*{_VALUE})+))\s*(?:,[\s,]*|(?=[}})])))")  # what it takes up, name, one part, or parts
_PARTS = re.compile(rf"{_VALUE}\s*(?:#\s*)?")
_HEAD, _KEY = re.compile(rf"\s*({_NAME})\s*[{{(][\s]*"), re.compile(r"([^\s{}(),=#\"]*)[\s,]*")
_COMMAS = re.compile(r"[\s,]*")
_STRING = r"(?i)^[\s\p{Z}\x1c-\x1f\x85]*string[\s\p{Z}\x1c-\x1f\x85]*[{(]"


class _Cursor:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def skip(self, marks: str = "") -> str:
        """White space and marks off; the next sign, or nothing at the end."""
        self.at = _BLANK[marks].match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def word(self) -> str:
        m = _WORD.match(self.text, self.at)
        self.at = m.end() if m else self.at
        return m.group() if m else ""

    def group(self, close: str) -> str | None:
        """What lies between the sign here and the close that fits it, braces within counted; None if it never closes."""
        depth, start = 0, self.at + 1
        for m in _SIGN.finditer(self.text, start):
            c = m.group()
            if depth == 0 and c == close:
                self.at = m.end()
                return self.text[start : m.start()]
            depth += (c == "{") - (c == "}")
        self.at = len(self.text)
        return None


def _part(braced: str, quoted: str, word: str) -> tuple[str | None, str | None]:
    return ((word, None) if word.isdigit() else (None, word.lower())) if word else (braced or quoted, None)


def _plain_fields(text: str) -> tuple[str, str | None, list[tuple[str, ...]]] | None:
    """(kind, key, matches of _FIELDS) of a record whose fields follow on each other to its end, by far the most; None for others."""
    if not (m := _HEAD.match(text)):
        return None
    kind, at, key = m.group(1).lower(), m.end(), None
    if kind in ("comment", "preamble"):
        return kind, None, []
    if kind == "string":
        at = _COMMAS.match(text, at).end()
    else:
        m = _KEY.match(text, at)
        key, at = m.group(1), m.end()
    found = _FIELDS.findall(text, at)
    taken = "".join([f[0] for f in found])
    end = at + len(taken)
    return (kind, key, found) if text[end : end + 1] in ("}", ")") and text.startswith(taken, at) else None


def _plain_entry(text: str) -> tuple[str, str | None, list[tuple[str, list[tuple[str | None, str | None]]]], bool] | None:
    """bibtex_entry of such a record."""
    if plain := _plain_fields(text):
        kind, key, found = plain
        return kind, key, [(name.lower(), [_part(*p) for p in _PARTS.findall(parts)] if parts else [_part(braced, quoted, word)]) for _, name, braced, quoted, word, parts, *_ in found], True
    return None


def bibtex_entry(text: str) -> tuple[str, str | None, list[tuple[str, list[tuple[str | None, str | None]]]], bool]:
    """(kind, key, fields, whether it is complete) of a record after its `@`; of a field name and parts, (text, macro) each."""
    if plain := _plain_entry(text):
        return plain
    c = _Cursor(text)
    c.skip()
    kind = c.word().lower()
    if c.skip() not in ("{", "("):
        return kind, None, [], False
    c.at += 1
    if kind in ("comment", "preamble"):
        return kind, None, [], True
    key = None
    if kind != "string":
        c.skip()
        key = c.word()
    fields, complete = [], False
    while (sign := c.skip(",")) not in ("", "}", ")"):
        name = c.word().lower()
        if not name or c.skip() != "=":
            break
        parts: list[tuple[str | None, str | None]] = []
        while True:
            c.at += 1
            sign = c.skip()
            if sign in ("{", '"'):
                value = c.group("}" if sign == "{" else '"')
                if value is None:
                    return kind, key, fields, False
                parts.append((value, None))
            else:
                word = c.word()
                if not word:
                    break
                parts.append((word, None) if word.isdigit() else (None, word.lower()))
            if c.skip() != "#":
                break
        fields.append((name, parts))
        complete = c.skip() in (",", "}", ")")
    return kind, key, fields, c.skip(",") in ("}", ")") and (complete or not fields)


def _lists(items: list[list], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, items)]), pa.int32()), values)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file and bibtex_entry of each text; as a map over batches, since a filter on a function's result would call it twice. But for strings, of a name only the first field with a value is kept."""
    for batch in batches:
        rows = [bibtex_entry(s or "") for s in batch.column(1).to_pylist()]
        fields = [r[2] if r[0] == "string" else list({n: (n, p) for n, p in reversed(r[2]) if p}.values()) for r in rows]
        flat = [f for held in fields for f in held]
        parts = [p for _, ps in flat for p in ps]
        part = pa.StructArray.from_arrays([pa.array([t for t, _ in parts], pa.string()), pa.array([m for _, m in parts], pa.string())], ["text", "macro"])
        field = pa.StructArray.from_arrays([pa.array([n for n, _ in flat], pa.string()), _lists([ps for _, ps in flat], part)], ["name", "parts"])
        kind, key, complete = pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), kind, key, _lists(fields, field), complete], ["file", *ENTRY.names])


def _values(given: dict[str, list[tuple[str | None, str | None]]]) -> dict[str, str]:
    """Macros of a file, by name the parts, with the macros within them put in."""

    def value(name: str, above: frozenset) -> str:
        if name not in given or name in above:
            return name.capitalize() if name in MONTHS else ""
        return "".join(t if t is not None else value(m, above | {name}) for t, m in given[name])

    return {n: value(n, frozenset()) for n in given}


def _macros(pdf: pd.DataFrame) -> pd.DataFrame:
    """Macros of some files with the macros within them put in; of a name given twice in a file the first value by order counts."""
    given: dict[str, dict[str, list]] = {}
    for file, name, parts in sorted(((f, n, [(p["text"], p["macro"]) for p in ps]) for f, n, ps in zip(pdf["file"], pdf["name"], pdf["parts"], strict=True)), key=_order):
        given.setdefault(file, {}).setdefault(name, parts)
    rows = [(f, n, v) for f, names in given.items() for n, v in _values(names).items()]
    return pd.DataFrame(rows, columns=["file", "macro", "value"])


def _order(given: tuple[str, str, list]) -> tuple[str, str, str]:
    """Of a macro given twice, the order of its values."""
    return given[0], given[1], str([{"text": t, "macro": m} for t, m in given[2]])


def bibtex_entries(raw: DataFrame) -> DataFrame:
    """raw (file, text: a record after its `@`) as file, kind, key, fields (map, lower-case names, first of a name) and
    complete (false where braces or quotes do not close). Values have single spaces and no braces; parts joined by `#` are
    one value; macros of the same file are put in, unknown ones are empty. Strings, comments,
    preambles and text outside of records give no row."""
    # strings are told by how they begin, so each record is taken apart once; entries meet the macros of their file as one map
    said = F.coalesce(F.col("text").rlike(_STRING), F.lit(False))
    parsed = lambda rows: rows.select("file", "text").mapInArrow(_entries, StructType([StructField("file", StringType()), *ENTRY]))
    strings = parsed(raw.where(said)).where("kind = 'string'").select("file", F.explode("fields").alias("f")).select("file", "f.name", "f.parts")
    macros = strings.groupBy(F.pmod(F.xxhash64("file"), F.lit(FILE_GROUPS))).applyInPandas(_macros, "file string, macro string, value string")
    given = macros.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("macro", "value"))).alias("given"))
    entries = parsed(raw.where(~said)).where("kind rlike '^[a-z]+$' and key is not null").join(given.hint("merge"), "file", "left")
    month = lambda m: F.when(m.isin(MONTHS), F.initcap(m))
    text = lambda p: F.coalesce(p["text"], F.try_element_at("given", p["macro"]), month(p["macro"]), F.lit(""))
    value = lambda f: F.array_join(F.transform(f["parts"], text), "")
    clean = lambda v: F.btrim(F.regexp_replace(F.regexp_replace(v, r"(?<!\\)[{}]", ""), r"\s+", " "))
    told = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), clean(value(f)).alias("v")))
    return entries.select("file", "kind", "key", F.map_from_entries(F.array_sort(told)).alias("fields"), "complete")


def _names(raw: Column) -> Column:
    """family and given of each name; a single word is a family."""
    c = lambda s: F.btrim(F.regexp_replace(s, r"\s+", " "))
    comma = lambda s: F.struct(c(F.substring_index(s, ",", 1)).alias("family"), F.nullif(c(F.regexp_extract(s, r"(?s),(.*)$", 1)), F.lit("")).alias("given"))
    plain = lambda s: F.struct(F.substring_index(c(s), " ", -1).alias("family"), F.nullif(F.btrim(F.regexp_replace(c(s), r"[^ ]+$", "")), F.lit("")).alias("given"))
    return F.transform(F.filter(raw, lambda s: c(s) != ""), lambda s: F.when(s.contains(","), comma(s)).otherwise(plain(s)))


def _told(df: DataFrame, kind: Column, title: Column, authors: Column, year: Column, fields: dict[str, Column], complete: Column) -> DataFrame:
    blank = lambda c: F.nullif(c, F.lit(""))
    number = blank(F.regexp_extract(F.coalesce(year, F.lit("")), "[0-9]{4}", 0)).cast("int")
    noted = F.array_compact(F.array(F.when(~complete, "incomplete"), F.when(F.size(authors) == 0, "missing_authors"), F.when(number.isNull(), "missing_year")))
    failed = blank(title).isNull()
    status = F.when(failed, "failed").when(F.size(noted) > 0, "partial").otherwise("parsed")
    names = [c.split()[0] for c in ("container_title", "volume", "issue", "page", "publisher", "publisher_place", "doi", "url", "language")]
    return df.select("file", "key", kind.alias("type"), blank(title).alias("title"), authors.alias("authors"), number.alias("year"), *[blank(fields[n]).alias(n) for n in names], status.alias("status"), F.when(failed, F.array(F.lit("missing_title"))).otherwise(noted).alias("warnings"))


def bibtex_citations(entries: DataFrame) -> DataFrame:
    """bibtex_entries as citations: file, key and type, title, authors, year, container_title to language, status and warnings; without a title status is failed."""
    get = lambda n: F.col("fields")[n]
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    authors = _names(F.split(F.coalesce(get("author"), F.lit("")), r"(?i)\s+and\s+"))
    same = {t: F.coalesce(*[get(b) for b, n in FIELDS.items() if n == t]) for t in FIELDS.values()}
    return _told(entries, F.coalesce(kinds[F.col("kind")], F.lit("unknown")), get("title"), authors, get("year"), same, F.col("complete"))


_BRACE, _SPACES = re.compile(r"(?<!\\)[{}]"), re.compile(r"[ \t\n\x0b\f\r]+")  # white space as Spark's patterns have it
_ODD = re.compile(r"[\t\n\x0b\f\r]|  ")
_AND, _FOUR = re.compile(r"[ \t\n\x0b\f\r]+[aA][nN][dD][ \t\n\x0b\f\r]+"), re.compile("[0-9]{4}")
_TYPE = re.compile("[a-z]+")
_BEGIN = re.compile(r"\n[ \t]*@")
_PERSON = pa.struct([("family", pa.string()), ("given", pa.string())])


def _clean(v: str) -> str:
    if "{" in v or "}" in v:
        v = _BRACE.sub("", v) if "\\" in v else v.replace("{", "").replace("}", "")
    if _ODD.search(v):
        v = _SPACES.sub(" ", v)
    return v.strip(" ")


@lru_cache(1 << 14)
def _people(raw: str) -> list[tuple[str, str | None]]:
    """_names of a cleaned value."""
    out = []
    for name in _AND.split(raw):
        told = _SPACES.sub(" ", name).strip(" ")
        if told:
            family, comma, given = name.partition(",") if "," in name else (told.rpartition(" ")[2], "", told.rpartition(" ")[0])
            out.append((_SPACES.sub(" ", family).strip(" "), _SPACES.sub(" ", given).strip(" ") or None))
    return out


def _file_citations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, text of whole files as the rows of bibtex_citations, some thousand records at a time."""
    names = list(dict.fromkeys(FIELDS.values()))
    sources = [[b for b, n in FIELDS.items() if n == t] for t in names]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        file, key, kind, title, people, year, fields, status, warnings = zip(*rows, strict=True)
        flat = [p for ps in people for p in ps]
        persons = pa.StructArray.from_arrays([pa.array([f for f, _ in flat], pa.string()), pa.array([g for _, g in flat], pa.string())], fields=list(_PERSON))
        told = [pa.array(c, pa.string()) for c in zip(*fields, strict=True)]
        noted = pa.array(warnings, pa.list_(pa.string()))
        columns = [pa.array(file, pa.string()), pa.array(key, pa.string()), pa.array(kind, pa.string()), pa.array(title, pa.string()), _lists(people, persons), pa.array(year, pa.int32()), *told, pa.array(status, pa.string()), noted]
        return pa.RecordBatch.from_arrays(columns, ["file", "key", "type", "title", "authors", "year", *names, "status", "warnings"])

    rows: list[tuple] = []
    for batch in batches:
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None:
                continue
            given: list[tuple[str, str, list]] = []
            entries = []
            for piece in _BEGIN.split("\n" + text):
                plain = _plain_fields(piece)
                if plain and plain[0] != "string":
                    kind, key, parts = plain
                    complete = True
                else:
                    kind, key, parts, complete = bibtex_entry(piece)
                if kind == "string":
                    given += [(file or "", n, p) for n, p in parts]
                elif key is not None and _TYPE.fullmatch(kind):
                    entries.append((kind, key, parts, complete, plain))
            macros: dict[str, list] = {}
            for _, name, parts in sorted(given, key=_order) if len(given) > 1 else given:
                macros.setdefault(name, parts)
            known = _values(macros)

            def said(ps: list[tuple[str | None, str | None]], known=known) -> str:
                return "".join([t if t is not None else known[m] if m in known else m.capitalize() if m in MONTHS else "" for t, m in ps])

            for kind, key, parts, complete, plain in entries:
                held: dict[str, str] = {}
                if plain:
                    for _, name, braced, quoted, word, several, *_ in parts:
                        if (name := name.lower()) not in held:
                            held[name] = _clean(said([_part(*p) for p in _PARTS.findall(several)]) if several else (word if word.isdigit() else said([(None, word.lower())])) if word else braced or quoted)
                else:
                    for name, ps in parts:
                        if ps and name not in held:
                            held[name] = _clean(said(ps))
                people = _people(held.get("author", ""))
                number = _FOUR.search(held.get("year", ""))
                title = held.get("title") or None
                fields = [(held.get(of[0]) if len(of) == 1 or of[0] in held else next((held[b] for b in of if b in held), None)) or None for of in sources]
                noted = ["missing_title"] if title is None else [w for w, bad in (("incomplete", not complete), ("missing_authors", not people), ("missing_year", number is None)) if bad]
                status = "failed" if title is None else "partial" if noted else "parsed"
                rows.append((file, key, TYPES.get(kind, "unknown"), title, people, int(number.group()) if number else None, fields, status, noted))
                if len(rows) == 8192:
                    yield table(rows)
                    rows = []
    if rows:
        yield table(rows)


def bibtex_files(df: DataFrame, file: str, text: str) -> DataFrame:
    """bibtex_citations of rows that hold a whole file each, its macros with it: no file may have two rows. A row is taken apart
    in one pass where it stands, so nothing is shuffled."""
    out = "file string, key string, type string, title string, authors array<struct<family: string, given: string>>, year int, "
    out += "".join(f"{n} string, " for n in dict.fromkeys(FIELDS.values())) + "status string, warnings array<string>"
    return df.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text")).mapInArrow(_file_citations, out)


def ris_citations(raw: DataFrame) -> DataFrame:
    """raw (file, text: a RIS record up to its ER line) as citations; of a tag the first line counts, but for authors and
    the parts of a title. Records without a tag give no row."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda s: s.rlike(r"^[A-Z][A-Z0-9]\s*-"))
    tags = F.transform(lines, lambda s: F.struct(F.substring(s, 1, 2).alias("tag"), F.regexp_replace(s, r"^[A-Z][A-Z0-9]\s*-\s*|\s+$", "").alias("v")))
    df = raw.select("file", F.lit(None).cast("string").alias("key"), tags.alias("tags")).where("size(tags) > 0")
    all_of = lambda *t: F.transform(F.filter("tags", lambda p: p["tag"].isin(*t)), lambda p: p["v"])
    one = lambda *t: F.get(all_of(*t), F.lit(0))
    title = F.coalesce(*[F.when(F.size(all_of(t)) > 0, F.array_join(all_of(t), " ")) for t in ("TI", "T1", "CT")])
    page = F.concat_ws("-", F.nullif(one("SP"), F.lit("")), F.nullif(one("EP"), F.lit("")))
    fields = {t: F.coalesce(*[F.nullif(one(r), F.lit("")) for r, n in RIS_TAGS.items() if n == t]) for t in RIS_TAGS.values()} | {"page": page}
    kinds = F.create_map(*[F.lit(x) for pair in RIS_TYPES.items() for x in pair])
    return _told(df, F.coalesce(kinds[F.upper(one("TY"))], F.lit("unknown")), title, _names(all_of("AU")), F.coalesce(one("PY"), one("Y1"), one("DA")), fields, F.lit(True))


def bibtex_text(df: DataFrame, file: str, text: str) -> DataFrame:
    """Rows that hold many records each, as (file, text) of one record a row."""
    return df.select(F.col(file).cast("string").alias("file"), F.explode(F.split(F.concat(F.lit("\n"), text), r"\n[ \t]*@")).alias("text")).where("text <> '\n'")


def ris_text(df: DataFrame, file: str, text: str) -> DataFrame:
    return df.select(F.col(file).cast("string").alias("file"), F.explode(F.split(F.col(text), r"(?m)^ER\s*-.*$")).alias("text"))


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    return spark.read.option("lineSep", mark).text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^@", "").alias("text"))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Citations of BibTeX files; records must begin with `@` at the start of a line."""
    return bibtex_citations(bibtex_entries(_records(spark, path, "\n@")))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """Citations of RIS files; records must end with an `ER  -` line."""
    return ris_citations(_records(spark, path, "\nER  -"))

