"""Formatted references taken apart again: APA, MLA and GB/T lines as fields.

A line is cut at its punctuation; the pieces and the fields they may belong to form a lattice, in which fields come in the
order of a style and begin behind its marks. The best path by the pieces' looks gives the fields, and the best of the three
styles the style. So a title may hold full stops, commas and years.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

_CUT = re.compile(r"\.?\[[JM]\]\.? ?|\)\. |\), |\) | \(|\.\" |\" |\"|(?<!\bvol)(?<!\bno)(?<!\bpp)(?<!\bp)\. |, |; |: | ?(?=https?://)|\(|\)")
#: The fields of each style in order, with the marks behind which a field begins.
STYLES: dict[str, list[tuple[str, set[str]]]] = {
    "apa": [("authors", {""}), ("year", {" (", "("}), ("title", {"). ", ") "}), ("journal", {". "}), ("volume", {", "}), ("issue", {"("}), ("pages", {", ", "), "}), ("doi", {". ", " ", "", "). "})],
    "mla": [("authors", {""}), ("title", {'"'}), ("journal", {'." ', '" '}), ("volume", {", "}), ("issue", {", "}), ("year", {", "}), ("pages", {", "}), ("doi", {". ", " ", "", ", "})],
    "gb_t": [("authors", {""}), ("title", {". "}), ("journal", {"[J]. ", "[J].", "[J] ", "[M]. "}), ("year", {", "}), ("volume", {", "}), ("issue", {"("}), ("pages", {": "}), ("doi", {". ", " ", ""})],
}
_MORE = {"authors": 0.05, "title": 0.05, "journal": 1.5}  # cost of a further piece: a journal's name seldom holds a mark
_OPTIONAL = {"authors", "year", "journal", "volume", "issue", "pages", "doi"}
_FIELDS = ["title", "year", "journal", "volume", "issue", "pages", "doi"]


def _looks(field: str, text: str) -> float:
    """How well a piece fits a field; far below zero where it cannot."""
    number, words = re.fullmatch(r"[0-9]+", text), len(text.split())
    if field == "year":
        return 4.0 if re.fullmatch(r"(1[5-9]|20)[0-9]{2}|n\.d", text) else -50.0
    if field == "volume":
        return 4.0 if re.fullmatch(r"vol\. ?[0-9]+", text) else 2.0 if number and len(text) < 5 else -50.0
    if field == "issue":
        return 4.0 if re.fullmatch(r"no\. ?[0-9]+", text) else 3.0 if number and len(text) < 5 else -50.0
    if field == "pages":
        return 4.0 if re.fullmatch(r"(pp?\. ?)?[0-9]+ ?[-–] ?[0-9]+", text) else 3.0 if re.fullmatch(r"pp?\. ?[0-9]+", text) else 1.0 if number else -50.0
    if field == "doi":
        return 6.0 if re.match(r"(https?://(dx\.)?doi\.org/|doi:)?10\.[0-9]{4,9}/\S", text) else -50.0
    if field == "authors":
        short = re.fullmatch(r"(& |and )?([^\W\d_]\.?[ -]?){1,3}", text) or re.fullmatch(r"(& |and )?[^\W\d_][\w'’-]*( [^\W\d_]){0,3}|et al", text)
        return 1.5 if short else 0.5 if words <= 4 and not re.search(r"[0-9]", text) else -3.0
    if field == "title":
        return min(words, 4) * 0.4 - (0.8 if number else 0)
    return 0.5 + min(words, 3) * 0.2 if re.search(r"[^\W\d_]", text) else -50.0


def _pieces(line: str) -> list[tuple[str, int, int]]:
    """(mark before, start, end) of the pieces of a line."""
    out, at, mark = [], 0, ""
    for m in _CUT.finditer(line):
        if m.start() > at or (not out and m.end() > m.start()):
            if m.start() > at:
                out.append((mark, at, m.start()))
            mark = ""
        mark += m.group()
        at = m.end()
    if at < len(line):
        out.append((mark, at, len(line)))
    return out


@lru_cache(4096)
def _ways(style: str, mark: str) -> tuple[tuple[bool, tuple[tuple[int, float], ...]], ...]:
    """For each field of a style whether a piece after a mark can begin it, and from which fields, at what cost."""
    fields = STYLES[style]
    out = []
    for f, (_, marks) in enumerate(fields):
        begins = mark in marks or any(m and mark.endswith(m) for m in marks)
        skipped = [[n for n, _ in fields[g + 1 : f]] for g in range(f)]
        out.append((begins, tuple((g, 0.1 * len(s)) for g, s in enumerate(skipped) if begins and all(n in _OPTIONAL for n in s))))
    return tuple(out)


@lru_cache(1 << 16)
def _fits(text: str) -> dict[str, float]:
    """_looks of a piece in every field: three styles ask for the same ones, and many lines hold equal pieces."""
    plain = text.strip(" .")
    return {n: _looks(n, plain if n != "title" else text) for n, _ in STYLES["apa"]}


def _path(line: str, style: str, pieces: list[tuple[str, int, int]] | None = None) -> tuple[float, dict[str, tuple[int, int]]]:
    """Score and character ranges of the fields on the best path of one style."""
    fields, pieces = STYLES[style], _pieces(line) if pieces is None else pieces
    if not pieces:
        return -1e9, {}
    stay = [_MORE.get(name, 1e9) for name, _ in fields]
    best: list[list[tuple[float, int | None]]] = []
    for k, (mark, a, b) in enumerate(pieces):
        fits, ways = _fits(line[a:b]), _ways(style, mark)
        row: list[tuple[float, int | None]] = []
        last = best[-1] if k else []
        for f, (name, _) in enumerate(fields):
            begins, froms = ways[f]
            if k == 0:
                score, back = (0.0 if begins and f <= 1 else -1e9), None
            else:
                score, back = last[f][0] - stay[f], f
                for g, cost in froms:
                    if last[g][0] - cost > score:
                        score, back = last[g][0] - cost, g
            row.append((score + fits[name], back))
        best.append(row)
    title = next(f for f, (n, _) in enumerate(fields) if n == "title")
    last = max((f for f in range(title, len(fields))), key=lambda f: best[-1][f][0])
    score, at, found = best[-1][last][0], last, {}
    for k in range(len(pieces) - 1, -1, -1):
        name = fields[at][0]
        start, end = found.get(name, (pieces[k][1], pieces[k][2]))
        found[name] = (pieces[k][1], max(end, pieces[k][2]))
        at = best[k][at][1] if best[k][at][1] is not None else at
    return score, found


def _initials(text: str) -> str:
    return " ".join(f"{c}." for c in re.findall(r"[^\W\d_]", text))


def _names(text: str, style: str) -> list[str]:
    """`Family, Given` of a style's list of authors, given names as the style has them; `et al` gives no name."""
    text = re.sub(r",? et al\.?$", "", text.strip())
    if style == "mla":
        return [n.strip(" .") for n in re.split(r",? and ", text) if n.strip(" .")]
    if style == "apa":
        found = re.findall(r"(?:^|, )(?:& )?([^,&]+?)(?:, ((?:[^\W\d_](?:\.|$|(?=,))[ -]?)+))?(?=,|$)", text.replace(" & ", ", ").replace(",,", ","))
        return [f"{f.strip()}, {_initials(g)}" if g else f.strip() for f, g in found]
    parts = [re.fullmatch(r"(.+?)((?: [^\W\d_])*)", n.strip(" .")) for n in re.split(r"[,，] ?", text) if n.strip(" .")]
    return [f"{m.group(1)}, {_initials(m.group(2))}" if m.group(2) else m.group(1) for m in parts if m]


@lru_cache(4096)
def parse_reference(line: str, style: str | None = None) -> dict:
    """Fields of a reference line: style, authors (`Family, Given`), title, year, journal, volume, issue, pages, doi, score
    and status: partial, or failed without a title."""
    line = re.sub(r"\s+", " ", line).strip()
    doi = re.search(r"(?:https?://(?:dx\.)?doi\.org/|doi:)(10\.[0-9]{4,9}/\S+?)\.?$", line)
    pieces = _pieces(line.removesuffix("."))
    tried = {s: _path(line.removesuffix("."), s, pieces) for s in ([style] if style else STYLES)}
    best = max(tried, key=lambda s: tried[s][0])
    score, spans = tried[best]
    text = {n: line[a:b].strip(' ."') for n, (a, b) in spans.items()}
    out: dict = {n: text.get(n) or None for n in _FIELDS}
    for n in ("volume", "issue", "pages"):
        out[n] = re.sub(r"^(vol|no|pp?)\. ?", "", out[n]) if out[n] else None
    out["year"] = None if out["year"] == "n.d" else out["year"]
    out["doi"] = doi.group(1) if doi else None
    out["authors"] = _names(line[slice(*spans["authors"])], best) if "authors" in spans else []
    status = "partial" if out["title"] and len(spans) > 1 else "failed"
    return {"style": best, **out, "score": round(score, 6), "status": status}


_STRUCT = StructType([StructField("style", StringType()), StructField("authors", ArrayType(StringType())), *[StructField(n, StringType()) for n in _FIELDS], StructField("score", DoubleType()), StructField("status", StringType())])


@F.pandas_udf(_STRUCT)
def reference_fields(line: pd.Series) -> pd.DataFrame:
    """parse_reference of each line; null and empty lines fail."""
    rows = [parse_reference(s) if s and s.strip() else {"status": "failed", "authors": []} for s in line]
    return pd.DataFrame({f.name: [r.get(f.name) for r in rows] for f in _STRUCT.fields})
