"""Retrieval chunks of whole documents: one pass over each document's array of blocks, where it lies.

A row holds a document, so no block is shuffled. Blocks become units (a table, figure or equation with its captions, or one
block of text), and the units of a section fill chunks in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.operators.documents import HARD, SOFT, TARGET, count_tokens, split_overlong

STRUCTURED = ("table", "figure", "equation")
#: What a block of the input holds. text: Markdown of tables, LaTeX of equations; rows: those of a table, its header one.
BLOCK = "block_id string, block_type string, section_id string, section_path array<string>, text string, page int, caption_ids array<string>, parent_id string, rows int"
CHUNK = (
    "chunk_no long, section_id string, section_path array<string>, pages array<int>, source_refs array<struct<block_id: string, char_start: int, char_end: int>>, body_text string, context_prefix string, "
    "prefix_compacted boolean, token_count long, block_types array<string>, table_row_start long, table_row_end long, caption_text string"
)


class Unit(NamedTuple):
    text: str
    refs: list[tuple[str, int, int]]
    types: list[str]
    pages: list[int]
    caption: str | None = None
    rows: tuple[int, int] | None = None

    @property
    def tokens(self) -> int:
        return count_tokens(self.text)


def _text(block: dict) -> str:
    return "" if block["block_type"] == "figure" else block["text"] or ""


def _plain(block: dict, start: int = 0, end: int | None = None) -> Unit:
    text = _text(block)
    end = len(text) if end is None else end
    return Unit(text[start:end], [(block["block_id"], start, end)], [block["block_type"]], [block["page"]] if block["page"] is not None else [])


def _captions(blocks: list[dict]) -> dict[int, list[dict]]:
    """Captions of each structured block, by its place: those that it lists, else those that point to it."""
    at = {b["block_id"]: b for b in blocks if b["block_type"] == "caption"}
    order = {b["block_id"]: k for k, b in enumerate(blocks)}
    pointing: dict[str, list[dict]] = {}
    for b in at.values():
        if b["parent_id"] is not None:
            pointing.setdefault(b["parent_id"], []).append(b)
    out = {}
    for k, b in enumerate(blocks):
        if b["block_type"] in STRUCTURED:
            listed = [at[c] for c in b["caption_ids"] or [] if c in at]
            out[k] = sorted(listed or pointing.get(b["block_id"], []), key=lambda c: order[c["block_id"]])
    return out


def _bound(block: dict, captions: list[dict]) -> Unit:
    parts = [_plain(block), *map(_plain, captions)]
    words = "\n\n".join(p.text for p in parts[1:])
    text = parts[0].text + ("\n\n" + words if captions else "")
    return Unit(text, [r for p in parts for r in p.refs], [t for p in parts for t in p.types], [n for p in parts for n in p.pages], words if captions else None)


def _row_groups(block: dict, captions: list[dict], room: int) -> list[Unit]:
    """A table's lines in groups that fit, each under the two header lines and with the captions, if these leave room.

    Line k of the body is row k + 1 of the table, none beyond its last; groups adjoin and cover all rows.
    """
    head, body = block["text"].split("\n")[:2], block["text"].split("\n")[2:]
    words = "\n\n".join(_text(c) for c in captions)
    fixed = count_tokens("\n".join(head))
    told = bool(words) and fixed + count_tokens(words) <= room
    fixed = fixed + count_tokens(words) if told else min(fixed, room)
    starts, held = [0], 0
    for k, line in enumerate(body):
        n = count_tokens(line)
        if k > starts[-1] and fixed + held + n > room:
            starts.append(k)
            held = 0
        held += n
    last = block["rows"] - 1
    edges = [0, *[min(k + 1, last) for k in starts[1:]], block["rows"]]
    out = []
    for g, start in enumerate(starts):
        lines = body[start : starts[g + 1] if g + 1 < len(starts) else None]
        refs = [(block["block_id"], 0, len(block["text"]))] + ([(c["block_id"], 0, len(_text(c))) for c in captions] if told else [])
        first = min(edges[g], block["rows"])
        rows = (first, min(max(edges[g + 1], first + 1), block["rows"]))
        pages = [b["page"] for b in [block, *captions] if b["page"] is not None]
        out.append(Unit("\n".join([*head, *lines]) + ("\n\n" + words if told else ""), refs, ["table", "caption"] if told else ["table"], pages, words or None, rows))
    return out


def _fragments(block: dict, captions: list[dict], room: int) -> list[Unit]:
    """An overlong unit in parts: tables by rows where these are known, else each block by sentences."""
    if block["block_type"] == "table" and block["rows"] and "\n" in (block["text"] or ""):
        return _row_groups(block, captions, room)
    out = []
    for b in [block, *captions]:
        text = _text(b)
        out += [_plain(b)] if count_tokens(text) <= room else [_plain(b, s, e) for s, e in split_overlong(text, room)]
    return out


def _units(blocks: list[dict], room: int) -> Iterator[tuple[Unit, bool]]:
    """Units of a section in order, and whether each is a part of an overlong one. Captions that no block takes come last."""
    captions = _captions(blocks)
    taken = {c["block_id"] for cs in captions.values() for c in cs}
    free = [b for b in blocks if b["block_type"] == "caption" and b["block_id"] not in taken]
    for block, own in [(b, captions.get(k, [])) for k, b in enumerate(blocks) if b["block_type"] != "caption"] + [(b, []) for b in free]:
        unit = _bound(block, own)
        if unit.tokens > room:
            yield from ((u, True) for u in _fragments(block, own, room))
        else:
            yield unit, False


def _filled(units: Iterator[tuple[Unit, bool]], room: int, target: int, soft: int) -> Iterator[list[Unit]]:
    held: list[Unit] = []
    size = 0
    for unit, part in units:
        over = size + unit.tokens
        if held and (part or over > room or (over > soft and size >= target)):
            yield held
            held, size = [], 0
        if part:
            yield [unit]
        else:
            held.append(unit)
            size += unit.tokens
    if held:
        yield held


def _prefix(path: list[str], hard: int) -> tuple[str, bool]:
    """Titles joined, as many leading ones as stay under the limit, one at least; a first title that leaves no room gives
    way to the text: it is cut to half of the limit."""
    kept, size = 0, 0
    for title in path:
        size += count_tokens(title)
        if kept and size >= hard:
            break
        kept += 1
    text = " > ".join(path[:kept])
    if count_tokens(text) >= hard:
        return text[: split_overlong(text, max(1, hard // 2))[0][1]].strip(), True
    return text, kept < len(path)


def chunk_blocks(blocks: list[dict], target: int = TARGET, soft: int = SOFT, hard: int = HARD) -> Iterator[dict]:
    """Chunks of one document's blocks, in order of its sections' first blocks."""
    sections: dict[str | None, list[dict]] = {}
    for b in blocks:
        sections.setdefault(b["section_id"], []).append(b)
    number = 0
    for section, own in sections.items():
        path = [t or "" for t in own[0]["section_path"] or []]
        prefix, compacted = _prefix(path, hard)
        room = max(1, hard - count_tokens(prefix))
        for units in _filled(_units(own, room), room, target, soft):
            number += 1
            body = "\n\n".join(u.text for u in units)
            rows = [u.rows for u in units if u.rows]
            told = [u.caption for u in units if u.caption]
            yield {
                "chunk_no": number,
                "section_id": section,
                "section_path": path,
                "pages": sorted({p for u in units for p in u.pages}),
                "source_refs": [{"block_id": i, "char_start": s, "char_end": e} for u in units for i, s, e in u.refs],
                "body_text": body,
                "context_prefix": prefix,
                "prefix_compacted": compacted,
                "token_count": count_tokens(prefix) + count_tokens(body),
                "block_types": list(dict.fromkeys(t for u in units for t in u.types)),
                "table_row_start": rows[0][0] if rows else None,
                "table_row_end": rows[-1][1] if rows else None,
                "caption_text": "\n\n".join(dict.fromkeys(told)) if told else None,
            }


def chunk_documents(docs: DataFrame, key: str, blocks: str = "blocks", target: int = TARGET, soft: int = SOFT, hard: int = HARD, columns: list[str] | None = None) -> DataFrame:
    """A row a chunk: key and the columns of CHUNK (or those of `columns`). docs has key and blocks, an array of structs
    with the fields of BLOCK in reading order; fields that it lacks count as null, other columns play no part.

    Chunks stay within a section, do not overlap, are closed at `soft` tokens once they have `target`, and hold `hard` at
    most, section path included; overlong tables are cut between rows under a repeated header, other blocks at sentence
    ends, else into equal shares of characters, of which one can exceed the limit where tokens lie unevenly, as can a
    table's row that is too long by itself. Null arrays and documents without blocks give no chunk; null texts are empty.
    """
    kind = dict(docs.dtypes)[key]
    wanted = columns or [c.split()[0] for c in CHUNK.replace("<block_id: string, char_start: int, char_end: int>", "").split(", ")]
    names = [f.split()[0] for f in BLOCK.split(", ")]
    full = docs.sparkSession.createDataFrame([], f"{key} {kind}, {CHUNK}").select(key, *wanted).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for batch in batches:
            for i in range(batch.num_rows):
                given = [{n: b.get(n) for n in names} for b in batch.column(1)[i].as_py() or [] if b is not None]
                rows = list(chunk_blocks(given, target, soft, hard))
                if rows:
                    same = pa.array([batch.column(0)[i].as_py()] * len(rows), arrow.field(0).type)
                    yield pa.RecordBatch.from_arrays([same, *[pa.array([r[c] for r in rows], arrow.field(c).type) for c in wanted]], schema=arrow)

    return docs.select(key, blocks).mapInArrow(run, full)
