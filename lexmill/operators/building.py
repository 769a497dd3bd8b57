"""Building documents from parsed items: sections, captions, contexts of chunks, first pages, and the state of a parse.

Orders within a document must be unique; a document's rows meet in one window, so what is held at once is a document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import layout as L
from lexmill.functions import text as T

# Kinds of blocks, limits of a good parse, and the confidence of each source of metadata.
BLOCK_TYPES = ["paragraph", "heading", "list", "table", "figure", "caption", "equation", "footnote", "other"]
STRUCTURED = ["table", "figure", "equation"]
PAGE_CHARS, FAILED_PAGES, POOR_PAGES, REPLACED, REPEATED, LONG_PAPER = 10, 0.05, 0.80, 0.01, 0.15, 4
CONFIDENCE = {"identifier": 0.95, "file name": 0.9, "title": 0.8, "author": 0.6, "year": 0.5, "abstract": 0.4}
TITLE_LINES, AUTHOR_LINES = 4, 40
ARXIV_PATTERN = r"(?i)arxiv:\s*([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"


def section_stack(blocks: DataFrame, by: str = "paper_id", order: str = "order") -> DataFrame:
    """blocks (by, order, block_type, level) with section_id, the order of the heading they stand under (null ahead of the
    first), and on headings parent_id, the order of the nearest heading before with a smaller level. A null level is 1."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("block_type") == "heading"
    under = blocks.withColumn("section_id", F.last(F.when(head, F.col(order)), ignorenulls=True).over(so_far))
    kind = dict(blocks.dtypes)[order]
    heads = blocks.where(head).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("level", F.lit(1)).cast("int").alias("l")))).alias("hs"))
    empty = F.struct(F.array().cast(f"array<struct<o:{kind},l:int>>").alias("open"), F.array().cast(f"array<struct<o:{kind},p:{kind}>>").alias("done"))

    def push(state: Column, h: Column) -> Column:
        above = F.filter(state["open"], lambda s: s["l"] < h["l"])  # levels rise along the stack
        parent = F.try_element_at(above, F.lit(-1))["o"]
        return F.struct(F.array_append(above, h).alias("open"), F.array_append(state["done"], F.struct(h["o"].alias("o"), parent.alias("p"))).alias("done"))

    parents = heads.select(by, F.explode(F.aggregate("hs", empty, push, lambda s: s["done"])).alias("z")).select(by, F.col("z.o").alias(order), F.col("z.p").alias("parent_id"))
    return under.join(parents, [by, order], "left")


def link_captions(blocks: DataFrame, by: str = "paper_id", order: str = "order") -> DataFrame:
    """blocks (by, order, block_id, block_type) with parent_block_id on captions and caption_block_ids on what they caption:
    a caption belongs to the table, figure or equation before it with only captions between. Others have null and []."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("block_type") != "caption", F.struct("block_id", "block_type")), ignorenulls=True).over(before)
    linked = blocks.withColumn("_last", last).withColumn("parent_block_id", F.when((F.col("block_type") == "caption") & F.col("_last.block_type").isin(STRUCTURED), F.col("_last.block_id"))).drop("_last")
    kind = dict(blocks.dtypes)["block_id"]
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("block_id").alias("b")))), lambda s: s["b"])
    lists = linked.where("parent_block_id is not null").groupBy(by, F.col("parent_block_id").alias("block_id")).agg(ids.alias("caption_block_ids"))
    return linked.join(lists, [by, "block_id"], "left").withColumn("caption_block_ids", F.coalesce("caption_block_ids", F.array().cast(f"array<{kind}>")))


def bind_captions(blocks: DataFrame) -> DataFrame:
    """paper_id, block_id, captions: the units that blocks (paper_id, block_id, block_type, order, caption_block_ids,
    parent_block_id) make. A structured block takes the captions of its own list in their order; where none of them exists,
    those that point to it. A caption that no block takes is a unit itself, as is any other block."""
    captions = blocks.where("block_type = 'caption'").select("paper_id", F.col("block_id").alias("c"), F.col("order").alias("o"), F.col("parent_block_id").alias("points"))
    held = blocks.where(F.col("block_type").isin(STRUCTURED))
    listed = held.select("paper_id", "block_id", F.explode("caption_block_ids").alias("c")).distinct().join(captions.drop("points"), ["paper_id", "c"])
    rest = held.select("paper_id", "block_id").join(listed.select("paper_id", "block_id").distinct(), ["paper_id", "block_id"], "left_anti")
    pointed = rest.join(captions.withColumnRenamed("points", "block_id"), ["paper_id", "block_id"])
    bound = listed.select("paper_id", "block_id", "c", "o").unionByName(pointed.select("paper_id", "block_id", "c", "o"))
    lists = bound.groupBy("paper_id", "block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda s: s["c"]).alias("captions"))
    taken = bound.select("paper_id", F.col("c").alias("block_id")).distinct()
    kind = dict(blocks.dtypes)["block_id"]
    units = blocks.select("paper_id", "block_id").join(taken, ["paper_id", "block_id"], "left_anti")
    return units.join(lists, ["paper_id", "block_id"], "left").withColumn("captions", F.coalesce("captions", F.array().cast(f"array<{kind}>")))


def compact_prefix(path: Column, most: int) -> Column:
    """(items, compacted) of a section path: all of it if it has fewer than `most` tokens, else as many leading items as do,
    one at least. A null or empty path: none, not compacted. Null titles have no token."""
    path = F.coalesce(path, F.array().cast("array<string>"))
    sizes = F.transform(path, lambda p: F.coalesce(T.token_count(p), F.lit(0)))
    running = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda s, x: s + x))
    fitting = F.size(F.filter(running, lambda r: r < most))
    whole = fitting == F.size(path)
    return F.struct(F.when(whole, path).otherwise(F.slice(path, 1, F.greatest(F.lit(1), fitting))).alias("items"), (~whole).alias("compacted"))


def trim_tokens(text: Column, budget: Column) -> Column:
    """The longest beginning of text that has at most `budget` tokens, cut before the next token begins."""
    word, cjk = r"[A-Za-z0-9]++(?:['\-][A-Za-z0-9]++)*+", T.CJK
    gap = r"[^A-Za-z0-9\u4e00-\u9fff\u3040-\u30ff]*+"
    pattern = F.concat(F.lit(rf"^(?:{gap}(?:{word}|{cjk})){{0,"), F.greatest(budget, F.lit(0)).cast("string"), F.lit(rf"}}+{gap}"))
    return F.when(text.isNull() | (T.token_count(text) <= budget), text).otherwise(F.coalesce(F.regexp_substr(text, pattern), F.lit("")))  # of an empty match it gives null


def chunk_context(chunks: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """chunks (paper_id, section_id, body_text) with the path of their section (paths: paper_id, section_id, path) as
    context_prefix, compacted, body_text trimmed to what is left of `most` tokens, retrieval_text and token_count. A chunk
    without a section or path has no prefix."""
    both = chunks.join(paths.select("paper_id", "section_id", "path"), ["paper_id", "section_id"], "left").withColumn("_p", compact_prefix(F.col("path"), most))
    both = both.withColumn("context_prefix", F.array_join("_p.items", " > ")).withColumn("compacted", F.col("_p.compacted")).drop("_p", "path")
    left = F.greatest(F.lit(1), most - T.token_count(F.col("context_prefix")))
    both = both.withColumn("body_text", trim_tokens(F.col("body_text"), left))
    whole = F.when(F.col("context_prefix") == "", F.col("body_text")).otherwise(F.concat_ws("\n\n", "context_prefix", "body_text"))
    return both.withColumn("retrieval_text", whole).withColumn("token_count", T.token_count(F.col("retrieval_text")))


def parse_validation(parses: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """paper_id, status, failed, degraded: names of the signals that are not well.

    parses: paper_id, parser_status, has_document, source_pages, page_count, quality (array of words); blocks: paper_id,
    block_id, block_type, position, order, text, pages; sections: paper_id, section_id, parent_section_id,
    heading_block_id. A parser's failure or a missing document is the only signal then; without any page number the share
    of pages with text is unknown, which fails nothing but degrades the parse. A paper without blocks has failed.
    """
    here = Window.partitionBy("paper_id").orderBy("position")
    text, pages = F.coalesce("text", F.lit("")), F.coalesce("pages", F.array().cast("array<int>"))
    b = blocks.select("paper_id", "block_id", "block_type", text.alias("text"), pages.alias("pages"), F.col("order"), F.lag("order").over(here).alias("_before"), F.lag("position").over(here).isNotNull().alias("_later"), F.coalesce(F.get(pages, F.lit(0)), F.lit(0)).alias("_page"))
    b = b.withColumn("_jump", F.coalesce(F.col("_page") < F.lag("_page").over(Window.partitionBy("paper_id").orderBy("order")), F.lit(False)))
    legal = F.coalesce((F.col("block_id") != "") & F.col("block_type").isin(BLOCK_TYPES), F.lit(False))
    per = b.groupBy("paper_id").agg(
        F.count("*").alias("blocks"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\ufffd"), F.lit("")))).alias("replaced"),
        F.count_if(F.size("pages") > 0).alias("paged"),
        F.count_if(F.col("_later") & ~F.coalesce(F.col("order") > F.col("_before"), F.lit(False))).alias("unordered"),
        F.count_if("_jump").alias("jumps"),
        F.count_if(~legal).alias("illegal"),
        F.min(F.array_min("pages")).alias("first_page"),
        F.max(F.array_max("pages")).alias("last_page"),
        F.count_if(F.col("text").rlike(r"(?i)\b(?:table|tab\.?|figure|fig\.?|eq\.?)\s*\d")).alias("hints"),
        F.count_if(F.col("block_type").isin("table", "figure", "caption")).alias("structured"),
    )
    by_page = b.select("paper_id", "text", F.explode("pages").alias("page")).groupBy("paper_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    in_range = by_page.join(parses.select("paper_id", "page_count"), "paper_id").where(F.col("page").between(F.lit(1), F.col("page_count")))
    covered = in_range.groupBy("paper_id").agg(F.count_if(F.col("chars") >= PAGE_CHARS).alias("meaningful"), F.count_if(F.col("chars") > 0).alias("filled"))
    norm = T.collapse(F.col("text"))
    repeats = b.select("paper_id", norm.alias("n")).where("n <> ''").groupBy("paper_id", "n").count().groupBy("paper_id").agg(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias("repeated"))
    no_head = sections.select("paper_id", F.col("heading_block_id").alias("block_id")).join(blocks.select("paper_id", "block_id"), ["paper_id", "block_id"], "left_anti")
    no_parent = sections.where("parent_section_id is not null").select("paper_id", F.col("parent_section_id").alias("section_id")).join(sections.select("paper_id", "section_id"), ["paper_id", "section_id"], "left_anti")
    dangling = no_head.select("paper_id").unionByName(no_parent.select("paper_id")).groupBy("paper_id").agg(F.count("*").alias("dangling"))
    counted = sections.groupBy("paper_id").agg(F.count("*").alias("sections"))
    p = parses
    for part in (per, covered, repeats, dangling, counted):
        p = p.join(part, "paper_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    known = n("paged") > 0
    ratio = F.when(n("page_count") <= 0, F.when(n("blocks") > 0, 1.0).otherwise(0.0)).when((n("blocks") > 0) & ~known, F.lit(None)).otherwise(n("meaningful") / F.col("page_count"))
    names = lambda pairs: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in pairs]))
    hard = [
        ("page_count", (n("source_pages") > 0) & (F.col("source_pages") != n("page_count"))),
        ("near_empty_body", (n("blocks") == 0) | (ratio < FAILED_PAGES)),
        ("reading_order", n("unordered") > 0),
        ("provenance_legal", (F.col("first_page") < 1) | ((n("page_count") > 0) & (F.col("last_page") > F.col("page_count")))),
        ("structure_valid", (n("illegal") > 0) | (n("dangling") > 0)),
    ]
    soft = [
        ("meaningful_text_page_ratio", ratio < POOR_PAGES),
        ("provenance_missing", (n("blocks") > 0) & ~known),
        ("replacement_char_ratio", n("replaced") > REPLACED * n("chars")),
        ("suspicious_duplicate_ratio", n("repeated") > REPEATED * n("blocks")),
        ("zero_headings", (n("page_count") > LONG_PAPER) & (n("sections") == 0)),
        ("empty_body_pages", known & (n("page_count") - n("filled") >= 2)),
        ("parser_quality", F.exists(F.coalesce("quality", F.array().cast("array<string>")), lambda q: F.lower(T.strip(q)).isin("poor", "low", "failed"))),
        ("structure_missing", (n("hints") > 0) & (n("structured") == 0)),
        ("reading_order_jumps", n("jumps") > 1),
    ]
    broken = F.col("parser_status").isin("error", "dependency_missing", "parser_unavailable")
    failed = F.when(broken, F.array(F.lit("parser_status"))).when(~F.coalesce("has_document", F.lit(False)), F.array(F.lit("canonical_document"))).otherwise(names(hard))
    out = p.select("paper_id", failed.alias("failed"), names(soft).alias("degraded"))
    out = out.withColumn("degraded", F.when(F.size("failed") > 0, F.array().cast("array<string>")).otherwise(F.col("degraded")))
    return out.select("paper_id", F.when(F.size("failed") > 0, "failed").when(F.size("degraded") > 0, "degraded").otherwise("passed").alias("status"), "failed", "degraded")


def title_quality(c: Column) -> Column:
    """Whether a text can be a title: 5 to 500 characters, no address, mail, DOI, page furniture or closing full stop."""
    t = T.strip(c)
    good = F.length(t).between(5, 500) & ~t.rlike(r"^(https?|file)://|@|(?i:\bdoi\b)|\.$") & (L.line_kind(t) == "text") & (T.normalize_title(t, fold=False) != "")
    return F.coalesce(good, F.lit(False))


def author_quality(c: Column) -> Column:
    """Whether a text can be an author's name: 2 to 200 characters, a Latin letter, no mail or page furniture."""
    t = T.strip(c)
    return F.coalesce(F.length(t).between(2, 200) & (L.line_kind(t) == "text") & ~t.contains("@") & t.rlike("[A-Za-z]"), F.lit(False))


def author_like(c: Column) -> Column:
    """Whether a line looks like names: a list by commas, semicolons or `and`, a word with a raised number, or a first and
    a last name alone, each with a capital, followed by marks (numbers, stars, a letter) or nothing."""
    words = F.filter(F.split(T.strip(c), r"\s+"), lambda w: w != "")
    bare = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"(\(\w\)|[\d*†‡#])+$", "")), lambda w: w != "")
    capital = lambda w: (F.length(w) > 1) & (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) & (F.translate(w, "'.-0123456789", "'.-") == w)
    listed = c.contains(",") | c.contains(";") | (F.array_position(F.transform(words, F.lower), "and") > 1) & (F.lower(F.get(words, F.size(words) - 1)) != "and")
    raised = F.exists(words, lambda w: (F.length(w) > 1) & F.substring(w, -1, 1).between("0", "9") & ~F.substring(w, 1, 1).between("0", "9"))
    marked = (F.size(bare) == 2) | ((F.size(bare) == 3) & (F.length(F.get(bare, F.size(bare) - 1)) == 1) & (F.get(bare, F.size(bare) - 1) == F.lower(F.get(bare, F.size(bare) - 1))))
    pair = marked & F.forall(F.slice(bare, 1, 2), capital)
    return F.when(F.size(words) > 0, F.coalesce(listed | raised | pair, F.lit(False))).otherwise(F.lit(False))


def first_page(lines: DataFrame) -> DataFrame:
    """paper_id, title, authors of the lines (paper_id, pos, line) of first pages.

    The title begins at the first line of text and runs for four lines at most, up to a blank line, furniture, an abstract,
    an affiliation or names; null if it is no good title. Authors follow, up to the abstract or an affiliation, or to a
    blank line after the first of them. A page without a title has none.
    """
    whole = Window.partitionBy("paper_id")
    line = T.strip(F.col("line"))
    kind = F.when(F.coalesce(F.length(line) < 3, F.lit(True)), "blank").otherwise(L.line_kind(line))
    x = lines.select("paper_id", "pos", line.alias("line"), kind.alias("kind"))
    x = x.withColumn("_start", F.min(F.when(~F.col("kind").isin("blank", "noise", "abstract"), F.col("pos"))).over(whole))
    ends = (F.col("pos") > F.col("_start")) & ((F.col("kind") != "text") | author_like(F.col("line")))
    x = x.withColumn("_end", F.least(F.min(F.when(ends, F.col("pos"))).over(whole), F.col("_start") + TITLE_LINES))
    x = x.withColumn("_names", F.min(F.when((F.col("pos") >= F.col("_end")) & (F.col("kind") == "text"), F.col("pos"))).over(whole))
    stops = (F.col("pos") >= F.col("_end")) & (F.col("kind").isin("abstract", "affiliation") | ((F.col("pos") > F.col("_names")) & (F.col("kind") != "text")) | (F.col("line").endswith(".") & (F.length("line") > 120)))
    x = x.withColumn("_stop", F.least(F.min(F.when(stops, F.col("pos"))).over(whole), F.col("_names") + AUTHOR_LINES))
    ordered = lambda cond, value: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("pos").alias("o"), value.alias("v"))))), lambda s: s["v"])
    in_title = (F.col("pos") >= F.col("_start")) & (F.col("pos") < F.coalesce("_end", F.col("_start") + TITLE_LINES))
    in_names = (F.col("pos") >= F.col("_names")) & (F.col("pos") < F.coalesce("_stop", F.col("_names") + AUTHOR_LINES))
    g = x.groupBy("paper_id").agg(ordered(in_title, F.col("line")).alias("t"), ordered(in_names, L.split_authors(F.col("line"))).alias("a"))
    last = F.size("t") - 1
    joined = F.array_join(F.transform("t", lambda s, i: F.when(i < last, F.regexp_replace(s, "[-\u00ad]$", "")).otherwise(s)), " ")
    title = F.btrim(joined, F.lit(" ,;:"))
    good = title_quality(title)
    names = F.filter(F.transform(F.flatten("a"), lambda s: F.btrim(s, F.lit(" ,;:"))), author_quality)
    return g.select("paper_id", F.when(good, title).alias("title"), F.when(good, names).otherwise(F.array().cast("array<string>")).alias("authors"))


def abstract(c: Column) -> Column:
    """The lines under a line `Abstract` (blank ones ahead passed over) up to a blank line, an introduction or the first
    numbered heading, single-spaced; null where none of these follows, or with 30 characters or less."""
    lines = F.split(c, "\n")
    below = lambda at, of: F.slice(of, at + 1, F.size(of))
    head = F.array_position(F.transform(lines, lambda s: F.lower(F.regexp_replace(s, r"[\s.:]+", "")) == "abstract"), True).cast("int")
    rest = below(head, lines)
    blank = F.transform(rest, lambda s: T.strip(s) == "")
    body = below(F.greatest(F.array_position(blank, False).cast("int") - 1, F.lit(0)), rest)
    word = lambda s: F.lower(F.get(F.split(T.strip(s), r"[\s.]"), F.lit(0)))
    ends = F.transform(body, lambda s: (T.strip(s) == "") | F.lower(T.strip(s)).startswith("introduction") | ((word(s) == "1") & (T.strip(s) != "1")) | T.strip(s).startswith("I."))
    stop = F.array_position(ends, True).cast("int")
    text = T.collapse(F.array_join(F.slice(body, 1, F.greatest(stop - 1, F.lit(0))), " "))
    found = (head > 0) & F.coalesce(F.array_contains(blank, False), F.lit(False))
    return F.when(found & (stop > 1) & (F.length(text) > 30), text)


def metadata_candidates(files: DataFrame) -> DataFrame:
    """file_id, field, value, source, confidence: what each file (file_id, title, author, keywords, text, file_name) says of
    itself. Nulls and blanks give no row; repeated files give theirs each."""
    ids = lambda c: (T.normalize_doi(T.first_match(c, T.DOI_PATTERN)), F.nullif(F.regexp_extract(c, ARXIV_PATTERN, 1), F.lit("")))
    key_doi, key_arxiv = ids(F.col("keywords"))
    text_doi, text_arxiv = ids(F.col("text"))
    stem = F.regexp_extract(F.col("file_name"), r"^(?:(?i)arxiv[:_-]?)?([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)(?:\.[^.0-9][^.]*)?$", 1)
    row = lambda field, value, source, kind: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(source).alias("source"), F.lit(CONFIDENCE[kind]).alias("confidence"))
    single = F.array(
        row("title", F.when(T.normalize_title(F.col("title"), fold=False).isNotNull(), T.strip(F.col("title"))), "metadata.title", "title"),
        row("doi", key_doi, "metadata.keywords", "identifier"),
        row("arxiv_id", key_arxiv, "metadata.keywords", "identifier"),
        row("doi", text_doi, "first_pages_text", "identifier"),
        row("arxiv_id", text_arxiv, "first_pages_text", "identifier"),
        row("publication_year", F.nullif(F.regexp_extract("text", r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")), "first_pages_text", "year"),
        row("abstract", abstract(F.col("text")), "first_pages_text", "abstract"),
        row("arxiv_id", F.when(T.valid_arxiv(stem), stem), "file_name", "file name"),
    )
    people = F.transform(F.coalesce(L.split_authors(F.col("author")), F.array().cast("array<string>")), lambda a: row("author", a, "metadata.author", "author"))
    return files.select("file_id", F.explode(F.concat(single, people)).alias("c")).select("file_id", "c.*").where("value is not null")
