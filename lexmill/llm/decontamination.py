"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words become templates: numbers (in digits or words), units after numbers, and names (capitalised within a sentence) turn
into typed placeholders, other words lose case and outer punctuation. Windows of `width` template words are hashed and
joined with those of the benchmark, which are indexed twice: with its names as placeholders, and with them as plain words,
as a copy in capitals or small letters has them. A document leaks an item if enough windows of the item occur in it over slots that are consistent
along their alignment (a window over a slot that is not does not count): wherever the item repeats a number, unit or name, the document repeats what stands for it there. So an item
with other numbers is caught, a table of numbers is not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

WIDTH = 8
LITERAL = 4  # words of a window that are no placeholders, at least
MIN_WINDOWS = 6  # windows of an item: 13 words in a row
MIN_SHARE = 0.5  # or this share of a short item's
MAX_BROADCAST = 1_000_000  # windows of the benchmark
MAX_BROADCAST_TEXTS = 500_000  # keys of texts with enough windows

# Units that make a slot after a number.
UNITS = ["mm", "cm", "m", "km", "g", "kg", "mg", "t", "l", "ml", "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "a", "j", "kj", "n", "pa", "kpa", "c", "f", "k", "percent", "meters", "metres", "miles", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "dollars", "euros", "cents", "litres", "liters", "grams", "kilograms"]
NUMBER_WORDS = ["two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen"]
SLOTS = ["#number", "#unit", "#name"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def bare(w: Column) -> Column:
    """A word in small letters without outer punctuation."""
    return F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def template(raw: Column) -> Column:
    """The template word of each raw word, by the word before it."""

    def number(w: Column) -> Column:
        return w.rlike(r"^[^\p{L}\p{N}]*\p{N}[^\p{L}]*(" + "|".join(UNITS) + r")?[^\p{L}\p{N}]*$") | bare(w).isin(NUMBER_WORDS)

    def one(w: Column, i: Column, ws: Column) -> Column:
        before = F.get(ws, i - 1)
        unit = bare(w).isin(UNITS) & F.coalesce(number(before), F.lit(False))
        name = w.rlike(r"^\p{Lu}\p{Ll}") & F.coalesce(before.rlike(r"[\p{L}\p{N},;)]$"), F.lit(False))
        # Most words are plain; they must not pay for what the rest needs.
        plain = w.rlike(r"^\p{Ll}+[.,]?$")
        return F.when(plain & ~F.rtrim(w, F.lit(".,")).isin(UNITS + NUMBER_WORDS), F.rtrim(w, F.lit(".,"))).when(number(w), SLOTS[0]).when(unit, SLOTS[1]).when(name, SLOTS[2]).otherwise(bare(w))

    return let(raw, lambda ws: F.transform(ws, lambda w, i: one(w, i, ws)))


def windows(t: Column, width: int) -> Column:
    """Hash of each window of template words; a shorter text is one window."""
    return let(t, lambda c: F.when(F.size(c) == 0, F.array().cast("array<bigint>")).when(F.size(c) < width, F.array(F.xxhash64(c))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(c, i, width)))))


def _indexed(words_: Column, width: int) -> Column:
    """Position and hash of each window of template words with enough of them plain."""
    plain = lambda i: F.size(F.filter(F.slice(words_, i + 1, width), lambda w: ~w.isin(SLOTS) & (w != "")))
    return F.filter(F.transform(windows(words_, width), lambda h, i: F.struct(i.alias("i_pos"), h.alias("h"))), lambda z: plain(z["i_pos"]) >= F.least(F.lit(LITERAL), F.size(words_)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, item_id, windows, coverage, slots, changed: one row for each leaked item of each text of an id.

    text_hash is xxhash64 of the text, so that rows which repeat an id, or lack one, can be told apart by it.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("i_raw")).where("item_id is not null")
    items = items.select("item_id", "i_raw", template(F.col("i_raw")).alias("i_words"))
    spelt = F.zip_with("i_raw", "i_words", lambda r, w: F.when(w == SLOTS[2], bare(r)).otherwise(w))
    spread = items.withColumn("spelt", spelt).select("item_id", F.array_distinct(F.concat(_indexed(F.col("i_words"), width), _indexed(F.col("spelt"), width))).alias("all"))
    spread = spread.select("item_id", F.size(F.array_distinct(F.col("all.i_pos"))).alias("i_windows"), F.explode("all").alias("z")).select("item_id", "i_windows", "z.i_pos", "z.h")
    few = spread.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    cut = own.select("doc_id", "text_hash", F.posexplode(windows(template(words(F.col("text"))), width)).alias("pos", "h"))
    hits = cut.join(F.broadcast(spread) if few else spread, "h")
    each = hits.groupBy("doc_id", "text_hash", "item_id", "i_windows", (F.col("pos") - F.col("i_pos")).alias("shift")).agg(F.collect_set("i_pos").alias("found"))
    enough = F.least(F.lit(MIN_WINDOWS), F.ceil(F.col("i_windows") * MIN_SHARE))
    likely = each.groupBy("doc_id", "text_hash", "item_id", "i_windows").agg(F.collect_list(F.struct("shift", "found")).alias("lines"))
    likely = saved(likely.where(F.size(F.array_distinct(F.flatten(F.col("lines.found")))) >= enough))
    # Slots of each alignment, under the windows found alone, from the texts that have one: the others stay where they are.
    keys = likely.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    keys = F.broadcast(keys) if keys.limit(MAX_BROADCAST_TEXTS + 1).count() <= MAX_BROADCAST_TEXTS else keys
    texts = own.join(keys, own.doc_id.eqNullSafe(F.col("k_id")) & (own.text_hash == F.col("k_hash")), "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"), "text")
    lines = likely.select("doc_id", "text_hash", "item_id", "i_windows", F.inline("lines")).join(items, "item_id")
    pairs = lines.join(texts, lines.doc_id.eqNullSafe(F.col("t_id")) & (lines.text_hash == F.col("t_hash"))).withColumn("raw", words(F.col("text")))
    under = F.array_distinct(F.flatten(F.transform("found", lambda i: F.sequence(i, i + (width - 1)))))
    slot = lambda p: F.struct(p.alias("p"), F.get("i_words", p).alias("kind"), bare(F.get("i_raw", p)).alias("theirs"), bare(F.get("raw", p + F.col("shift"))).alias("mine"))
    slots = F.transform(F.filter(under, lambda p: F.get("i_words", p).isin(SLOTS)), slot)
    seen = pairs.select("doc_id", "text_hash", "item_id", "i_windows", "found", slots.alias("slots")).withColumn("kinds", F.array_distinct(F.transform("slots", lambda z: F.struct(z["kind"], z["theirs"], z["mine"]))))
    consistent = F.size(F.array_distinct(F.transform("kinds", lambda z: F.struct(z["kind"], z["theirs"])))) == F.size("kinds")
    changed = F.size(F.filter("slots", lambda z: ~z["theirs"].eqNullSafe(z["mine"])))
    clash = lambda z: F.exists("kinds", lambda y: (y["kind"] == z["kind"]) & (y["theirs"] == z["theirs"]) & ~y["mine"].eqNullSafe(z["mine"]))
    over = lambda p, i: p.between(i, i + (width - 1))
    # Only the windows over a slot that clashes go, and the slots that no window is left over.
    seen = seen.withColumn("whole", consistent).withColumn("bad", F.when(F.col("whole"), F.array().cast("array<int>")).otherwise(F.transform(F.filter("slots", clash), lambda z: z["p"])))
    seen = seen.withColumn("found", F.when(F.col("whole"), F.col("found")).otherwise(F.filter("found", lambda i: ~F.exists("bad", lambda p: over(p, i)))))
    seen = seen.withColumn("slots", F.when(F.col("whole"), F.col("slots")).otherwise(F.filter("slots", lambda z: F.exists("found", lambda i: over(z["p"], i)))))
    good = seen.where(F.size("found") > 0).select("doc_id", "text_hash", "item_id", "i_windows", "found", F.size("slots").alias("slots"), changed.alias("changed"))
    total = good.groupBy("doc_id", "text_hash", "item_id", "i_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("windows"), F.max("slots").cast("long").alias("slots"), F.min("changed").cast("long").alias("changed"))
    return total.where(F.col("windows") >= enough).select("doc_id", "text_hash", "item_id", "windows", F.round(F.col("windows") / F.col("i_windows"), 6).alias("coverage"), "slots", "changed")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, windows, coverage, slots, changed: one row for each leaked item of each document.

    windows counts distinct windows of the item found, coverage is their share of those indexed, slots the placeholders
    they span and changed those whose value differs. Texts of fewer than `width` words are one window and match only as a
    whole. Null and empty texts, null ids and windows of mostly placeholders match nothing. The texts of rows that repeat
    an id are judged each alone, and the one with most windows of an item stands for it; repeated items and equal items
    each count.
    """
    found = leaks(docs.where(F.col(id_col).isNotNull()), benchmark, id_col, text_col, item_col, item_text_col, width)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("windows", "coverage", "slots", "changed", "text_hash")).alias("z"))
    return best.select("doc_id", "item_id", "z.windows", "z.coverage", "z.slots", "z.changed")
