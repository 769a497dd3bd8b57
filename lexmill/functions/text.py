"""Column functions on bibliographic and document text."""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Dashes that separate words, punctuation stripped from the ends, prefixes of a DOI.
DASHES = "-‐‑‒–—―−"
EDGE = ".,;:!?\"'()[]{}"
DOI_PREFIXES = ["https://doi.org/", "http://dx.doi.org/", "https://dx.doi.org/", "doi:"]
CJK = "[\\u4e00-\\u9fff\\u3040-\\u30ff]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


def collapse(c: Column) -> Column:
    """White space of any length to one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def _folded(c: Column) -> Column:
    """NFKC only where it can change something: ASCII text stays in the JVM's generated code."""
    return F.when(_ascii(c), c).otherwise(nfkc(F.when(~_ascii(c), c)))


def normalize_title(c: Column, fold: bool = True) -> Column:
    """Lower case, dashes to spaces, single spaces, no punctuation at the ends; null if nothing is left."""
    c = F.lower(_folded(c) if fold else c)
    return _blank_to_null(F.btrim(collapse(F.regexp_replace(c, f"[{DASHES}]+", " ")), F.lit(EDGE)))


def normalize_author(c: Column, fold: bool = True) -> Column:
    return _blank_to_null(F.btrim(collapse(F.lower(_folded(c) if fold else c)), F.lit(EDGE)))


def normalize_doi(c: Column) -> Column:
    """Lower case, the first fitting prefix off, no punctuation at the end."""
    prefix = "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES)
    return _blank_to_null(F.rtrim(strip(F.regexp_replace(F.lower(strip(c)), f"^({prefix})", "")), F.lit(".,;:")))


def normalize_arxiv(c: Column) -> Column:
    return _blank_to_null(strip(F.regexp_replace(F.lower(strip(c)), "^arxiv:", "")))


def valid_arxiv(c: Column) -> Column:
    """New-style id YYMM.NNNN(N) with a month of 01 to 12, version optional."""
    return F.coalesce(normalize_arxiv(c).rlike(r"^[0-9]{2}(0[1-9]|1[0-2])\.[0-9]{4,5}(v[0-9]+)?$"), F.lit(False))


def plausible_year(c: Column, now_year: int) -> Column:
    y = F.expr("null") if c is None else c.cast("string")
    return F.coalesce(F.trim(y).try_cast("int").between(1900, now_year + 1), F.lit(False))


def first_match(c: Column, pattern: str) -> Column:
    """First match of a pattern in text, null if none."""
    return _blank_to_null(F.regexp_extract(c, pattern, 0))


DOI_PATTERN = r"10\.[0-9]{4,9}/[^\s\"<>]+"


def clean_text(c: Column) -> Column:
    """Control characters to spaces, soft hyphens out, words broken at a line's end joined, single spaces."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    c = F.regexp_replace(c, "­", "")
    c = F.regexp_replace(c, r"([A-Za-z])-\s+(?=[a-z])", "$1")
    return collapse(c)


def token_count(c: Column) -> Column:
    """Latin words (with inner apostrophes and hyphens) and each CJK or kana character count one."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+(?:['\-][A-Za-z0-9]+)*"), F.lit(0))) + F.size(F.regexp_extract_all(c, F.lit(CJK), F.lit(0)))


def bm25_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def word_set(c: Column) -> Column:
    """Distinct letter-and-digit words under NFKC and case folding; plain ASCII text stays in the JVM."""
    folded = F.when(_ascii(c), F.lower(c)).otherwise(nfkc_casefold(F.when(~_ascii(c), c)))
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def run_hashes(size: int):
    """A function of token arrays: a 64-bit hash of each run of size tokens, in order. Equal runs have equal hashes; that runs of
    one hash are equal is for the caller to check."""

    @F.arrow_udf("array<long>")
    def hashes(tokens: pa.Array) -> pa.Array:
        coded = tokens.flatten().dictionary_encode()
        h = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)[coded.indices.to_numpy()]
        runs = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for j in range(size):
            runs += h[j : j + len(runs)] * np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64))
        many = pc.fill_null(tokens.value_lengths(), 0).to_numpy().astype(np.int64)
        held = np.maximum(0, many - size + 1)
        ends = np.cumsum(held)
        at = np.arange(held.sum()) + np.repeat(np.cumsum(many) - many - ends + held, held)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(runs[at].view(np.int64)))

    return hashes


def entity_key(c: Column) -> Column:
    """Identity key of an entity name; empty if it holds no letter or digit."""
    c = F.regexp_replace(nfkc_casefold(c), "[‐‑‒–—―−]", "-")
    c = collapse(F.regexp_replace(c, "[·•‧・|/_]+", " "))
    return F.when(c.rlike(r"[\p{L}\p{N}]"), c).otherwise("")


def stable_id(kind: str, *parts: Column) -> Column:
    """kind_ and the SHA-256 of kind and parts joined by the unit separator."""
    return F.concat(F.lit(f"{kind}_"), F.sha2(F.concat_ws("\x1f", F.lit(kind), *parts), 256))


def query_language(c: Column) -> Column:
    return F.when(c.rlike("[\\u4e00-\\u9fff\\u3400-\\u4dbf\\u3040-\\u30ff]"), "zh").otherwise("en")


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def rebuild_abstract(index: Column) -> Column:
    """Text of an inverted index map<word, array<position>>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 for empty vectors, unequal lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def author_overlap(a: Column, b: Column) -> Column:
    """Shared normalized names over the larger set; 0 if either is empty."""
    x, y = F.array_compact(F.array_distinct(a)), F.array_compact(F.array_distinct(b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / most).otherwise(0.0)


def rate(part: Column, whole: Column) -> Column:
    """part / whole to four places, null for an empty whole."""
    return F.round(F.try_divide(part, whole), 4)


def redact_secrets(c: Column) -> Column:
    """Values of key-like parameters and headers replaced by ***."""
    return F.regexp_replace(c, r"(?i)((?:api[_-]?key|token|secret|password|authorization)\s*[=:]\s*(?:bearer\s+)?)[\"']?[A-Za-z0-9._\-]+[\"']?", "$1***")


def backoff_seconds(attempt: Column) -> Column:
    """Retry delays 30, 120, 600, then 3600 seconds, before jitter."""
    return F.coalesce(F.get(F.array(*map(F.lit, [30, 120, 600, 3600])), F.least(attempt, F.lit(4)) - 1), F.lit(30))


def any_of(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)
