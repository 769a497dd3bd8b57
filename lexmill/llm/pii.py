"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of each kind: values the base patterns miss because they are written
another way (`name at host dot com`, `97 . 51 . 17 . 173`, a phone without +, a card in groups), and every run of characters
that could be a key or secret. A model of boosted trees a kind scores a proposal by its format and context, and thresholds
calibrated a kind on held-out proposals select those to redact besides the base spans, which always stay.

The trees learn from the corpus itself. Positive: base spans of its texts, written another way in their own place, and
values that their context names as secret, once in it and once out of it. Negative: all other proposals of those texts,
and numbers that are nobody's (dates, times, versions, amounts, measures) put into them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .shared import small_batches, tidy

MAX_SAMPLE = 20_000  # proposals that the trees are fitted on
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
PRECISION = 0.98
LEAST_HELD = 4  # positive held-out proposals of a kind, without which it adds nothing

# Fixed values of op3's contract, as far as they are searched for by pattern; see base_spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NOT_DIGIT = re.compile(r"[^0-9]+")
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z_+/=-]*[0-9][A-Za-z0-9_+/=-]*")
_NAMED = re.compile(r"(?:token|secret|password|passwd|api[_-]?key)[\"']?\s*[=:]\s*[\"']?$", re.I)
_NEAR = re.compile(r"token|secret|pass|key|auth|cred|login|pwd", re.I)
_PERSON = re.compile(r"call|phone|tel|fax|mobile|mail|contact|card|visa|pay|server|host|addr|ip\b", re.I)
_HINTS = (" dot ", " DOT ", "(at)", "[at]", "(AT)", "[AT]")  # of an address without digit or at sign
_HAS = r"[0-9@]| (?:dot|DOT) |[\[(](?:at|AT)[\])]"
# What the generators propose. Each begins with a digit where no run of digits goes on, so a long run costs one try.
_PROPOSE = {
    "ip": re.compile(r"[0-9](?<![0-9A-Za-z:.][0-9])[0-9]{0,2}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"[0-9](?<![0-9][0-9])(?:[ ./-]{0,3}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"[0-9](?<![0-9+][0-9])(?:[ ().-]{0,3}[0-9]){6,14}(?![0-9])"),
}
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_AT = re.compile(r" (?:at|AT|@) | ?[\[(](?:at|AT)[\])] ?")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[(](?:dot|DOT)[\])] ?| (?:dot|DOT) | \. |\.)[A-Za-z0-9-]{1,63}){1,4}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Contract spans by kind, in code points, in time that grows with the text's length alone.

    An address has one at sign: its local part is the run before it, as far as no address before took it. Of a run of
    digits and dots, leftmost matches take four parts after four. Cards and phones are maximal runs as they stand.
    """
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in _DOTTED.finditer(text) if "." in text else ():
        parts = m.group().split(".")
        begin = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                out.append(("ip", begin, end))
            begin = end + 1
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans of each kind that may overlap: what the generators find, and for secrets runs of eight signs or more with a
    digit, and the value alone in `name=value`."""
    out = {(kind, *m.span()) for kind, p in _PROPOSE.items() for m in p.finditer(text)}
    out = {(kind, s - (kind == "phone" and text[s - 1 : s] == "("), e) for kind, s, e in out}
    if text.count(":") > 1:
        out |= {("ip", *m.span()) for m in _IP6.finditer(text)}
    for m in _AT.finditer(text):
        lo = max(0, m.start() - 64)
        start, host = lo + len(text[lo : m.start()].rstrip(_LOCAL)), _HOST.match(text, m.end())
        if host and start < m.start():
            out.add(("email", start, host.end()))
    for m in _RUN.finditer(text):
        lo, hi = m.span()
        if hi - lo >= 8:
            out.add(("secret", lo, hi))
            eq = text.rfind("=", lo, hi - 1)
            if eq > lo and hi - eq > 8:
                out.add(("secret", eq + 1, hi))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def features(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    n = len(s)
    digits = _NOT_DIGIT.sub("", s)
    upper, lower = sum(c.isupper() for c in s), sum(c.islower() for c in s)
    hexa = sum(c in "0123456789abcdefABCDEF" for c in s)
    counts = Counter(s)
    entropy = -sum(c / n * np.log2(c / n) for c in counts.values())
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    close = before[-4:]
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    groups = [len(g) for g in _NOT_DIGIT.split(s) if g]
    first = int(bool(groups) and s[:4].isdecimal() and 1900 <= int(s[:4]) <= 2100)
    return [
        n, len(digits), len(digits) / n, upper / n, lower / n, hexa / n, len(counts) / n, entropy, turns / n,
        s.count("-"), s.count("."), s.count("/"), s.count(" "), s.count("="), s.count(":"), s.count("("), s.count("["),
        float("@" in s), len(groups), max(groups, default=0), min(groups, default=0), first,
        float(13 <= len(digits) <= 19 and luhn(digits)), float("=" in close), float(":" in close), float('"' in close or "'" in close),
        float(bool(_NEAR.search(before))), float(bool(_PERSON.search(before))), float(after[:1] in ('"', "'")),
        float(after.lstrip()[:1].isalpha()), float(before.rstrip()[-1:].isalpha()),
    ]


def rewritten(kind: str, value: str, pick: int) -> str:
    """A base span written in a way that the base patterns miss."""
    if kind == "email":
        local, _, domain = value.partition("@")
        return [f"{local} at {domain.replace('.', ' dot ')}", f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain}", f"{local} @ {domain}"][pick % 4]
    if kind == "ip":
        parts = value.split(".")
        v6 = "".join(f"{int(p.lstrip('0') or 0):02x}" for p in parts)
        return [" . ".join(parts), "[.]".join(parts), f"2001:db8:{v6[:4]}:{v6[4:]}:0:0:0:1", f"fe80::{v6[:4]}:{v6[4:]}"][pick % 4]
    digits = _NOT_DIGIT.sub("", value)
    if kind == "card":
        return [".", " . ", "/", " - "][pick % 4].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}"][pick % 4]


def nobodys(pick: int) -> str:
    """A number that is no personal data: dates, times, versions, amounts, measures, references."""
    r = np.random.default_rng(pick)
    a, b, c, d = (int(x) for x in r.integers(1, 28, 4))
    y, n = 1900 + int(r.integers(0, 200)), int(r.integers(10, 10**6))
    forms = [
        f"{y}-{a % 12 + 1:02d}-{b:02d}", f"{a:02d}.{b % 12 + 1:02d}.{y}", f"{y}-{a % 12 + 1:02d}-{b:02d} {c % 24:02d}:{d:02d}:{a:02d}", f"{c % 24:02d}:{d:02d}:{a:02d}",
        f"v{a}.{b}.{c}", f"{a}.{b}", f"{n:,}", f"{a}.{b:02d} {c}.{d:02d} {n}", f"{n}-{y}", f"{y}-{y + 4}", f"{a} {b} {c} {d} {n}", f"ISBN 978-{a}-{n}-{b}-{c % 10}",
        f"{y} {n} {a}", f"{n}.{b:04d}{n}", f"pp. {n}-{n + a}, {y}", f"{y}{a % 12 + 1:02d}{b:02d}{c % 24:02d}{d:02d}", f"section-{a}-{b}-part-{c}",
    ]
    return forms[pick % len(forms)]


def no_address(pick: int, words: Sequence[str]) -> str:
    """Words around an `at` that are no address."""
    a, b, c, d = (words[(pick // 7**k) % len(words)] for k in range(4)) if words else ("so", "we", "go", "on")
    forms = [f"{a} at {b} . {c} {d}", f"{a} at {b} dot {c}", f"{a} (at) {b} . {c}", f"{a} @ {b} . {c.title()} {d}", f"{a} at {b} dot {c} dot {d}", f"{a} [at] {b}.{c}", f"{a}{pick % 90} at {b} . {c}"]
    return forms[pick % len(forms)]


def examples(text: str) -> list[tuple[str, list[float], int]]:
    """Kind, features and label of the proposals of a text, of its base spans rewritten, and of a number put into it."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    seed = zlib.crc32(text[:200].encode("utf-8", "replace"))
    out = []
    for kind, s, e in proposals(text):
        k = bisect.bisect_left(taken, (e,))
        if any(b > s for _, b in taken[max(0, k - 2) : k]):
            continue
        named = kind == "secret" and "=" not in text[s : e - 2] and bool(_NAMED.search(text[max(0, s - 24) : s]))
        out.append((kind, features(text, s, e), int(named)))
        if named:  # out of its context
            bare = text[max(0, s - 60) : max(0, s - 24)]
            out.append((kind, features(f"{bare} {text[s:e]} {bare}", len(bare) + 1, len(bare) + 1 + e - s), 1))
    for k, (kind, s, e) in ((k, x) for x in base[:8] for k in range(4)):
        new = rewritten(kind, text[s:e], k)
        around = text[max(0, s - 60) : s] + new + text[e : e + 60]
        lo, hi = min(s, 60), min(s, 60) + len(new)
        for other, ps, pe in proposals(around):
            if other in BASE and ps < hi and pe > lo:  # what overlaps it in part is as wrong as what misses it
                out.append((other, features(around, ps, pe), int(other == kind and abs(ps - lo) + abs(pe - hi) <= 1)))
    mid = text.find(" ", len(text) // 2)
    left, after = (text[max(0, mid - 60) : mid], text[mid : mid + 60]) if mid > 0 else ("", "")
    for number in (f" {nobodys(seed)} ", f" {no_address(seed, re.findall('[a-z]{2,9}', left + after))} "):
        around = left + number + after
        out += [(kind, features(around, s, e), 0) for kind, s, e in proposals(around) if s < len(left) + len(number) and e > len(left)]
    return out


class SpanModel:
    """For each kind boosted trees and the threshold above which held-out proposals are positive with PRECISION; report:
    precision, recall and number of positives among the held-out proposals of each kind."""

    def __init__(self, kinds: Sequence[str], x: np.ndarray, y: np.ndarray) -> None:
        self.trees: dict[str, BoostedTrees] = {}
        self.threshold: dict[str, float] = {}
        self.report: dict[str, tuple[float, float, int]] = {}
        of = np.array(kinds)
        for kind in KINDS:
            own = np.flatnonzero(of == kind)
            held = np.arange(len(own)) % 4 == 3
            fit, rest = own[~held], own[held]
            if not len(fit) or not 0 < y[fit].sum() < len(fit) or y[rest].sum() < LEAST_HELD:
                continue
            trees = BoostedTrees(trees=30).fit(x[fit], y[fit])
            p, t = trees.predict(x[rest]), y[rest]
            order = np.argsort(-p, kind="stable")
            right = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
            good = np.flatnonzero(right >= PRECISION)
            if len(good):
                at = max(0.5, float(p[order[good[-1]]]))
                found = p >= at
                self.trees[kind], self.threshold[kind] = trees, at
                self.report[kind] = (float(t[found].mean()) if found.any() else 0.0, float(t[found].sum() / t.sum()), int(t.sum()))

    def select(self, text: str, spans: list[tuple[str, int, int]]) -> list[tuple[float, str, int, int]]:
        """Score and span of the proposals at or above their kind's threshold."""
        out = []
        for kind, trees in self.trees.items():
            own = [s for s in spans if s[0] == kind]
            if own:
                p = trees.predict(np.array([features(text, s, e) for _, s, e in own]))
                out += [(float(v), *s) for s, v in zip(own, p, strict=True) if v >= self.threshold[kind]]
        return out


def find_spans(text: str, model: SpanModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: selected proposals that overlap none before them, surest first. Both in order."""
    key = lambda s: (s[1], KINDS.index(s[0]))
    base = sorted(base_spans(text), key=key)
    more, taken = [], []  # taken: disjoint, ascending
    for _, s, e in base:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))

    def free(start: int, end: int) -> bool:
        k = bisect.bisect_left(taken, (end,))
        return k == 0 or taken[k - 1][1] <= start

    for _, kind, s, e in sorted(model.select(text, [x for x in proposals(text) if free(x[1], x[2])]), key=lambda x: (-x[0], x[3] - x[2], x[2], x[1])):
        if free(s, e):
            more.append((kind, s, e))
            bisect.insort(taken, (s, e))
    return base, sorted(base + more, key=key)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or chain of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _searched(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Rows that can hold a span: every kind needs a digit or an at sign."""
    has = pc.match_substring_regex(column, _HAS)
    rows = np.flatnonzero(pc.fill_null(has, False).to_numpy(zero_copy_only=False))
    yield from zip(rows.tolist(), column.take(pa.array(rows, pa.int64())).to_pylist(), strict=True)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for _, text in _searched(batch.column(0)) for x in examples(text)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.int32())], ["kind", "x", "y"])


def _find(model_b, with_text: bool, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            base, every, texts = [""] * n, [""] * n, {}
            counts = np.zeros((len(BASE), n), np.int64)
            for r, text in _searched(batch.column(1)):
                b, spans = find_spans(text, model_b.value)
                for k, _, _ in b:
                    counts[BASE.index(k), r] += 1
                base[r], every[r] = listed(b), listed(spans)
                if with_text and spans:
                    texts[r] = redact(text, spans)
            digest = [hashlib.sha256(s.encode()).hexdigest() if s else _EMPTY for s in base]
            cols = [batch.column(0), *(pa.array(c) for c in counts), pa.array(digest, pa.string()), pa.array(every, pa.string())]
            names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
            if with_text:
                cols.append(pa.array([texts.get(r, t) for r, t in enumerate(batch.column(1).to_pylist())], pa.string()))
                names.append("redacted")
            for k in range(2, 2 + kept):
                cols.append(batch.column(k))
                names.append(f"kept{k}")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


_EMPTY = hashlib.sha256(b"").hexdigest()


def fit_spans(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Trees fitted on at most about MAX_SAMPLE proposals of texts that can hold a span, chosen by hash of the text."""
    own = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]") | reduce(or_, (F.contains("text", F.lit(h)) for h in _HINTS)))
    total = own.count()
    size = 1 << 20
    share = min(1.0, MAX_SAMPLE / 8 / max(total, 1))
    drawn = own.where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(size)) < F.lit(max(1, int(share * size))))
    found = drawn.mapInArrow(tidy(_examples), "kind string, x array<double>, y int").distinct().orderBy(F.xxhash64("kind", "x")).limit(MAX_SAMPLE).collect()
    rows = sorted((r.kind, tuple(r.x), r.y) for r in found)
    order = np.random.default_rng(4).permutation(len(rows))
    return SpanModel([rows[i][0] for i in order], np.array([rows[i][1] for i in order]), np.array([rows[i][2] for i in order], float))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and redacted) of every row, repeated rows included,
    with the columns of docs named in keep (of those names that the result has itself, docs' columns win).

    Spans are kind:start:end in code points, end exclusive, by start and then kind; the counts and base_sha256 are of base
    spans, spans of all. Null texts count as empty, with null redacted. A kind whose proposals give no model (fewer than
    LEAST_HELD positives held out, or all alike) adds nothing. Base spans of different kinds may overlap and all stay;
    selected proposals overlap nothing.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit_spans(docs, text_col))
    more = [F.col(c).alias(f"kept{k}") for k, c in enumerate(keep, 2)]
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * redacted
    schema += "".join(f", kept{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep, 2))
    out = own.mapInArrow(tidy(_find(model, redacted, len(keep))), schema)
    taken = {c.lower() for c in keep}
    return out.select(*[c for c in out.columns[: len(out.columns) - len(keep)] if c.lower() not in taken], *[F.col(f"kept{k}").alias(c) for k, c in enumerate(keep, 2)])
