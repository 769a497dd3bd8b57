"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text per language gives, from any position of a text, the longest match with that
language's text. Parsing a text greedily into such longest matches needs the fewest phrases in its own language; phrases
per character estimate the cross entropy. The language with the fewest wins.

Every letter of the labelled text is a symbol of its own, whatever its script. Automata are tables of transitions, so that
many stretches of text are parsed at once, each from its start. Where a stretch ends inside a phrase, the parse goes on
into the next stretch until both begin a phrase at the same place, from where they agree: the phrases counted are those of
one parse of the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import byte_view, chunks, small_batches, tidy

UNKNOWN = "und"
POINTS = 0x110000
DENSE = 48  # symbols of a language with a column of their own in its table; the rest lie in a sorted list of edges
MAX_SYMBOLS = 6_000_000  # of training text, all languages together


class Automaton:
    """The automaton of all substrings of a text; state 0 is the start, and an extra last state leads nowhere.

    A state's transitions are a row of `table` for the commonest symbols (`column` tells which), -1 where none; those by
    other symbols are `edges`, sorted keys state * alphabet + symbol, and their `targets`.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int, dense: int = DENSE) -> None:
        go: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in symbols.tolist():
            cur = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p != -1:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and go[p].get(c) == q:
                        go[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        common = [c for c, _ in sorted(Counter(symbols.tolist()).items(), key=lambda x: (-x[1], x[0]))[:dense]]
        self.alphabet, self.width = alphabet, len(common) + 1
        self.column = np.full(alphabet, len(common), np.int64)
        self.column[common] = np.arange(len(common))
        state = np.repeat(np.arange(len(go)), [len(g) for g in go])
        symbol = np.fromiter((c for g in go for c in g), np.int64, len(state))
        target = np.fromiter((t for g in go for t in g.values()), np.int32, len(state))
        table = np.full((len(go) + 1, self.width), -1, np.int32)
        near = self.column[symbol] < len(common)
        table[state[near], self.column[symbol[near]]] = target[near]
        self.table, keys = table.ravel(), state[~near] * alphabet + symbol[~near]
        order = np.argsort(keys)
        self.edges, self.targets = keys[order], target[~near][order]
        self.stuck = len(go)
        root = self.next(np.zeros(alphabet, np.int64), np.arange(alphabet))
        self.root = np.where(root < 0, self.stuck, root)

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """State after each symbol, -1 where the match ends."""
        col = self.column[symbol]
        to = self.table[state * self.width + col].astype(np.int64)
        if len(self.edges) and len(rest := np.flatnonzero(col == self.width - 1)):
            key = state[rest] * self.alphabet + symbol[rest]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            to[rest] = np.where(self.edges[at] == key, self.targets[at], -1)
        return to


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(POINTS)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Alphabet:
    """Symbols: 0 for anything but letters, 1 for letters that the training text lacks, then its letters, without case."""

    def __init__(self, texts: list[str]) -> None:
        held = np.unique(_points("".join(texts).lower()))
        held = held[_letters()[held]]
        self.size = len(held) + 2
        self.table = _letters().astype(np.uint32)
        self.table[held] = np.arange(2, self.size)
        for c in np.flatnonzero(self.table == 1).tolist():
            low = chr(c).lower()
            if len(low) == 1:
                self.table[c] = self.table[ord(low)]

    def symbols(self, points: np.ndarray) -> np.ndarray:
        return self.table[points]


def learn(samples: list[tuple[str, str]]) -> tuple[Alphabet, list[str], list[Automaton]]:
    """Alphabet, languages in order of name, and an automaton each, of (language, text) rows."""
    by: dict[str, list[str]] = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    alphabet = Alphabet([t for _, t in samples])
    names = sorted(by)
    automata = []
    for lang in names:
        s = alphabet.symbols(_points("\n".join(by[lang])))
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        automata.append(Automaton(s[keep], alphabet.size))
    return alphabet, names, automata


def phrases(symbols: np.ndarray, row: np.ndarray, automaton: Automaton, stretch: int = 256) -> np.ndarray:
    """Greedy longest-match phrases of each text symbols[row[k]:row[k + 1]], whole.

    A symbol that the language lacks is a phrase of its own.
    """
    n = np.diff(row)
    parts = -(-n // stretch)
    owner = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = row[:-1][owner] + nth * stretch
    end = np.minimum(begin + stretch, row[1:][owner])
    # Each stretch from its own start; mark: where its phrases begin.
    order = np.argsort(begin - end, kind="stable")
    first, size = begin[order], (end - begin)[order]
    mark = np.zeros(len(symbols) + 1, bool)
    mark[begin] = True
    state = np.full(len(order), automaton.stuck, np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        alive = int(np.searchsorted(-size, -t, "left"))  # those longer than t
        c = symbols[first[:alive] + t].astype(np.int64)
        to = automaton.next(state[:alive], c)
        miss = to < 0
        state[:alive] = np.where(miss, automaton.root[c], to)
        mark[first[:alive][miss] + t] = True
    # The open phrases go on, until they begin one where another stretch does.
    state[order] = state.copy()
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    open_ = np.flatnonzero(~last)
    meet, more = end.copy(), np.zeros(len(owner), np.int64)
    at, state, stop = end[open_], state[open_], row[1:][owner[open_]]
    while len(open_):
        c = symbols[at].astype(np.int64)
        to = automaton.next(state, c)
        miss = to < 0
        done = miss & mark[at]
        more[open_[miss & ~done]] += 1
        meet[open_[done]] = at[done]
        state, at = np.where(miss, automaton.root[c], to), at + 1
        ran_out = ~done & (at == stop)
        meet[open_[ran_out]] = at[ran_out]
        live = ~done & ~ran_out
        open_, at, state, stop = open_[live], at[live], state[live], stop[live]
    total = np.concatenate([[0], np.cumsum(mark)])
    entry = begin.copy()
    entry[1:][~last[:-1]] = meet[:-1][~last[:-1]]
    count = np.bincount(owner, weights=total[end] - total[np.minimum(entry, end)] + more, minlength=len(n)).astype(np.int64)
    # Where an open phrase ran past all of the next stretch, that stretch does not count: go from meeting to meeting.
    over = np.zeros(len(owner), bool)
    over[1:] = ~last[:-1] & (meet[:-1] >= end[1:]) & (end[1:] < row[1:][owner[1:]])
    ahead = np.cumsum(parts) - parts
    for r in np.unique(owner[over]).tolist():
        i, p, c = int(ahead[r]), int(row[r]), 0
        while True:
            c += int(total[end[i]] - total[p]) + int(more[i])
            if last[i] or meet[i] == row[r + 1]:
                break
            p = int(meet[i])
            i = int(ahead[r]) + (p - int(row[r])) // stretch
        count[r] = c
    return count


def _scorer(model_b, stretch: int, with_text: bool, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, names, automata = model_b.value
        for batch in batches:
            data, offs = byte_view(batch.column(1))
            best, conf = [], []
            for i, j in chunks(offs, 1 << 19):
                text = data[offs[i] : offs[j]].tobytes().decode("utf-8", "replace")
                points = _points(text)
                # Row starts in characters: bytes that begin a character, counted.
                lead = np.concatenate([[0], np.cumsum((data[offs[i] : offs[j]] & 0xC0) != 0x80)])
                row = lead[offs[i : j + 1] - offs[i]]
                s = alphabet.symbols(points)
                letters = np.diff(np.concatenate([[0], np.cumsum(s != 0)])[row])
                keep = np.ones(len(s), bool)
                keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
                keep[row[:-1][row[:-1] < len(s)]] = True  # a text is parsed as if alone
                row = np.concatenate([[0], np.cumsum(keep)])[row]
                s = s[keep]
                n = np.diff(row)
                rate = np.empty((len(names), j - i))
                for k, automaton in enumerate(automata):
                    rate[k] = phrases(s, row, automaton, stretch) / np.maximum(n, 1)
                win = np.argmin(rate, axis=0) if len(names) else np.zeros(j - i, int)
                # The winner's share when each language weighs (phrases per character)^-8.
                weight = np.maximum(rate, 1e-9) ** -8
                share = np.max(weight, axis=0) / weight.sum(axis=0) if len(names) else np.zeros(j - i)
                for r in range(j - i):
                    known = letters[r] > 0 and len(names) > 0
                    best.append(names[win[r]] if known else UNKNOWN)
                    conf.append(float(share[r]) if known else 0.0)
            more = [batch.column(1)] * with_text + [batch.column(k) for k in range(2, 2 + kept)]
            names_out = ["text"] * with_text + [f"kept{k}" for k in range(kept)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(conf, pa.float64()), *more], ["doc_id", "lang_pred", "score", *names_out])

    return run


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column, rows: int, chars: int) -> list[tuple[str, str]]:
    """A passage of at most `chars` characters, from a place chosen by hash, of each of about `rows` labelled texts a
    language, themselves chosen by hash of the id: the share to take comes from the languages' counts over all rows."""
    labelled = docs.where(train & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    rows = max(1, min(rows, MAX_SYMBOLS // (chars * len(counts))))
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, 1.5 * rows / v))])
    draw = (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(1 << 20)) / F.lit(1 << 20)).alias("draw")
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(8)), F.greatest(F.length(text_col) - chars, F.lit(0)) + 1).cast("int") + 1
    taken = labelled.select(F.col(lang_col).alias("lang"), draw, share[F.col(lang_col)].alias("share"), F.substring(F.col(text_col), place, F.lit(chars)).alias("text")).where("draw < share")
    by: dict[str, list] = {}
    for r in sorted(taken.collect(), key=lambda r: (r.lang, r.draw, r.text)):
        own = by.setdefault(r.lang, [])
        if len(own) < rows:
            own.append((r.lang, r.text))
    return [x for own in by.values() for x in own]


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: Column | None = None, rows: int = 60, chars: int = 600, stretch: int = 256, with_text: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), the text if asked for, and the columns named in keep as kept0, kept1 and so on:
    a row for each of docs, repeated rows included.

    Automata are fitted on a bounded sample: about `rows` rows with a label (and where `train` holds) a language, a
    passage of `chars` characters each, and fewer where all languages together would pass MAX_SYMBOLS; all texts are then
    parsed whole. Null texts and texts without a letter are `und` with score 0, as is everything if no labelled text
    exists. Ties go to the language first by name.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if train is None else train).alias("train"))
    model = learn(training_sample(own, "doc_id", "text", "lang", F.col("train"), rows, chars))
    run = _scorer(docs.sparkSession.sparkContext.broadcast(model), stretch, with_text, len(keep))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept{k}") for k, c in enumerate(keep)])
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, lang_pred string, score double" + ", text string" * with_text
    return given.mapInArrow(tidy(run), schema + "".join(f", kept{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)))
