"""URL filter: rules first, and gradient-boosted trees on lexical features for what no rule fits."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
MAX_SAMPLE = 20_000  # labelled URLs that the trees are fitted on


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first `://` to `/`, `?`, `#` or the end, A-Z lowered; path up to `?`, `#` or the end."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = _HOST_END.split(rest, maxsplit=1)[0]
    return host.translate(_UPPER), _PATH_END.split(rest[len(host) :], maxsplit=1)[0]


class Rules:
    """Rules `host/path` with a verdict; one fits its host and subdomains if the path starts with its own. Longest wins."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r)):
            host, slash, path = rule.partition("/")
            self.by_host[host.translate(_UPPER)].append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule and its verdict; both null if none fits, and for an empty host."""
        best: tuple[str | None, str | None] = (None, None)
        labels = host.split(".") if host else []
        for k in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(start) and len(rule) > len(best[0] or ""):
                    best = (rule, verdict)
        return best


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * np.log2(c / n) for c in Counter(s).values()) if n else 0.0


class UrlModel:
    """Lexical features (lengths, depth, shares of digits and other signs, entropies, parameters) and smoothed block
    rates of the host's suffixes and the path's head, both taken from the labelled URLs, under boosted trees."""

    def __init__(self, urls: Sequence[str | None], blocked: Sequence[int]) -> None:
        y = np.array(blocked, float)
        self.mean = float(y.mean()) if len(y) else 0.0
        self.sums: dict[str, list[float]] = {}
        for u, b in zip(urls, y, strict=True):
            for key in self._keys(*split_url(u)):
                s = self.sums.setdefault(key, [0.0, 0.0])
                s[0] += b
                s[1] += 1
        self.fitted = bool(len(y)) and 0 < y.sum() < len(y)
        self.trees = BoostedTrees()
        if self.fitted:
            # A row's own label is left out of the rates it is fitted with.
            self.trees.fit(np.array([self.features(u, b) for u, b in zip(urls, y, strict=True)]), y)

    @staticmethod
    def _keys(host: str, path: str) -> list[str]:
        labels = host.split(".")
        return ["1 " + labels[-1], "2 " + ".".join(labels[-2:]), "3 " + host, "p " + path[1:].split("/", 1)[0], f"t {labels[-1]} {path[1:].split('/', 1)[0]}"]

    def features(self, url: str | None, own: float | None = None) -> list[float]:
        url = url or ""
        host, path = split_url(url)
        query = url.partition("?")[2].partition("#")[0]
        n = max(len(url), 1)
        out = [len(url), len(host), len(path), len(query), path.count("/"), host.count("."), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host), sum(not c.isalnum() for c in url) / n, host.count("-"), _entropy(host), _entropy(path), query.count("&") + bool(query), float("#" in url), float(url.startswith("https:")), float(path.endswith((".html", ".htm", ".php")))]
        for key in self._keys(host, path):
            s, c = self.sums.get(key, (0.0, 0.0))
            if own is not None:
                s, c = s - own, c - 1
            out.append((s + 4 * self.mean) / (c + 4))
        return out

    def predict(self, urls: Sequence[str | None]) -> np.ndarray:
        """Probability that each URL is to be blocked; 0 if nothing could be learnt."""
        if not self.fitted or not len(urls):
            return np.zeros(len(urls)) + (self.mean if len(urls) else 0)
        return self.trees.predict(np.array([self.features(u) for u in urls]))


def _judge(rules: Rules, model_b, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            found = [rules.match(*p) for p in parts]
            score = model_b.value.predict(urls)
            verdict = [v or ("block" if s >= threshold else "allow") for (_, v), s in zip(found, score, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in ([h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], verdict)), pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return run


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", blocked_col: str = "blocked", threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score of every row of pages, repeated rows included.

    labelled: (url, blocked 0/1); without it, URLs that a rule fits are the labelled ones. The trees see at most about
    MAX_SAMPLE of them, chosen by hash of the URL. Null URLs and those without `://` have empty host and path, fit no
    rule, and get the model's verdict. With labels of one class only, the verdict is that class.
    """
    table = Rules(rules)
    size = 1 << 20

    def draw(df: DataFrame, url: Column, cost: int) -> DataFrame:
        share = min(1.0, MAX_SAMPLE / max(cost, 1))
        return df.where(F.pmod(F.xxhash64(url, F.lit(13)), F.lit(size)) < F.lit(int(share * size)))

    if labelled is not None:
        marks = labelled.select(F.col(url_col).alias("url"), F.col(blocked_col).cast("int").alias("b")).where("url is not null and b is not null")
        rows = draw(marks, F.col("url"), marks.count()).collect()
        sample = sorted((r.url, int(r.b)) for r in rows)
    else:
        urls = pages.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull())
        rows = draw(urls, F.col("url"), urls.count()).collect()
        judged = [(r.url, table.match(*split_url(r.url))[1]) for r in rows]
        sample = sorted((u, int(v == "block")) for u, v in judged if v)
    model = pages.sparkSession.sparkContext.broadcast(UrlModel([u for u, _ in sample], [b for _, b in sample]))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = dict(own.dtypes)["page_id"]
    return own.mapInArrow(_judge(table, model, threshold), f"page_id {kind}, host string, path string, rule string, verdict string, score double")
