from collections import defaultdict

import regex

from lexmill.llm import decontamination as D
from lexmill.llm.queries import QUERIES

EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def bare(w):
    return regex.sub(EDGE, "", w).lower()


def number(w):
    return bare(w) in D.NUMBER_WORDS or bool(regex.match(r"^[^\p{L}\p{N}]*\p{N}[^\p{L}]*(" + "|".join(D.UNITS) + r")?[^\p{L}\p{N}]*$", w))


def template(ws):
    out = []
    for i, w in enumerate(ws):
        before = ws[i - 1] if i else None
        if number(w):
            out.append("#number")
        elif bare(w) in D.UNITS and before and number(before):
            out.append("#unit")
        elif regex.match(r"^\p{Lu}\p{Ll}", w) and before and regex.search(r"[\p{L}\p{N},;)]$", before):
            out.append("#name")
        else:
            out.append(bare(w))
    return out


def cut(t):
    return [tuple(t)] * (0 < len(t) < D.WIDTH) + [tuple(t[i : i + D.WIDTH]) for i in range(len(t) - D.WIDTH + 1)]


def brute(docs, items):
    index = defaultdict(set)
    split = lambda s: [w for w in regex.split(r"[ \t\n\x0b\f\r]+", s or "") if w]
    parts = {i: (split(s), template(split(s))) for i, s in items}
    indexed = defaultdict(set)
    for i, (raw, t) in parts.items():
        for form in (t, [bare(w) if c == "#name" else c for w, c in zip(raw, t)]):
            for k, g in enumerate(cut(form)):
                if sum(w not in D.SLOTS and w != "" for w in g) >= min(D.LITERAL, len(t)):
                    index[g].add((i, k))
                    indexed[i].add(k)
    out = {}
    for d, s in docs:
        raw = split(s)
        lines = defaultdict(set)
        for p, g in enumerate(cut(template(raw))):
            for i, k in index.get(g, ()):
                lines[i, p - k].add(k)
        found, slots, changed = defaultdict(set), defaultdict(int), {}
        for (i, shift), ks in lines.items():
            theirs, t = parts[i]
            over = lambda ks: {p for k in ks for p in range(k, k + D.WIDTH) if p < len(t) and t[p] in D.SLOTS}
            value = {p: (t[p], bare(theirs[p]), bare(raw[p + shift])) for p in over(ks)}
            bad = {p for p, v in value.items() if any(w[:2] == v[:2] and w != v for w in value.values())}
            ks = {k for k in ks if not any(k <= p < k + D.WIDTH for p in bad)}
            if ks:
                found[i] |= ks
                slots[i] = max(slots[i], len(over(ks)))
                changed[i] = min(changed.get(i, 10**9), sum(value[p][1] != value[p][2] for p in over(ks)))
        for i, ks in found.items():
            n = len(indexed[i])
            if len(ks) >= min(D.MIN_WINDOWS, -(-n * D.MIN_SHARE // 1)):
                out[d, i] = max(out.get((d, i), ()), (len(ks), round(len(ks) / n, 6), slots[i], changed[i]))
    return out


def rows(df):
    return {(r.doc_id, r.item_id): (r.windows, r.coverage, r.slots, r.changed) for r in df.collect()}


def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows(QUERIES["op2_decontamination"](spark, sf))
    assert got == brute(docs, items) and len(got) > 2


ITEM = "A train leaves Paris at 40 km per hour and meets 3 friends of Anna after 40 minutes near the old bridge"


def test_reparameterised_and_edge_rows(spark):
    items = [(1, ITEM), (2, None), (3, ""), (4, "short item"), (5, "1 2 3 4 5 6 7 8 9 10"), (6, ITEM)]
    docs = [
        (1, ITEM),
        (2, "Look: " + ITEM.replace("40", "75").replace("Anna", "Bert").replace("Paris", "Rome") + "!"),
        (3, ITEM.replace("40 km", "75 km")),  # 40 stands for two things
        (4, ITEM.upper()),
        (5, "1 2 3 4 5 6 7 8 9 10 11"),
        (6, None), (7, ""), (8, "Short item"), (9, "a short item"), (10, "x " * 50_000 + ITEM), (11, ITEM), (11, ITEM), (None, ITEM),
        (12, " ".join(ITEM.split()[:9])), (13, ITEM.lower()), (14, ITEM.replace("3", "three")), (15, "nothing of it at all here"), (15, ITEM), (15, ITEM.replace("Anna", "Bert")),
    ]
    df = spark.createDataFrame([(d, t, 0, "h") for d, t in docs], "doc_id long, text string, pos int, ITEM_ID string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h int")
    got = rows(D.contamination(df, bench))
    assert got == brute([d for d in docs if d[0] is not None], items)
    assert (2, 1) in got and got[2, 1][3] == 4 and (3, 1) not in got and (5, 5) not in got and (8, 4) in got and (9, 4) not in got and (4, 1) in got and (13, 1) in got and got[14, 1][3] == 1 and got[15, 1][0] == got[1, 1][0]
    assert D.contamination(df.limit(0), bench).count() == 0 and D.contamination(df, bench.limit(0)).count() == 0


def test_one_edited_slot_costs_its_windows_alone(spark):
    long = ITEM + " where every child of the village watched the slow boats pass under the stone arches and waved until the last lantern was gone"
    df = spark.createDataFrame([(1, long), (2, long.replace("40 km", "75 km"))], "doc_id long, text string")
    got = rows(D.contamination(df, spark.createDataFrame([(1, long)], "item_id long, text string")))
    n = len(long.split()) - D.WIDTH + 1
    assert got[1, 1][0] == n and got[1, 1][3] == 0
    assert got[2, 1][0] == n - 6 - 8  # windows over the first 40 and over the second
