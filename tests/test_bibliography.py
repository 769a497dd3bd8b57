import pytest
from pyspark.sql import functions as F

from lexmill.sources import bibliography as B

BIB = """% a file
@string{ab = "Annals of " # city}
@String(city = {Buses})
@comment{ignored @article{no, title={no}}}
@article{one,
  author = {Lovelace, Ada and Grace {Brewster} Hopper AND {Turing}},
  title = {On {{Nested} Braces} and "quotes" \\{kept\\}},
  journal = ab # ", Series " # 2, year = 1999, month = mar,
  pages = "1--{9}", title = {second is passed over},
}
@InProceedings{two, title = "A {"}braced quote{"} of
   two lines", booktitle = {Proc.}, author = "Solo", DOI={10.1/X}}
@book{three, author={A B}}
@misc{open, title = {never closed, year = 2001
"""
RIS = """TY  - JOUR
AU  - Lovelace, Ada
AU  - Grace Hopper
TI  - Title one
T2  - A Journal
PY  - 2001/03/04
SP  - 5
EP  - 9
ER  -

TY  - CONF
T1  - Two
JO  - P
Y1  - n.d.
ER  - 
"""  # noqa: W291


def told(df):
    return {r.key: r for r in df.collect()}


def test_bibtex_by_hand(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    got = told(B.read_bibtex(spark, str(tmp_path / "a.bib")))
    assert set(got) == {"one", "two", "three", "open"}
    one, two = got["one"], got["two"]
    assert [tuple(a) for a in one.authors] == [("Lovelace", "Ada"), ("Hopper", "Grace Brewster"), ("Turing", None)]
    assert (one.type, one.title, one.container_title, one.year, one.page, one.status) == ("article-journal", 'On Nested Braces and "quotes" \\{kept\\}', "Annals of Buses, Series 2", 1999, "1--9", "parsed")
    assert (two.type, two.title, two.container_title, two.doi, two.status, two.warnings) == ("paper-conference", 'A "braced quote" of two lines', "Proc.", "10.1/X", "partial", ["missing_year"])
    assert (got["three"].status, got["three"].warnings, got["open"].status) == ("failed", ["missing_title"], "failed")
    fields = {r.key: r.fields for r in B.bibtex_entries(B._records(spark, str(tmp_path / "a.bib"), "\n@")).collect()}
    assert fields["one"]["month"] == "Mar"


def test_records_across_splits(spark, tmp_path):
    """Splits of 9,000 bytes, records of up to 2,000: each is read once and whole, whichever border it lies across."""
    path = str(tmp_path / "many.bib")
    with open(path, "w") as f:
        f.write("@string{v = {Vol }}\n")
        for k in range(400):
            f.write(f"@article{{k{k},\n title = {{T{k} {'x' * (k * 37 % 2000)}}},\n year = {1900 + k % 100}, volume = v # {k}}}\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        raw = B._records(spark, path, "\n@")
        assert raw.select(F.spark_partition_id()).distinct().count() > 20
        got = told(B.bibtex_citations(B.bibtex_entries(raw.repartition(4))))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {(k, r.title, r.year, r.volume) for k, r in got.items()} == {(f"k{k}", f"T{k} {'x' * (k * 37 % 2000)}".strip(), 1900 + k % 100, f"Vol {k}") for k in range(400)}


def test_ris_by_hand(spark, tmp_path):
    (tmp_path / "a.ris").write_text(RIS.replace("\n", "\r\n"))
    got = {r.title: r for r in B.read_ris(spark, str(tmp_path / "a.ris")).collect()}
    one, two = got["Title one"], got["Two"]
    assert (one.type, one.year, one.page, one.container_title, one.status) == ("article-journal", 2001, "5-9", "A Journal", "parsed")
    assert [tuple(a) for a in one.authors] == [("Lovelace", "Ada"), ("Hopper", "Grace")]
    assert (two.type, two.page, two.warnings) == ("paper-conference", None, ["missing_authors", "missing_year"])


@pytest.mark.parametrize("text, want", [("article{k, a = {x}}", ("article", "k", [("a", [("x", None)])], True)), ("article(k, a=1)", ("article", "k", [("a", [("1", None)])], True)), ("x", ("x", None, [], False)), ("", ("", None, [], False)), ("misc{k}", ("misc", "k", [], True)), ("misc{k, a = }", ("misc", "k", [("a", [])], True)), ("misc{k, a = b # {c} # \"d{\"}\"}", ("misc", "k", [("a", [(None, "b"), ("c", None), ('d{"}', None)])], True))])
def test_entry(text, want):
    assert B.bibtex_entry(text) == want


def test_edges(spark):
    df = spark.createDataFrame([("f", None), ("f", ""), ("g", "@article{k, title={t}}\n@string{a = a}\n@misc{m, title = a # {x}}")], "file string, text string")
    got = told(B.bibtex_citations(B.bibtex_entries(B.bibtex_text(df, "file", "text"))))
    assert {k: r.title for k, r in got.items()} == {"k": "t", "m": "x"}
    assert B.ris_citations(B.ris_text(df.limit(0), "file", "text")).count() == 0


def test_entries_are_taken_apart_once(spark):
    # former version: three passes of the parser, four shuffles of a row a part, and rows numbered anew in each of them
    raw = spark.createDataFrame([("f", "string{o = {Of} # { x}}"), ("f", " STRING (o2 = o # {y})"), ("f", 'article{a, t = o # " z", t = {later}, u = , m = jan # unknown # {!}}'), ("g", "book{b, t = o}"), ("g", "book{c}")], "file string, text string")
    df = B.bibtex_entries(raw)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "ArrowEvalPython" not in plan and "monotonically" not in plan and "Generate posexplode" not in plan  # strings and the others
    assert {r.key: r.fields for r in df.collect()} == {"a": {"m": "Jan!", "t": "Of x z"}, "b": {"t": ""}, "c": {}}


ODD = [
    BIB,
    None,
    "",
    "no record",
    "misc{not, title = {text ahead}}\n@article{k, Title={t}, title={later}, author={ Ann  Lee and , and Bo,  C and and D}, year={in 2001 or 1999}, journal={}, booktitle={B}, number=7}",
    "@string{a = b # {x}}\n@string{b = a # \"y\"}\n@STRING(a = {z})\n@book(p, title = a # b # jan # nothing, year = 12, publisher = {Two\n\t lines \\{kept\\} {off}}, address = a)",
    "@article{q, title = {open, year = 2000}\n  @misc{r, title = \"q {\"} u\", author = {A and B and C D}, doi = {10.1/é}, url = , language = 5}\n@9x{s, title={t}}\n@misc{, title={no key}}\n@misc{u}",
    "@article{w, title = {a} {b}, year = 2000}\n@article{x, title = {a}, , year = 2000,, month = mar} rest\n@article{y, title = dec # \" and \" # may) \n@preamble{\"x\"}\n@comment{z, title={c}}",
]


def test_whole_files_equal_records(spark):
    # former version of the query: a row a record, four shuffles, macros joined as maps
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(100 + i, f"@string{{m = {{M{i}}}}}\n" + "".join(f"@article{{k{j},\n title = {{T {{{j}}}}}, author = {{A {j} and B}}, year = {1900 + j}, journal = m # \", \" # {j}}}\n" for j in range(i))) for i in range(60)], "file int, text string")
    whole, plain = B.bibtex_files(df, "file", "text"), B.bibtex_citations(B.bibtex_entries(B.bibtex_text(df, "file", "text")))
    assert whole.dtypes == plain.dtypes
    got, want = (sorted(map(repr, x.collect())) for x in (whole, plain))
    assert got == want and len(got) > 1770
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert B.bibtex_files(df.limit(0), "file", "text").count() == 0


def test_query_shuffles_lines_once(spark, sf):
    from lexmill.plans.citations import bibtex_records

    plan = bibtex_records(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan


def test_plain_records_equal_the_cursor(monkeypatch):
    import random

    random.seed(5)
    signs = ["{", "}", "(", ")", '"', ",", "=", "#", " ", "\n", "\\", "\\}", "a", "title", "1", "macro", "{x}", '"q"', "{a {b} c}", " # ", "é", "\x1c"]
    texts = ["".join(random.choice(["a = {x}", 'b= "y"', "c =1", "d = m # {z}", ' e = {n {i} } # 2 # "w"']) + random.choice([", ", ",", ",,\n", " ", "", " #"]) for _ in range(random.randint(0, 4))) for _ in range(3000)]
    texts = [random.choice(["article{k, ", "string{", "misc(", "book{k"]) + t + random.choice(["}", ")", "", " } x", "}}"]) for t in texts]
    texts += [t[:i] + random.choice(signs) + t[i:] for t in texts for i in [random.randrange(len(t) + 1)]]
    at_once = [B.bibtex_entry(t) for t in texts]
    assert sum(B._plain_entry(t) is not None for t in texts) > 1000
    monkeypatch.setattr(B, "_plain_entry", lambda _: None)
    assert [B.bibtex_entry(t) for t in texts] == at_once
