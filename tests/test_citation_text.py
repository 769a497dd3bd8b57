import pytest

from lexmill.functions.citation_text import parse_reference, reference_fields

LINES = [
    ("Lovelace, A., & Hopper, G. B. (1995). On buses. And trams, 2000 of them. Journal of Transit, 12, 3-4. https://doi.org/10.1234/abc.d", "apa", ["Lovelace, A.", "Hopper, G. B."], "On buses. And trams, 2000 of them", "1995", "Journal of Transit", "12", None, "3-4", "10.1234/abc.d"),
    ("Smith, J. (2020). Short title. Nature, 5(3), 10-12.", "apa", ["Smith, J."], "Short title", "2020", "Nature", "5", "3", "10-12", None),
    ("Solo. (2001). T. J, 1, 2-3.", "apa", ["Solo"], "T", "2001", "J", "1", None, "2-3", None),
    ('Lovelace, Ada, and Hopper, Grace. "On buses. And trams." Journal of Transit, vol. 12, no. 3, 1995, pp. 3-4.', "mla", ["Lovelace, Ada", "Hopper, Grace"], "On buses. And trams", "1995", "Journal of Transit", "12", "3", "3-4", None),
    ("Lovelace A, Hopper G B, et al. On buses. And trams[J]. Journal of Transit, 1995, 12: 3-4.", "gb_t", ["Lovelace, A.", "Hopper, G. B."], "On buses. And trams", "1995", "Journal of Transit", "12", None, "3-4", None),
    ("Zhang W. Title here[J]. Acta, 2019, 5(2): 7.", "gb_t", ["Zhang, W."], "Title here", "2019", "Acta", "5", "2", "7", None),
]


@pytest.mark.parametrize("line, style, authors, title, year, journal, volume, issue, pages, doi", LINES)
def test_lines(line, style, authors, title, year, journal, volume, issue, pages, doi):
    got = parse_reference(line)
    assert (got["style"], got["authors"], got["title"], got["year"], got["journal"]) == (style, authors, title, year, journal)
    assert (got["volume"], got["issue"], got["pages"], got["doi"], got["status"]) == (volume, issue, pages, doi, "partial")
    assert parse_reference(line, style)["title"] == title


@pytest.mark.parametrize("line", ["nonsense", ".", " , ", '"', "(", "[J]", "((((", "a" * 5000, "😀"])
def test_no_reference_fails(line):
    assert parse_reference(line)["status"] == "failed"


def test_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, LINES[0][0])], "k int, line string")
    got = {r.k: r.f for r in df.select("k", reference_fields("line").alias("f")).collect()}
    assert (got[1].status, got[2].status, got[1].authors) == ("failed", "failed", []) and got[3].title == LINES[0][3]


def test_round_trip_uses_all_cores(spark, sf):
    # former version: a task for each split of the parts, one at sf0.1
    from lexmill.plans.citations import reference_round_trip

    assert reference_round_trip(spark, sf).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_pieces_are_judged_once():
    from lexmill.functions import citation_text as C

    C._fits.cache_clear()
    C.parse_reference.cache_clear()
    for i in range(50):
        parse_reference(f"Stone, A. (2001). hot ring. STANDARD, 12, {i}-{i + 9}.")
    assert C._fits.cache_info().misses < 70
