import threading

import pytest
from pyspark.sql import functions as F

from lexmill.sources import snapshots as S


def tables(spark, n, pages="p"):
    rows = spark.range(n)
    return {"pages": rows.select(F.col("id").alias("page_id"), F.concat(F.lit(pages), "id").alias("title")), "links": rows.select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))}


def contents(snapshot):
    return {n: sorted(map(tuple, df.collect())) for n, df in snapshot.tables.items()}


def test_versions_and_pins(spark, tmp_path):
    root = str(tmp_path / "wiki")
    with pytest.raises(S.SnapshotError):
        S.read_snapshot(spark, root)
    assert S.versions(spark, root) == [] and S.unpublished(spark, root) == []
    assert S.publish(spark, root, tables(spark, 3), {"input": "x"}, expected=0) == 1
    first = S.read_snapshot(spark, root)
    assert S.publish(spark, root, tables(spark, 5, "q"), expected=1) == 2
    assert len(contents(first)["pages"]) == 3 and first.provenance == {"input": "x"}  # a pinned reader
    assert len(contents(S.read_snapshot(spark, root))["pages"]) == 5 and contents(S.read_snapshot(spark, root, 1)) == contents(first)
    with pytest.raises(S.SnapshotError, match="expected"):
        S.publish(spark, root, tables(spark, 1), expected=1)
    with pytest.raises(S.SnapshotError):
        S.read_snapshot(spark, root, 7)
    history = {(r.version, r.name): r.provenance for r in S.provenance_history(spark, root).collect()}
    assert set(history) == {(1, "pages"), (1, "links"), (2, "pages"), (2, "links")} and history[1, "pages"] == {"input": "x"}
    assert len(S.unpublished(spark, root, keep=1)) == 1


def test_writer_dies_between_tables(spark, tmp_path):
    """The second table fails while it is written: readers see the version before, and the files are named as left over."""
    root = str(tmp_path / "wiki")
    S.publish(spark, root, tables(spark, 3))
    before = contents(S.read_snapshot(spark, root))
    broken = tables(spark, 9) | {"links": spark.range(9).select(F.raise_error(F.lit("dies")).alias("a"))}
    with pytest.raises(Exception, match="dies"):
        S.publish(spark, root, broken)
    assert contents(S.read_snapshot(spark, root)) == before and S.versions(spark, root) == [1]
    assert len(S.unpublished(spark, root)) == 1
    assert S.publish(spark, root, tables(spark, 4)) == 2


def test_two_writers_of_one_version(spark, tmp_path):
    """Both build upon version 1; one is published, the other fails, and the result is wholly one or the other."""
    root = str(tmp_path / "wiki")
    S.publish(spark, root, tables(spark, 1))
    done, failed = [], []

    def write(n):
        try:
            done.append((n, S.publish(spark, root, tables(spark, n), expected=1)))
        except S.SnapshotError:
            failed.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in (6, 8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = contents(S.read_snapshot(spark, root))
    if len(done) == 2:  # one had ended before the other looked: expected would have failed
        raise AssertionError("both were published")
    assert len(failed) == 1 and len(got["pages"]) == len(got["links"]) == done[0][0] and S.versions(spark, root) == [1, 2]


def test_tampering_and_loss_are_seen(spark, tmp_path):
    root = str(tmp_path / "wiki")
    S.publish(spark, root, tables(spark, 3))
    path = next(tmp_path.glob("wiki/data/*/links.parquet"))
    spark.range(3).select(F.col("id").alias("a"), (F.col("id") * 3).alias("b")).write.mode("overwrite").parquet(str(path))
    with pytest.raises(S.SnapshotError, match="differs"):
        S.read_snapshot(spark, root)
    assert S.read_snapshot(spark, root, verify=False).version == 1
    for f in list(path.glob("*")):
        f.unlink()
    path.rmdir()
    with pytest.raises(S.SnapshotError, match="cannot be read"):
        S.read_snapshot(spark, root)


def test_digest(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, [1.5]), (2, None, [1.5])], "k int, s string, v array<double>")
    assert S.table_digest(a) == S.table_digest(a.repartition(3).orderBy(F.desc("k")))
    others = [a.distinct(), a.withColumn("s", F.coalesce("s", F.lit(""))), a.withColumnRenamed("s", "t"), a.limit(0), a.withColumn("k", F.col("k").cast("long"))]
    assert len({S.table_digest(x) for x in [a, *others]}) == 6
