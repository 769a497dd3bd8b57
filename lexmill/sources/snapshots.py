"""Snapshots of several tables that readers see together or not at all.

A writer puts every table of a version into a folder of its own, takes their digests, and then publishes the version by one
rename of its manifest. A rename either happens or does not, and does not replace: of two writers of one version the second
fails. A writer that dies earlier leaves files that no manifest names; readers keep the version before.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SnapshotError(Exception):
    """A version that is not there, is taken already, or whose tables differ from its manifest."""


class Snapshot(NamedTuple):
    version: int
    tables: dict[str, DataFrame]
    provenance: dict[str, str]
    digests: dict[str, str]


def table_digest(df: DataFrame) -> str:
    """Hex digest of a table's columns, types and rows, whatever their order and files; repeated rows count. Rows are
    hashed where they lie and only sums are gathered. Maps are not ordered and so not allowed."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    got = df.agg(F.count("*").alias("n"), *[part(k).alias(f"s{k}") for k in range(4)]).first()
    plain = json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema]) + "|".join(str(x or 0) for x in got)
    return df.sparkSession.range(1).select(F.sha2(F.lit(plain).cast("binary"), 256)).first()[0]


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm.org.apache.hadoop.fs, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/manifests/{version:08d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, ascending."""
    hadoop, fs = _fs(spark, root)
    folder = hadoop.Path(f"{root.rstrip('/')}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:8]) for n in names if n.endswith(".json") and n[:8].isdigit())


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], provenance: dict[str, str] | None = None, expected: int | None = None) -> int:
    """Write tables as the next version and return its number.

    expected is the version that the writer built upon (0: none yet); if another has been published since, nothing is and
    SnapshotError is raised. provenance (as what the build read, and by which rules) is kept with the version.
    """
    hadoop, fs = _fs(spark, root)
    held = versions(spark, root)
    base = held[-1] if held else 0
    if expected is not None and expected != base:
        raise SnapshotError(f"version {base} is there, {expected} was expected")
    place = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    entries = {}
    for name, df in tables.items():
        df.write.parquet(f"{place}/{name}.parquet")
        written = spark.read.schema(df.schema).parquet(f"{place}/{name}.parquet")
        entries[name] = {"path": f"{place}/{name}.parquet", "schema": df.schema.json(), "digest": table_digest(written)}
    waiting = hadoop.Path(f"{place}/manifest.json")
    out = fs.create(waiting, False)
    out.write(bytearray(json.dumps({"version": base + 1, "tables": entries, "provenance": provenance or {}}, sort_keys=True).encode()))
    out.close()
    final = hadoop.Path(_manifest(root, base + 1))
    fs.mkdirs(final.getParent())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(waiting), fs.makeQualified(final), options)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise SnapshotError(f"version {base + 1} was published meanwhile") from e
        raise
    return base + 1


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file


def read_snapshot(spark: SparkSession, root: str, version: int | None = None, verify: bool = True) -> Snapshot:
    """The tables of a version, the last by default. verify compares their digests with the manifest, which reads them
    whole; a difference or a lost file is a SnapshotError. What is read stays that version, whatever is published later."""
    held = versions(spark, root)
    if not held or (version is not None and version not in held):
        raise SnapshotError(f"no version {version if version is not None else ''} under {root}")
    told = json.loads(_text(spark, _manifest(root, version or held[-1])))
    tables = {}
    for name, entry in told["tables"].items():
        try:
            df = spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])
            found = table_digest(df) if verify else entry["digest"]
        except Exception as e:
            raise SnapshotError(f"table {name} of version {told['version']} cannot be read") from e
        if found != entry["digest"]:
            raise SnapshotError(f"table {name} of version {told['version']} differs from its manifest")
        tables[name] = df
    return Snapshot(told["version"], tables, told["provenance"], {n: e["digest"] for n, e in told["tables"].items()})


def provenance_history(spark: SparkSession, root: str) -> DataFrame:
    """A row a version and table: version, name, digest, provenance (map)."""
    rows = []
    for v in versions(spark, root):
        told = json.loads(_text(spark, _manifest(root, v)))
        rows += [(v, n, e["digest"], told["provenance"]) for n, e in sorted(told["tables"].items())]
    return spark.createDataFrame(rows, "version int, name string, digest string, provenance map<string,string>")


def unpublished(spark: SparkSession, root: str, keep: int | None = None) -> list[str]:
    """Data folders that no manifest names (left by writers that died, or at work still), and with keep those of all but
    the last `keep` versions. They are named, not deleted: whoever deletes them must know that no writer or reader is left."""
    hadoop, fs = _fs(spark, root)
    folder = hadoop.Path(f"{root.rstrip('/')}/data")
    held = versions(spark, root)
    wanted = held[-keep:] if keep else held
    named = {e["path"].split("/")[-2] for v in wanted for e in json.loads(_text(spark, _manifest(root, v)))["tables"].values()}
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in named) if fs.exists(folder) else []
