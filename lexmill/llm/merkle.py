"""Merkle manifest of a dataset: trees of hashes by group, a tree over the groups' roots, and each row's path to the root.

A level is one window: partitioned by group and parent index, its ordered full-frame collect_list gives every node its
siblings and the parent's preimage at once; the first node of each run stays as the parent. Paths come down from the root
the same way, by joins of a level's runs with the paths of their parents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import places, saved


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value as text: no two rows of values share a preimage."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to by a proof: array<struct<left, right>> of sibling digests, the lowest level first."""
    return F.aggregate(proof, leaf, lambda acc, at: F.sha2(F.concat(at["left"], acc, at["right"]), 256))


def proof_digests(proof: Column) -> Column:
    """All sibling digests of a proof in one text, level by level, left to right."""
    return _joined(F.transform(proof, lambda at: F.concat(at["left"], at["right"])))


def _levels(nodes: DataFrame, node: Column, arity: int) -> list[DataFrame]:
    """Tables of runs from the leaves up, (grp, idx, width, children, digest); width is the number of nodes of the group
    on the run's own level, 1 at its top. nodes: grp, idx, width and what the column node (a struct with digest) needs."""
    most, levels = nodes.agg(F.max("width")).first()[0] or 0, []
    while most > 1:
        run = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        told = nodes.where("width > 1").withColumn("parent", F.floor(F.col("idx") / arity)).withColumn("children", F.collect_list(node).over(run))
        parents = told.where(F.col("idx") % arity == 0).select("grp", F.col("parent").alias("idx"), F.ceil(F.col("width") / arity).alias("width"), "children")
        nodes = saved(parents.withColumn("digest", F.sha2(_joined(F.col("children.digest")), 256)))
        levels.append(nodes)
        node, most = F.struct("digest"), -(-most // arity)
    return levels


def _unfolded(runs: DataFrame, arity: int) -> DataFrame:
    """A row for each child of runs (grp, idx, children, proof and more): child, its idx and its proof; the rest stays."""
    rest = [c for c in runs.columns if c not in ("idx", "children", "proof")]
    told = runs.select(*rest, F.col("idx").alias("above"), F.col("children.digest").alias("digests"), F.col("proof").alias("upper"), F.posexplode("children").alias("pos", "child"))
    left, right = _joined(F.slice("digests", F.lit(1), F.col("pos"))), _joined(F.slice("digests", F.col("pos") + 2, F.lit(arity)))
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    return told.select(*rest, (F.col("above") * arity + F.col("pos")).alias("idx"), "child", F.concat(step, "upper").alias("proof"))


def _proofs(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """Children of the lowest level with their proofs; tops (grp, proof and more) has where each group's root stands."""
    carried = [c for c in tops.columns if c not in ("grp", "proof")]
    below = None
    for runs in reversed(levels):
        at = runs.where("width = 1").select("grp", "idx").join(tops, "grp").select("grp", "idx", "proof", *carried)
        at = at if below is None else at.unionAll(below.select("grp", "idx", "proof", *carried))
        below = _unfolded(runs.select("grp", "idx", "children").join(at, ["grp", "idx"]), arity)
    return below


def merkle_manifest(rows: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", keep: list[str] | None = None, arity: int = 16) -> DataFrame:
    """One row a row: id_col, group_col, the columns of keep, leaf, subroot (of its group), root (of all), and proof, an
    array<struct<left, right>> of sibling digests from the leaf's run up to the root.

    Leaves of a group ascend by id (null first), rows of one id by leaf; each run of `arity` nodes becomes the sha256 of
    its digests joined, the last run too if shorter, until one is left; a lone leaf is its own subroot. Subroots in order
    of their group (null first, bytewise) form the tree above. A lone subroot is the root, and its proof ends there.
    Equal rows are leaves each. Nulls count by `leaf`; extra columns play no part. An empty table gives no row.
    """
    keep = keep or []
    names = {c: f"kept{k}" for k, c in enumerate(keep)}
    grp = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(group_col).cast("string")))
    slim = saved(rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("given"), grp.alias("grp"), leaf.alias("digest"), *[F.col(c).alias(n) for c, n in names.items()]))
    leaves = saved(places(slim, ["id", "digest"]))
    levels = _levels(leaves, F.struct("id", "given", "digest", *names.values()), arity)
    ends = [leaves.where("width = 1").select("grp", "digest")] + [x.where("width = 1").select("grp", "digest") for x in levels]
    subroots = reduce(DataFrame.unionAll, ends).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    groups = saved(places(subroots, ["of"]))
    upper = _levels(groups, F.struct("of", "digest"), arity)
    none = F.array().cast("array<struct<left:string,right:string>>")
    if upper:
        root = upper[-1].select("grp", F.col("digest").alias("root"), none.alias("proof"))
        found = _proofs(upper, root, arity).select("child.of", F.col("child.digest").alias("subroot"), "root", "proof")
    else:
        found = groups.select("of", F.col("digest").alias("subroot"), F.col("digest").alias("root"), none.alias("proof"))
    tops = saved(found.withColumnRenamed("of", "grp"))
    out = [F.col("id").alias(id_col), F.col("given").alias(group_col), *[F.col(n).alias(c) for c, n in names.items()], F.col("digest").alias("leaf"), "subroot", "root", "proof"]
    lone = leaves.where("width = 1").select("grp", "id", "given", "digest", *names.values()).join(tops, "grp").select(*out)
    if not levels:
        return lone
    return _proofs(levels, tops, arity).select("child.*", "subroot", "root", "proof").select(*out).unionAll(lone)
