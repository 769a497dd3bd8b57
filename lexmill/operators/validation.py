"""Staged validation: later stages judge only rows that earlier ones let through, and what can be mended is judged again."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.checkpoints import written

ISSUE = "array<struct<stage: string, issue: string, severity: string>>"


class Rule(NamedTuple):
    stage: str
    issue: str
    severity: str  # error or warning
    fails: Column  # null: does not fail


class Fix(NamedTuple):
    issue: str  # rows with this issue, where the condition holds
    when: Column
    values: dict[str, Column]


def judge(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with issues (in order of rules) and stage, the last stage that judged the row. A stage with an error ends a
    row's run; warnings do not. Stages come in the order of their first rules. All in one projection a stage."""
    out = rows.withColumn("issues", F.array().cast(ISSUE)).withColumn("stage", F.lit(None).cast("string"))
    for stage in dict.fromkeys(r.stage for r in rules):
        open_ = ~F.exists("issues", lambda i: i["severity"] == "error")
        found = F.array_compact(F.array(*[F.when(r.fails, F.struct(F.lit(r.stage).alias("stage"), F.lit(r.issue).alias("issue"), F.lit(r.severity).alias("severity"))) for r in rules if r.stage == stage]))
        out = out.withColumn("stage", F.when(open_, F.lit(stage)).otherwise(F.col("stage"))).withColumn("issues", F.when(open_, F.concat("issues", found)).otherwise(F.col("issues")))
    return out


def validate(rows: DataFrame, rules: list[Rule], fixes: list[Fix] | None = None, rounds: int = 3) -> DataFrame:
    """judge, then mend and judge again: rows with issues, stage, rounds (mendings of the row) and mended (their issues in
    order). In each round all fixes that apply to a row are made, the first to name a column; only rows that a fix changed
    go on. The loop ends when no fix changes a row, at the latest after `rounds` rounds; what then fails, fails.

    Rows need not be unique. Columns issues, stage, rounds and mended must not exist; fixes keep the columns' types.
    """
    kinds = dict(rows.dtypes)
    current = written(judge(rows, rules).withColumn("rounds", F.lit(0)).withColumn("mended", F.array().cast("array<string>")))
    done = []
    for _ in range(rounds if fixes else 0):
        applies = [F.coalesce(F.array_contains(F.transform("issues", lambda i: i["issue"]), f.issue) & f.when, F.lit(False)) for f in fixes]
        new: dict[str, Column] = {}
        for c in kinds:
            options = [(a, f.values[c]) for a, f in zip(applies, fixes, strict=True) if c in f.values]
            if options:
                new[c] = reduce(lambda e, o: e.when(o[0], o[1]), options[1:], F.when(*options[0])).otherwise(F.col(c)).cast(kinds[c])
        changed = F.coalesce(reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(e) for c, e in new.items()]), F.lit(False))
        marked = written(current.withColumn("_changed", changed))
        done.append(marked.where("not _changed").drop("_changed"))
        names = F.array_compact(F.array(*[F.when(a, F.lit(f.issue)) for a, f in zip(applies, fixes, strict=True)]))
        todo = marked.where("_changed").withColumn("_names", names)
        if not todo.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        mended = todo.select(*[new.get(c, F.col(c)).alias(c) for c in kinds], (F.col("rounds") + 1).alias("rounds"), F.concat("mended", "_names").alias("mended"))
        current = written(judge(mended, rules))
    return reduce(DataFrame.unionByName, [*done, current])


def report(judged: DataFrame, by: list[str]) -> DataFrame:
    """by, rows, failed, warned, rechecked and status of each group: failed (a row has an error), rechecked (none, but rows
    were mended), warned, or passed."""
    has = lambda s: F.exists("issues", lambda i: i["severity"] == s)
    out = judged.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(has("error")).alias("failed"), F.count_if(has("warning")).alias("warned"), F.count_if(F.col("rounds") > 0).alias("rechecked"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("rechecked") > 0, "rechecked").when(F.col("warned") > 0, "warned").otherwise("passed"))
