"""Problem 8: combining sources to target weights.

A source's target is its weight times the tokens of all sources listed. Whole copies of the source are used as long as
the target allows and ``max_repeats`` permits; the rest is a random part of its documents, found by a hash threshold.

Nulls: a null source is in no mix, a null text has no tokens. A source that is listed and has no documents reaches 0
and is short if its weight is positive. If the listed tokens are 0, nothing is short and the mix is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .thresholds import find_thresholds, row_hash
from .tokens import with_tokens


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the documents of listed sources, written once."""
    names = [r.source for r in targets.select("source").distinct().collect() if r.source is not None]
    some = documents.select("doc_id", "source", "text").filter(F.col("source").isin(names))
    more = {"vocabulary": vocabulary} if vocabulary else {}
    return written(with_tokens(some, "text", ["doc_id", "source"], **more), "sized")


def source_budgets(tokens: DataFrame, targets: DataFrame) -> list[tuple]:
    """(source, weight, max_repeats, tokens, target tokens, short) for each listed source: one aggregate."""
    have = {r.source: r.t for r in tokens.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = sum(have.values())
    out = []
    for r in targets.dropDuplicates(["source"]).orderBy("source").collect():
        own = have.get(r.source, 0) or 0
        out.append((r.source, r.weight, r.max_repeats, own, r.weight * total, r.max_repeats * own < r.weight * total))
    return out


def mix(tokens: DataFrame, targets: DataFrame, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(the mix: doc_id, source, tokens, copies; the report: one row per listed source)."""
    spark = tokens.sparkSession
    budgets = source_budgets(tokens, targets)
    code = {b[0]: i for i, b in enumerate(budgets)}
    wholes, rest = {}, {}
    for source, _, most, own, goal, short in budgets:
        whole = most if short else int(goal // own) if own else 0
        wholes[source] = whole
        if not short and own and whole < most:
            rest[code[source]] = int(goal - whole * own)
    names = F.broadcast(spark.createDataFrame([(s, i, wholes[s]) for s, i in code.items()], "source string, grp int, whole int"))
    rows = tokens.join(names, "source").withColumn("hash", row_hash(seed, "doc_id"))
    limits = find_thresholds(rows.select("grp", "hash", F.col("tokens").alias("size")), rest) if rest else {}
    bounds = F.broadcast(spark.createDataFrame([(g, t) for g, t in limits.items()] or [(-1, 0)], "grp int, at bigint"))
    mixed = rows.join(bounds, "grp", "left").select("doc_id", "source", "tokens", (F.col("whole") + F.when(F.col("hash") < F.col("at"), 1).otherwise(0)).alias("copies")).filter("copies > 0")
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"))
    listed = spark.createDataFrame(budgets, "source string, weight double, max_repeats int, tokens bigint, target double, short boolean")
    report = listed.join(F.broadcast(reached), "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    total = report.agg(F.sum("reached").alias("all"))
    report = report.crossJoin(F.broadcast(total)).withColumn("share", F.expr("try_divide(reached, `all`)")).drop("all")
    return mixed, report
