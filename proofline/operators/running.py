"""Running sums in the order of a value, without sorting a whole group in one task.

A group's values are cut into at most ``BUCKETS`` buckets at approximate percentiles. Sums per bucket are few and go
with every row as an array; within a bucket rows are cumulated by a window. Where the cuts lie changes the cost only:
they are written once, so that every part of the plan sees the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

BUCKETS, ACCURACY = 64, 1000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.equal_null(left[k], right[f"__{k}"]) for k in keys], F.lit(True))


def _with(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``more``, which has one row per key, nulls included."""
    renamed = more.withColumnsRenamed({k: f"__{k}" for k in keys})
    return df.join(renamed, _same(df, renamed, keys)).drop(*[f"__{k}" for k in keys])


def cumulated(rows: DataFrame, keys: list[str], value: str, sums: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` (one per key and value) with ``bucket``; for each column of ``sums`` its ``_below``, the sum over the
    smaller values of the key, and its ``_whole``, the sum over all; ``parts``, the sums by bucket; and ``first``, true for
    one row of each bucket. Null keys are a
    key of their own; null values are not allowed."""
    rows = written(rows.select(*keys, value, *sums), "values")  # what follows reads them several times
    share = F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)])
    cuts = written(rows.groupBy(*keys).agg(F.percentile_approx(value, share, F.lit(ACCURACY)).alias("cuts")), "cuts")
    placed = _with(rows, cuts, keys).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    per = placed.groupBy(*keys, "bucket").agg(*[F.sum(s).alias(s) for s in sums])
    parts = per.groupBy(*keys).agg(F.collect_list(F.struct("bucket", *sums)).alias("parts"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({"first": F.sum(sums[0]).over(inside).isNull()} | {f"__{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    both = _with(local, parts, keys)

    def total(s: str, own: Column) -> Column:
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, p: acc + p[s])

    before = F.filter("parts", lambda p: p["bucket"] < F.col("bucket"))
    made = {f"{s}_below": (F.col(f"__{s}") + total(s, before)) for s in sums} | {f"{s}_whole": total(s, F.col("parts")) for s in sums}
    return both.withColumns(made).drop(*[f"__{s}" for s in sums])
