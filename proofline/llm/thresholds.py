"""Hash thresholds: a random part of each group with a given total, found with histograms and without a sort.

Each row has a hash. The hash's leading bits name its bucket; sizes are summed by group and bucket, the bucket in which
a group's budget runs out is found, and only the rows of these buckets are counted again by the next bits. The driver
sees at most ``groups x 2**BITS`` sums per level, whatever the number of rows, so the groups must be few
(a documented, small table names them). Thresholds nest: a larger budget takes all rows a smaller one takes.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, LEVELS = 12, 5
TOP = 1 << 60


def row_hash(seed: int, *columns: str) -> Column:
    """60 bits of a hash of the columns and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 4)


def find_thresholds(rows: DataFrame, budgets: dict[int, int], whole: bool = False) -> dict[int, int]:
    """For each group the threshold t such that the rows with hash < t have the largest total within the budget
    (``whole``: the least total that reaches it). ``rows`` has the columns grp int, hash bigint, size bigint."""
    low = {g: 0 for g in budgets}  # rows with hash < low are taken
    left = dict(budgets)
    open_ = set(budgets)
    spark: SparkSession = rows.sparkSession
    for level in range(LEVELS):
        shift = 60 - BITS * (level + 1)
        if not open_:
            break
        if level == 0:
            part = rows
        else:
            bounds = spark.createDataFrame([(g, low[g], low[g] + (1 << (shift + BITS))) for g in sorted(open_)], "grp int, low bigint, high bigint")
            part = rows.join(F.broadcast(bounds), "grp").filter("hash >= low and hash < high")
        sums = part.groupBy("grp", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        by = defaultdict(list)
        for r in sums:
            by[r.grp].append((r.bucket, r.size, r.n))
        for g in list(open_):
            for bucket, size, n in sorted(by[g]):
                if size <= left[g]:
                    left[g] -= size
                    continue
                low[g] = bucket << shift
                if n == 1 or level == LEVELS - 1:  # one row, or rows of equal hash, is not divided
                    if whole and left[g] > 0:
                        low[g] = (bucket + 1) << shift
                    open_.discard(g)
                break
            else:
                low[g] = TOP if level == 0 else low[g] + (1 << (shift + BITS))
                open_.discard(g)
    return low
