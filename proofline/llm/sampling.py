"""Problem 5: a sample with given category proportions.

Records are counted by category signature (their categories in all fields of the table at once; a category without a
target counts as "other"). The number of signatures is bounded by the target table. A random sample that meets the
floors is drawn as signature counts: first what the floors need, then a random rest. Counts are exchanged between
signatures while that lowers the deviation from the targets and breaks no floor; the result is drawn from the records by hash thresholds, without collecting or sorting them.

Categories are compared without outer blanks and letter case. Nulls: a null category, or a null in a struct above it,
is "other". A category with fewer rows than it needs gives all it has and is reported as short. A table with no rows
gives an empty sample, and all its categories with a positive need are short.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .thresholds import find_thresholds, row_hash


@dataclass
class Target:
    field: str
    category: str
    share: float
    min_rows: int


def folded(column: Column) -> Column:
    return F.lower(F.regexp_replace(column.cast("string"), r"(?U)^\s+|\s+$", ""))


def _start(available: np.ndarray, cats: np.ndarray, floor: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A random sample that meets the floors as far as rows allow: it has ``size`` rows, or more if the floors need more."""
    x = np.zeros(available.size, np.int64)
    held = lambda c: (cats == c).any(0)
    for c in sorted(range(len(floor)), key=lambda c: (available[held(c)].sum() - floor[c], c)):  # the scarcest first
        own = rng.permutation(np.flatnonzero(held(c)))
        while (need := floor[c] - x[own].sum()) > 0 and (free := own[x[own] < available[own]]).size:
            x[free] += np.minimum(available[free] - x[free], -(-need // free.size)) * (np.arange(free.size) < need)
    rest = max(0, size - int(x.sum()))
    left = available - x
    more = np.minimum(np.floor(left * rest / max(1, left.sum()) + rng.random(left.size)).astype(np.int64), left)
    while d := rest - int(more.sum()):
        free = np.flatnonzero(left > more) if d > 0 else np.flatnonzero(more > 0)
        more[rng.permutation(free)[: abs(d)]] += np.sign(d)
    return x + more


def repair(available: np.ndarray, cats: np.ndarray, goal: np.ndarray, floor: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Counts per signature: at most ``available``, ``size`` in all if there are as many, category counts at least
    ``floor`` where rows allow, and near ``goal``. ``cats[f, s]`` is the target that signature s has in field f, or -1.

    What an exchange changes is a sum over fields but for those in which both signatures have one category, where it
    changes nothing. So the best exchange is found per set of shared fields from the best giver and the best taker of
    each combination of categories, in time linear in the signatures."""
    size = int(min(size, available.sum()))
    if size <= 0 or available.size == 0:
        return np.zeros(available.size, np.int64)
    of = lambda x: np.array([x[(cats == c).any(0)].sum() for c in range(len(goal))], np.int64)
    floor = np.minimum(floor, of(available))
    x = _start(available, cats, floor, size, rng)
    shared = []
    for k in range(len(cats) + 1):
        for fields in combinations(range(len(cats)), k):
            groups = np.unique(cats[list(fields)], axis=1, return_inverse=True)[1].ravel() if fields else np.zeros(available.size, np.int64)
            shared.append((list(fields), groups))
    blocked = 1e9
    step = 1 << max(0, int(x.max()).bit_length() - 1)
    while step:
        have = of(x)
        off = np.abs(have - goal)
        less = np.append(np.abs(have - step - goal) - off + np.where(have - step < floor, blocked, 0.0), 0.0)  # last: no target
        more = np.append(np.abs(have + step - goal) - off, 0.0)
        give = np.where(x >= step, less[cats].sum(0), np.inf)
        take = np.where(available - x >= step, more[cats].sum(0), np.inf)
        best = (-1e-9, None, None)
        for fields, groups in shared:
            givers, takers = np.lexsort((give, groups)), np.lexsort((take, groups))
            heads = np.flatnonzero(np.diff(groups[givers], prepend=-1))
            g, t = givers[heads], takers[heads]
            same = (less + more)[cats[fields][:, g]].sum(0) if fields else 0.0
            with np.errstate(invalid="ignore"):
                gain = np.nan_to_num(give[g] + take[t] - same, nan=np.inf)
            at = int(gain.argmin())
            if gain[at] < best[0]:
                best = (gain[at], g[at], t[at])
        if best[1] is not None and best[1] != best[2]:
            x[best[1]] -= step
            x[best[2]] += step
        else:
            step >>= 1
    return x


def plan(df: DataFrame, targets: list[Target], fraction: float, seed: int = 7):
    """(signature column, counts to draw per signature code, report rows). One aggregate of ``df``."""
    fields = list(dict.fromkeys(t.field for t in targets))
    rank = {(t.field, t.category.strip().lower()): i for i, t in enumerate(targets)}
    code = F.lit(0).cast("int")
    bases = []
    for field in fields:
        own = [(c, i) for (f, c), i in rank.items() if f == field]
        one = F.coalesce(F.create_map(*[F.lit(v) for k, (c, _) in enumerate(own) for v in (c, k + 1)])[folded(F.col(field))], F.lit(0))
        code = code * (len(own) + 1) + one
        bases.append([-1, *(i for _, i in own)])
    counts = {r.code: r.n for r in df.groupBy(code.alias("code")).agg(F.count("*").alias("n")).collect()}
    codes = sorted(counts)
    cats = np.full((len(fields), len(codes)), -1)
    for s, c in enumerate(codes):
        for f in reversed(range(len(fields))):
            c, k = divmod(c, len(bases[f]))
            cats[f, s] = bases[f][k]
    available = np.array([counts[c] for c in codes], np.int64)
    total = int(available.sum())
    size = int(round(fraction * total))
    goal = np.array([t.share * size for t in targets])
    x = repair(available, cats, goal, np.array([t.min_rows for t in targets], np.int64), size, np.random.default_rng(seed))
    have, drawn = ([int(v[(cats == c).any(0)].sum()) for c in range(len(targets))] for v in (available, x))
    report = [(t.field, t.category, float(max(t.share * fraction * total, t.min_rows)), int(h), int(d), bool(h < max(t.share * fraction * total, t.min_rows))) for t, h, d in zip(targets, have, drawn)]
    return code, dict(zip(codes, (int(v) for v in x))), report


REPORT = "field_name string, category string, needed double, available bigint, drawn bigint, short boolean"


def sample_report(df: DataFrame, targets: list[Target], fraction: float, seed: int = 7) -> DataFrame:
    """One row per target: rows needed, available, drawn, and whether the category falls short."""
    return df.sparkSession.createDataFrame(plan(df, targets, fraction, seed)[2], REPORT)


def draw(df: DataFrame, targets: list[Target], fraction: float, key: str, seed: int = 7) -> DataFrame:
    """The sample itself: all columns of ``df`` for the drawn rows. ``key`` names a unique column."""
    code, x, _ = plan(df, targets, fraction, seed)
    spark = df.sparkSession
    hashed = df.select(code.alias("grp"), row_hash(seed, f"`{key}`").alias("hash"), F.lit(1).cast("bigint").alias("size"))
    limits = find_thresholds(hashed, x) if x else {}
    bounds = F.broadcast(spark.createDataFrame([(int(g), int(t)) for g, t in limits.items()] or [(-1, 0)], "__grp int, __limit bigint"))
    return df.join(bounds, code == F.col("__grp")).filter(row_hash(seed, f"`{key}`") < F.col("__limit")).drop("__grp", "__limit")
