"""The exact join against brute force over all pairs."""

import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

import pytest

from proofline.llm import canon, near_duplicates
from proofline.llm.components import components
from proofline.llm.records import records


def brute(spark, rows, width, threshold, inclusive=False):
    df = spark.createDataFrame(rows, "rec string, text string")
    sets, keys = {}, {}
    for r in canon.forms(df, "text", {"loose": "loose", "key": "key"}, ["rec"]).collect():
        if r.loose is not None:
            w = r.loose.split()
            keys[r.rec] = r.key
            if len(w) >= width:
                sets[r.rec] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    out = set()
    for a, b in combinations(sorted(sets), 2):
        if keys[a] != keys[b]:
            both = len(sets[a] & sets[b])
            whole = Fraction(threshold).limit_denominator(1000) * (len(sets[a]) + len(sets[b]) - both)
            if both > whole or (inclusive and both == whole):
                out.add((a, b))
    return out


def corpus(seed, n=60, edits=6):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            if rng.random() < 0.2:
                at = rng.randrange(len(w) + 1)
                w = w[at:] + w[:at]
        else:
            w = rng.choices(vocabulary, k=rng.randint(0, 60))
        rows.append((f"r:{i}", " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,width,threshold,inclusive", [(1, 3, 0.5, False), (2, 5, 0.8, True), (3, 2, 0.3, False), (4, 3, 0.5, True)])
def test_equals_brute_force(spark, seed, width, threshold, inclusive):
    rows = corpus(seed, edits=1 if threshold > 0.7 else 6) + [("n:1", None), ("n:2", ""), ("n:3", "two words"), ("c:1", "a b c d e f"), ("c:2", "A, b c D e f!")]
    df = spark.createDataFrame(rows, "rec string, text string").selectExpr("*", "1 AS cid", "'x' AS runs")
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(df, width=width, threshold=threshold, inclusive=inclusive).collect()]
    want = brute(spark, rows, width, threshold, inclusive)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_whole_tables(spark, small):
    df = records(spark, small, "ai", "orig", "reph")
    want = brute(spark, [tuple(r) for r in df.collect()], 3, 0.5)
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, width=3, threshold=0.5, inclusive=False).collect()} == want


def test_groups(spark):
    rows = corpus(7) + [("z:1", "alone " * 2), ("z:2", "Alone, alone"), ("z:3", None), ("z:4", None)]
    df = spark.createDataFrame(rows, "rec string, text string")
    got = {r.rec: r for r in near_duplicates.near_duplicate_groups(df, width=3, threshold=0.5, inclusive=False).collect()}
    assert len(got) == len(rows)
    assert got["z:1"].group_id == got["z:2"].group_id == "z:1" and got["z:3"].group_id == "z:3" and got["z:4"].group_id == "z:4" and got["z:4"].n_links == 0
    parent = {r: r for r, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(spark, rows, 3, 0.5):
        parent[root(a)] = root(b)
    groups = {}
    for r in got:
        if not r.startswith("z"):
            groups.setdefault(root(r), set()).add(r)
    for members in groups.values():
        ids = {got[m].group_id for m in members}
        assert len(ids) == 1 and min(members) >= ids.copy().pop()


def test_inclusive_bound(spark):
    """Eight of ten runs in common is a similarity of exactly 0.8."""
    words = [f"v{k}" for k in range(12)]
    df = spark.createDataFrame([("a", " ".join(words[:-1])), ("b", " ".join(words[1:]))], "rec string, text string")
    count = lambda width, **more: near_duplicates.near_duplicate_pairs(df, width=width, threshold=0.8, **more).count()
    assert count(3) == 1 and count(3, inclusive=False) == 0


def test_regions():
    """Every set is within the radius of its pivot, pivots are their own, large regions are divided again."""
    rng = random.Random(5)
    base = [set(range(k * 1000, k * 1000 + 100)) for k in range(3)]
    sets = []
    for _ in range(300):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            s.discard(rng.choice(sorted(s)))
        sets.append(frozenset(s))
    home = near_duplicates.divide(sets, 0.2)
    sizes = Counter(p for p, _ in home)
    assert all(near_duplicates.distance(sets[i], sets[p]) == pytest.approx(d) and d <= 0.2 for i, (p, d) in enumerate(home))
    assert all(home[p] == (p, 0.0) for p, _ in home) and len(sizes) > 3 and max(sizes.values()) < 100


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == 100 and len(got) == 44
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "rec string, text string")
    assert near_duplicates.near_duplicate_pairs(df).count() == 0
    assert near_duplicates.near_duplicate_groups(df).count() == 0
