"""Consistent forms, look-alike pairs and exact duplicates against brute force."""

import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from proofline.llm import canon, exact_duplicates, lookalikes

ALIKE = [
    ("Plain words.", "\u0420l\u0430in w\u043erds."), ("full width", "\uff46\uff55\uff4c\uff4c \uff57\uff49\uff44\uff54\uff48"), ("caf\u00e9", "cafe\u0301"), ("no space", "no\u00a0space"),
    ("soft hyphen", "so\u00adft hy\u200bphen"), ("find fly", "\ufb01nd \ufb02y"), ("\u00c5ngstr\u00f6m", "\u212bngstr\u00f6m"), ("a\nb", "a\r\nb"), ("bold", "\U0001d41b\U0001d428\U0001d425\U0001d41d"),
    ("caf\u00e9", "caf\u0435\u0301"), ("thin  gap", "thin\u2009\u2002gap"),
]
APART = [("cafe", "caf\u00e9"), ("Case", "case"), ("a b", "a  b"), ("a-b", "a b"), ("x\u00b2", "x2"), ("\U0001f468\u200d\U0001f33e", "\U0001f468\U0001f33e"), ("a\nb", "a b")]


def _forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    return {r.id: r for r in canon.forms(df, "text", {"visual": "visual", "loose": "loose", "key": "key"}, ["id"]).collect()}


def test_alike_and_apart(spark):
    texts = [t for pair in ALIKE + APART for t in pair]
    out = _forms(spark, texts)
    for k, (a, b) in enumerate(ALIKE + APART):
        same = out[2 * k].visual == out[2 * k + 1].visual
        assert same == (k < len(ALIKE)), (a, b, out[2 * k].visual, out[2 * k + 1].visual)


def test_null_empty_long(spark):
    long = "wörd " * 40_000
    out = _forms(spark, [None, "", "  ", long])
    assert out[0].visual is None and out[0].key is None
    assert out[1].visual == "" and out[1].key == "" and out[2].key == ""
    assert len(out[3].key) == 160_000


def test_fields_in_any_order_and_notation(spark):
    a = "size: Large, red; maker: Old Mill; colour: blue 12"
    b = '{"colour": "blue 12", "maker": "old mill", "size": "large red"}'
    c = "Maker = Old Mill\nCOLOUR: Blue 12\nsize: large red"
    d = "colour: blue 12 | maker: old mill | size: small red"
    out = _forms(spark, [a, b, c, d])
    assert out[0].key == out[1].key == out[2].key != out[3].key


def test_numbers_and_order_matter(spark):
    out = _forms(spark, ["cost 1 23", "cost 12 3", "One two. Three four.", "Three four. One two.", "ONE, two three\n four"])
    assert out[0].key != out[1].key and out[2].key != out[3].key and out[2].key == out[4].key


def _disguise(text, k):
    return [text, text.upper(), text.replace(" ", "  "), text.replace("a", "а"), text.replace(" ", " "), unicodedata.normalize("NFD", text), text.replace(".", "")][k % 7]


@pytest.fixture(scope="module")
def many(spark):
    rows = [(i, _disguise(f"The café number {i % 40} is open. It has {i % 3} doors.", i // 40)) for i in range(600)]
    rows += [(1000 + i, "One text that a third of all rows hold.") for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, ""), (2003, "..."), (2004, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    return rows, df.withColumns({"key": F.lit("clash"), "visual": F.lit(1), "first_id": F.lit(2), "part": F.lit(3)})


def test_duplicate_groups_equal_brute_force(spark, many):
    rows, df = many
    forms = _forms(spark, [t for _, t in rows])
    by = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        if t is not None:
            by[forms[at].key].append(i)
    want = {(min(v), i) for v in by.values() for i in v}
    got = [tuple(r) for r in exact_duplicates.duplicate_groups(df).collect()]
    assert len(got) == len(want) and set(got) == want
    copies = {r.first_id: r.copies for r in exact_duplicates.representatives(df).collect()}
    assert copies == {min(v): len(v) for v in by.values()}


def test_runs_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame([(i, "same" if i % 10 else f"other {i}") for i in range(500)], "doc_id bigint, text string")
        got = {r.first_id: r.copies for r in exact_duplicates.representatives(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[1] == 450 and len(got) == 51


def test_look_alikes_equal_brute_force(spark, many):
    rows, df = many
    forms = _forms(spark, [t for _, t in rows])
    named = [(f"r:{i}", forms[at].visual, t) for at, (i, t) in enumerate(rows) if t is not None]
    want = set()
    by = defaultdict(list)
    for n, v, t in named:
        by[v].append((n, t))
    for v in by.values():
        for a, ta in v:
            want |= {(a, b) for b, tb in v if a < b and ta != tb}
    got = lookalikes.look_alike_pairs(df.withColumn("rec", F.concat(F.lit("r:"), F.col("doc_id").cast("string"))))
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, rec string")
    assert exact_duplicates.duplicate_groups(df).count() == 0
    assert lookalikes.look_alike_pairs(df).count() == 0
