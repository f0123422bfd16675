"""Figures and attacks in plain Python against the Column expressions and the attacks' definitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from proofline.functions import plain
from proofline.operators import attacks
from proofline.operators.supervised import LogisticModel
from proofline.plans import engine, registry

BITS = (
    "Dr. |J. |K. L. |e.g. |Mr. Smith|Wait... Then |\"No.\" She|(Yes!) |\n|\n\n|\r\n|  |\x85|- |* **Bold**: |1. **B**: |1) |12. \n|# Head\n|> q |\x02| \x1f|\x1c| | |　|﻿|​ |"
    "а|е|İstanbul |Ⱥx |×delve× |lanKscape delve |don’t |I've |from here to there, |From A b to C d, |Not only a but also b|red, green, and blue|a, b c, and d, and e, f, and g's| -- |—|“q” |it's important to note |"
    "testament to |ſ but alſo not only x but alſo |١٢ |² ⑨ |ⁱ|Ⅳ Ⓐ |\U0001F600 |\U0001D400b |ß |ŉ |ǅ |a|the |The  |AN\t|... |!? |? A|?\" A|.. B|x, y-, and z|-, q, and z|'a, b, and c|naïve |maybe |my |; |: |??|!|(|"
    "a rich tapestry |plays a crucial role |in conclusion |x_y, 3, AND 4| word|s and more words. Then others "
).split("|")


def odd_texts(n: int) -> list[str]:
    rng = random.Random(5)
    return ["", " ", "...", *("".join(rng.choice(BITS) for _ in range(rng.choice((3, 20, 60, 150)))) for _ in range(n))]


def test_figures_and_scores_are_those_of_the_expressions(spark, small):
    texts = odd_texts(300) + [r.text for r in spark.read.parquet(f"{small}/demo_ai.parquet").select("text").limit(40).collect()]
    texts += [v for t in texts[-10:] for v in attacks.Attacker(2).all(t).values()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    model = LogisticModel(engine.PRIMARY_KEYS, [0.03 * (i * 7 % 11 - 5) for i in range(25)], 0.1, {k: (1.0, 3.0) for k in engine.PRIMARY_KEYS})
    linear, scorer = plain.linear(model), plain.Scorer()
    for r in engine._figures(df, "text").select("i", "n_words", "sents", *engine.PRIMARY_KEYS).collect():
        got = scorer.figures(texts[r.i])
        assert plain.sentences(texts[r.i]) == r.sents and (got is None) == (r.n_words == 0), texts[r.i]
        assert got is None or all(got[k] == pytest.approx(r[k], rel=1e-9, abs=1e-12) for k in engine.PRIMARY_KEYS), texts[r.i]
    for defended, used in ((False, str), (True, plain.normalized)):
        for r in engine.score_texts(df, model=model, defended=defended).select("i", "score").collect():
            assert scorer.score(used(texts[r.i]), linear) == pytest.approx(r.score, abs=1e-9), texts[r.i]


def test_attacks_are_those_of_their_definitions():
    attacker = attacks.Attacker(3)
    for t in odd_texts(300):
        assert attacker.all(t) == {n: attacks.apply(n, t, 3) for n in attacks.attack_names()}


def test_classes_of_characters_are_those_of_java(spark):
    """What Python's classes stand for, for all characters that Java 17 and Python both know."""
    kinds = {"s": r"[\s\x1C-\x1F]", "js": r"\s", "w": r"[\p{L}\p{N}_]", "d": r"[\p{Nd}²³¹⁰-⁹₀-₉①-⑨]", "u": r"\p{Upper}"}
    made = {"s": lambda c: re.fullmatch(r"\s", c), "js": lambda c: re.fullmatch(plain._S, c), "w": lambda c: re.fullmatch(r"\w", c), "d": lambda c: c.isdecimal() or c in plain._DIGITS, "u": str.isupper}
    all_ = [(chr(i),) for i in range(0x3100) if chr(i).isprintable() or i < 0x2100]
    got = spark.createDataFrame(all_, "c string").select("c", *[F.col("c").rlike(rf"(?U)\A{p}\z").alias(k) for k, p in kinds.items()]).filter(F.col("c").rlike(r"\A\P{Cn}\z")).collect()
    assert len(got) > 10_000
    for k, f in made.items():
        assert not [r.c for r in got if bool(f(r.c)) != r[k]], k


def test_primary_of_plain_figures(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("text", "label")
    a, b = engine.fit_primary(df), engine.fit_primary_plain(df)
    assert a.keys == b.keys and a.weights == pytest.approx(b.weights, abs=1e-6) and a.bias == pytest.approx(b.bias, abs=1e-6)


def test_registered_robustness_on_odd_rows(spark, small, tmp_path):
    """A null text has no score (it used to score 1), and rows that share an id are rows (they used to be paired)."""
    ai = spark.read.parquet(f"{small}/demo_ai.parquet").select("doc_id", "text").orderBy("doc_id").limit(12)
    rows = [(r.doc_id, r.text) for r in ai.collect()]
    spark.createDataFrame([*rows, (-1, None), rows[0]], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "demo_ai.parquet"))
    (tmp_path / "documents.parquet").symlink_to(f"{small}/documents.parquet")
    model = engine.fit_primary(spark.read.parquet(f"{small}/documents.parquet").select("text", "label"))
    given = spark.createDataFrame([(i, n, t, attacks.apply(n, t)) for i, (_, t) in enumerate([*rows, rows[0]]) for n in attacks.attack_names()], "i int, attack string, text string, attacked string")
    mean = lambda column, defended: {r.attack: r.m for r in engine.score_texts(given, column, model, defended).groupBy("attack").agg(F.avg("score").alias("m")).collect()}
    base, raw, safe = mean("text", True), mean("attacked", False), mean("attacked", True)
    got = registry.queries()["robustness"](spark, str(tmp_path)).collect()
    assert sorted(r.attack for r in got) == attacks.attack_names()
    for r in got:
        assert r.n == 14 and (r.baseline, r.undefended, r.defended) == pytest.approx((base[r.attack], raw[r.attack], safe[r.attack]), abs=2e-6)
        assert (r.drop, r.residual) == pytest.approx((r.baseline - r.undefended, r.baseline - r.defended), abs=2e-6)
