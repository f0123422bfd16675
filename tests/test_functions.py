"""Words, sentences, normalisation, lexicon and combination, by hand-computed cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.functions import combine, detectors, features, language_models, normalize
from proofline.functions import text as T
from proofline.operators import attacks


def on(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_words(spark):
    got = on(spark, ["It’s A Café, isn't it? 42 'quoted'", "", None, "naïve über"], T.words)
    assert got == [["it's", "a", "café", "isn't", "it", "quoted"], [], None, ["naïve", "über"]]


SENTENCES = {
    "J. R. R. Tolkien wrote it. It sold well.": 2, "We tried plan A. It failed. We tried B. It worked.": 4, "- one thing\n- two things\n- three things": 3, "1. First thing\n2. Second thing\n3. Third": 3,
    "Dr. Smith left. He ran.": 2, "The answer was no. Then we left.": 2, "We finished ... Eventually it ended.": 1, 'He said "Stop." Then he left.': 2, "soft\nwrapped line. Next\none": 2, "a para\n\nanother": 2,
    "": 0, "  \n ": 0, "# Heading\ntext follows": 1, "-\nx": 1,
}


def test_sentences(spark):
    got = on(spark, list(SENTENCES), T.sentences)
    assert [len(s) for s in got] == list(SENTENCES.values()), list(zip(SENTENCES, got))


def test_initials_absorb_only_when_alone(spark):
    assert on(spark, ["Dr. J. Then we went.", "A. B. Carter came. He left."], T.sentences) == [["Dr. J.", "Then we went."], ["A. B. Carter came.", "He left."]]


def test_array_statistics(spark):
    got = on(spark, [[], [4.0], [1.0, 3.0, 5.0]], lambda v: F.array(T.mean(v), T.stdev(v)), "array<double>")
    assert got == [[0.0, 0.0], [4.0, 0.0], [3.0, 2.0]]


def test_mattr(spark):
    rng = random.Random(2)
    lists = [["a"] * 100, ["a", "b", "a"], [], [rng.choice("abcdefghij") for _ in range(90)]]
    w = lists[3]
    want = [1 / 50, 2 / 3, 0.0, np.mean([len(set(w[i : i + 50])) / 50 for i in range(41)])]
    assert on(spark, lists, T.mattr, "array<string>") == pytest.approx(want)


def test_normalise(spark):
    assert on(spark, ["Неllo wo​rld", "ｆｉ ﬁ", None, ""], normalize.normalized) == ["Hello world", "fi fi", None, ""]
    df = spark.createDataFrame([("\u0430bc\u200b\u00a0d",), ("plain",), ("",)], "t string")
    c = normalize.counts(F.col("t"))
    rows = df.select(*[v.alias(k) for k, v in c.items()]).collect()
    assert rows[0].homoglyphs_replaced == 1 and rows[0].invisibles_removed == 1 and rows[0].odd_spaces_replaced == 1 and rows[0].n_chars == 6 and rows[0].is_suspicious
    assert rows[0].tamper_rate == pytest.approx(0.5) and rows[2].tamper_rate == 0.0 and not rows[1].is_suspicious
    assert on(spark, ["é я x", "plain"], normalize.scripts) == [["CYRILLIC", "LATIN"], []]


TEXT = "The harbour was quiet, and nobody spoke of it. “Well,” she said, “it's a pity - the ship has gone.” " * 6


def test_attacks_are_undone_or_not(spark):
    for name in attacks.attack_names():
        a = attacks.apply(name, TEXT, 3)
        assert a == attacks.apply(name, TEXT, 3) and a != TEXT
        back = on(spark, [a, TEXT], normalize.normalized)
        assert (back[0] == back[1]) == (name in ("homoglyph", "zero_width", "whitespace")), name
    with pytest.raises(ValueError):
        attacks.apply("none", TEXT)
    assert on(spark, [None, TEXT], lambda v: attacks.attacked("casing", v, 1))[0] is None


def test_lexicon_claims_each_span_once():
    assert detectors.claim("in the realm of scheduling, a rich tapestry of constraints applies") == {"in the realm of": 1, "a rich tapestry": 1}
    assert detectors.claim("it serves as a double-edged sword") == {"a double-edged sword": 1}
    assert detectors.claim("édelve delved where are some") == {}
    assert detectors.claim("delve delve, delves") == {"delve": 2, "delves": 1}
    assert detectors.claim("it’s important to note") == {}


def test_structure_and_triads(spark):
    text = "- **Lead**: x\n1. **Lead**, y\n# Head\nNot only this but also that. From dawn to dusk, we ran. Clear, concise, and compelling."
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(*[c.alias(n) for n, c in detectors.structural_hits(F.col("t")).items()], detectors.triads(F.col("t")).alias("triads")).first()
    assert tuple(row) == (1, 1, 1, 1, 1, 1)


def test_detectors_without_words(spark):
    df = detectors.scored(spark.createDataFrame([(1, ""), (2, "123 456"), (3, "Short text."), (4, "The dog ran. It sat. We saw. They left. " * 8)], "doc_id int, text string"))
    rows = {r.doc_id: r for r in df.select("doc_id", "stylometry_score", "stylometry_reliable", "phrases_score", "phrases_reliable").collect()}
    assert all(rows[i].stylometry_score == rows[i].phrases_score == 0.5 for i in (1, 2))
    assert not rows[3].stylometry_reliable and rows[4].stylometry_reliable and rows[4].phrases_reliable
    assert all(0 <= r.stylometry_score <= 1 and 0 <= r.phrases_score <= 1 for r in rows.values())


def test_features(spark):
    df = spark.createDataFrame([(1, "I'm here; maybe. Look: 12 — now? (Yes!)"), (2, "")], "doc_id int, text string")
    a, b = features.feature_table(df).orderBy("doc_id").collect()
    assert b.burstiness is None and b.n_words == 0
    assert a.n_words == 6 and a.semicolon_per_kw == a.colon_per_kw == a.question_per_kw == a.em_dash_per_kw == pytest.approx(1000 / 6)
    assert a.first_person_per_kw == pytest.approx(1000 / 6) and a.digit_rate == pytest.approx(2 / 39) and a.log_n_words == pytest.approx(math.log1p(6))


def test_combination(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.2), (None, 0.4, 0.6)], "p double, a double, b double")
    parts = {"phrases": F.col("a"), "stylometry": F.col("b")}
    r = df.select(combine.blend(F.col("p"), parts).alias("x"), combine.blend(F.col("p"), {}).alias("y"), combine.ood_gap(F.col("p"), [F.col("a"), F.col("b")]).alias("g")).collect()
    assert r[0].x == pytest.approx(0.64) and r[1].x == pytest.approx(0.5) and r[1].y == 0.5 and r[0].g == pytest.approx(0.9) and r[1].g == 0.0
    got = on(spark, ["verified_ai", "invalid", "verified_human_claim", "absent", None], lambda s: combine.with_provenance(F.lit(0.95), s))
    assert got == pytest.approx([0.99, 1.0, 0.95, 0.95, 0.95])


def test_plugged_in_detector(spark):
    run = detectors.model_detector("half", lambda texts: [None if not t else 2.0 for t in texts])
    rows = run(spark.createDataFrame([("word " * 60,), ("",), (None,)], "text string")).collect()
    assert [(r.half_score, r.half_reliable) for r in rows][:2] == [(1.0, True), (0.5, False)]
    detectors.register("half", run)
    try:
        assert "half" in detectors.available_detectors() and detectors.detector("half") is run
    finally:
        del detectors._REGISTRY["half"]
    with pytest.raises(ValueError):
        detectors.detector("nothing")
    with pytest.raises(NotImplementedError):
        detectors.TransformerClassifier().score_batch([""])


def test_language_model_arithmetic():
    assert language_models.perplexity_score(None, []) is None and language_models.perplexity_score(3.65, []) == pytest.approx(0.5)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(5, 7)), rng.normal(size=(5, 7))
    same, other = language_models.binoculars_ratio(a, a, [1, 2, 3, 4, 5]), language_models.binoculars_ratio(a, b, [1, 2, 3, 4, 5])
    assert same != other and language_models.binoculars_ratio(a, b, [1]) is None and language_models.binoculars_score(0.94) == pytest.approx(0.5)
