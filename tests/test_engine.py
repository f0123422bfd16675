"""The whole engine with its supervised primary, provenance and spans."""

import json
import math

import pytest
from pyspark.sql import functions as F

from proofline import cli
from proofline.operators.supervised import LogisticModel
from proofline.plans import engine, registry

PLAIN, ASKED = "The dog ran to the old mill by the river.", "Did the dog run to the old mill by it?"
HALF = " ".join([PLAIN] * 18 + [ASKED] * 18)


def test_blend_ood_provenance_and_spans(spark):
    """The primary is logistic(questions per 1,000 words - 60). HALF has 50, so 1 / (1 + e^10); all questions have 100.

    36 sentences of 10 words have the windows 0-12, 6-18, 12-24, 18-30, 24-36, whose primary scores are 0, 0, 0, 1, 1.
    Sentences 0-17 have the mean 0, 18-23 one half, 24-35 one. At or above one half: 18 of 36. The best cut is at 18:
    a shift of (6 / 2 + 12) / 18 = 5/6."""
    model = LogisticModel(["question_per_kw"], [1.0], 0.0, {"question_per_kw": (60.0, 1.0)})
    texts = [(0, HALF, None), (1, HALF, "invalid"), (2, HALF, "verified_ai"), (3, HALF, "verified_human_claim"), (4, " ".join([ASKED] * 36), None), (5, "...", None)]
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s in texts], "doc_id bigint, text string, language string, status string")
    calibrations = spark.createDataFrame([("en", 0.05, 100, 0.9, [], {}, {})], "language string, alpha double, n_calibration bigint, global_threshold double, bin_edges array<int>, bin_thresholds map<int,double>, bin_counts map<int,bigint>")
    got = {r.doc_id: r for r in engine.analyze(df, calibrations, model=model, provenance="status").collect()}
    mean = {i: (got[i].phrases_score + got[i].stylometry_score) / 2 for i in got}
    low = 1 / (1 + math.exp(10))
    assert got[0].primary == pytest.approx(low) and got[4].primary == pytest.approx(1) and got[5].primary is None
    assert got[0].score == pytest.approx(0.6 * low + 0.4 * mean[0]) and got[4].score == pytest.approx(0.6 + 0.4 * mean[4])
    assert got[5].score == pytest.approx(0.5) and got[5].ood_gap == 0 and not got[5].is_ood
    assert all(got[i].ood_gap == pytest.approx(abs(got[i].primary - mean[i])) and got[i].is_ood == (got[i].ood_gap >= 0.45) for i in range(5))
    assert mean[4] < 0.55 and got[4].is_ood
    assert got[1].score == pytest.approx(got[0].score + 0.1) and got[2].score == 0.99 and got[3].score == got[0].score
    assert [got[i].verdict for i in range(6)] == ["mixed", "mixed", "ai", "mixed", got[4].verdict, "abstain"]
    assert got[0].ai_word_fraction == 0.5 and got[4].ai_word_fraction == 1 and got[5].ai_word_fraction is None
    assert got[0].change_point.cut == 18 and got[0].change_point.delta == pytest.approx(5 / 6, abs=1e-4)


def test_fit_primary(spark):
    rows = [(f"We saw the dog {i}. It ran off. Nobody knew why it left so soon.", 0) for i in range(6)] + [(f"Furthermore, the vibrant tapestry {i} underscores a seamless journey.", 1) for i in range(6)]
    df = spark.createDataFrame([*rows, ("...", 1), (None, 0), ("A text.", None)], "text string, label int")
    model = engine.fit_primary(df)
    assert {"detector_phrases", "detector_stylometry", "mattr"} <= set(model.keys) and len(model.keys) == 25
    got = engine.score_texts(df.limit(12), model=model).collect()
    assert max(r.score for r in got if r.label == 0) < min(r.score for r in got if r.label == 1)
    with pytest.raises(ValueError):
        engine.fit_primary(df.filter("label = 1"))


def test_registered_engine_uses_model_and_provenance(spark, small):
    a = registry.queries()["engine_analyze"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    worded = a[a.n_words > 0]
    assert len(worded) and worded.primary.notna().all() and (worded.ood_gap > 0).any()
    signed = a[a.source == "model_outputs_a"]
    assert len(signed) and (signed.verdict == "ai").all() and (signed.verdict_score >= 0.99).all()
    bare = {r.doc_id: r.score for r in engine.score_texts(spark.read.parquet(f"{small}/documents.parquet").filter("text is not null").select("doc_id", "text")).select("doc_id", "score").collect()}
    got = {r.doc_id: r.score for r in registry.queries()["engine_score_texts"](spark, small).collect()}
    assert set(got) == set(bare) and any(abs(got[i] - bare[i]) > 0.01 for i in got)


def test_command_line_trains(spark, tmp_path, capsys):
    train = tmp_path / "t.jsonl"
    train.write_text("".join(json.dumps({"text": t, "label": k}) + "\n" for i in range(6) for t, k in ((f"We saw the dog {i}. It ran off.", 0), (f"Furthermore, the vibrant tapestry {i} underscores a journey.", 1))))
    text = ["--text", HALF]
    assert cli.main(["analyze", *text, "--train", str(train)], spark) == 0
    assert not any(line.split()[:2] == ["primary", "n/a"] for line in capsys.readouterr().out.splitlines())
    assert cli.main(["analyze", *text], spark) == 0
    assert any(line.split()[:2] == ["primary", "n/a"] for line in capsys.readouterr().out.splitlines())
    assert cli.main(["spans", *text, "--train", str(train)], spark) == 0


def test_filter_on_a_score_ends(spark):
    """A filter above the pipeline must not repeat what the score is made of."""
    model = LogisticModel(["question_per_kw"], [1.0], 0.0, {"question_per_kw": (60.0, 1.0)})
    df = spark.createDataFrame([(0, HALF), (1, " ".join([ASKED] * 36))], "doc_id bigint, text string")
    got = engine.score_texts(df, model=model).withColumn("r", F.round("score", 3)).filter("r > 0.5").collect()
    assert [r.doc_id for r in got] == [1]
