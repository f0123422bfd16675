"""Metrics, conformal thresholds, spans, verdicts, models, sources and the command line."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline import cli, report
from proofline.operators import conformal, evasion, metrics, spans, supervised, verdict
from proofline.sources import jsonl


def scored(spark, labels, scores, **more):
    rows = [("d", y, s, *(v[i] for v in more.values())) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "detector string, label int, score double" + "".join(f", {k} string" for k in more))


def test_auroc(spark):
    assert metrics.auroc(scored(spark, [1, 1, 0, 0], [0.6, 0.9, 0.6, 0.1])).first().auroc == pytest.approx(0.875)
    assert metrics.auroc(scored(spark, [1, 0, 1], [0.5] * 3)).first().auroc == pytest.approx(0.5)
    assert metrics.auroc(scored(spark, [1, 1], [0.5, 0.6])).first().auroc is None
    rng = random.Random(4)
    y, s = [rng.randint(0, 1) for _ in range(80)], [round(rng.random(), 1) for _ in range(80)]
    pairs = [(a > b) + (a == b) / 2 for a, ya in zip(s, y) if ya for b, yb in zip(s, y) if not yb]
    assert metrics.auroc(scored(spark, y, s)).first().auroc == pytest.approx(sum(pairs) / len(pairs))


def test_rates_at_a_budget(spark):
    df = scored(spark, [1] * 4 + [0] * 4, [0.9, 0.8, 0.7, 0.3, 0.6, 0.4, 0.2, 0.1])
    r = metrics.tpr_at_fpr(df, 0.0).first()
    assert (r.tpr, r.threshold) == (0.75, 0.7)
    none = metrics.tpr_at_fpr(scored(spark, [1, 0], [0.1, 0.9]), 0.0).first()
    assert none.tpr == 0.0 and math.isinf(none.threshold)
    assert metrics.threshold_at_fpr(df, 0.25).first().cut == 0.4 and metrics.threshold_at_fpr(df, 1.0).first().cut == -math.inf


def test_calibration_error_and_brier(spark):
    assert metrics.ece(scored(spark, [1, 0, 1, 0], [0.99] * 4)).first().ece == pytest.approx(0.49)
    assert metrics.ece(scored(spark, [1] + [0] * 9, [-0.9] + [0.95] * 9)).first().ece == pytest.approx(1.045)
    assert metrics.brier(scored(spark, [1, 0], [0.5, 0.5])).first().brier == pytest.approx(0.25)


def test_subgroups(spark):
    df = scored(spark, [0] * 200, [0.1] * 100 + [0.9] * 20 + [0.1] * 80, g=["native"] * 100 + ["other"] * 100)
    g = {r.grp: r for r in metrics.subgroup_fpr(df, 0.5, "g").collect()}
    assert g["native"].fpr == 0 and g["other"].fpr == 0.2 and g["other"].low == pytest.approx(0.1334, abs=1e-4) and g["other"].high == pytest.approx(0.2888, abs=1e-4)
    assert metrics.max_subgroup_gap(metrics.subgroup_fpr(df, 0.5, "g")).first().gap == pytest.approx(0.2)


def test_empty_scores(spark):
    df = scored(spark, [], [])
    assert metrics.auroc(df).count() == metrics.evaluate(df).count() == metrics.bootstrap_ci(df).count() == 0


def test_bootstrap_holds_the_statistic(spark):
    rng = random.Random(0)
    y = [i % 2 for i in range(200)]
    df = scored(spark, y, [rng.gauss(v, 1.0) for v in y])
    a, r = metrics.auroc(df).first().auroc, metrics.bootstrap_ci(df, 300).first()
    assert r.low < a < r.high and r.high - r.low < 0.25
    low, high = metrics.bootstrap_exact([1, 1, 0, 0], [0.9, 0.4, 0.3, 0.5], lambda y, s: float(np.mean(s)), 200)
    assert low < high


def test_conformal(spark):
    assert [conformal.min_calibration_size(a) for a in (0.005, 0.01, 0.05, 0.1)] == [199, 99, 19, 9]
    with pytest.raises(ValueError):
        conformal.min_calibration_size(1.0)
    rng = random.Random(1)
    rows = [("en", rng.random(), rng.randint(10, 700)) for _ in range(400)] + [("fr", 0.5, 100)] * 18 + [(None, 0.1, 5), ("en", None, 5)]
    human = spark.createDataFrame(rows, "language string, score double, n_words int")
    got = {r.language: r for r in conformal.calibrate(human, 0.05).collect()}
    en = sorted(s for lang, s, _ in rows if lang == "en" and s is not None)
    assert got["en"].global_threshold == en[math.ceil(401 * 0.95) - 1] and math.isinf(got["fr"].global_threshold) and None in got
    assert sum(got["en"].bin_counts.values()) == 400 and all(math.isinf(got["fr"].bin_thresholds[b]) for b in got["fr"].bin_thresholds)
    assert conformal.empirical_fpr(human, conformal.calibrate(human, 0.05)).filter("language = 'en'").first().fpr < 0.08


def test_conformal_guarantee_on_fresh_draws(spark):
    rng = np.random.default_rng(7)
    human = spark.createDataFrame([("x", float(s), 100) for s in rng.normal(size=999)], "language string, score double, n_words int")
    at = conformal.calibrate(human, 0.05).first().global_threshold
    assert (rng.normal(size=20_000) >= at).mean() < 0.075


def test_evasion(spark):
    p = spark.createDataFrame([("d", 0.9, 0.2), ("d", 0.8, 0.7), ("d", 0.3, 0.1), ("q", 0.1, 0.1), ("q", None, 0.9)], "detector string, score_original double, score_rephrased double")
    r = {x.detector: x for x in evasion.evasion_report(p).collect()}
    assert (r["d"].flagged, r["d"].evaded, r["d"].evasion_rate) == (2, 1, 0.5) and r["q"].evasion_rate is None and r["q"].n_pairs == 1
    o = p.select(evasion.outcome(F.col("score_original"), F.col("score_rephrased")).alias("o")).collect()
    assert [x.o for x in o][:3] == ["evaded", "still flagged", "never flagged"]


def test_windows():
    assert spans.windows_of([]) == [] and spans.windows_of([10, 10]) == [(0, 2)]
    w = spans.windows_of([30] * 20)
    assert w[0] == (0, 4) and w[1] == (2, 6) and w[-1][1] == 20
    assert spans.windows_of([200, 200]) == [(0, 1), (1, 2)]


def test_change_point(spark):
    lists = [[0.1] * 10 + [0.9] * 10, [0.5] * 20, [0.1, 0.9], []]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<double>")
    got = [r.c for r in df.select("i", spans.change_point(F.col("v")).alias("c")).orderBy("i").collect()]
    assert got[0].cut == 10 and got[0].is_significant and got[0].delta == pytest.approx(0.8)
    assert got[1].cut == 2 and not got[1].is_significant and got[2] is None and got[3] is None


def test_span_scores_by_hand(spark):
    from proofline.functions import detectors

    text = " ".join(f"The {w} went to the old house by the sea and sat down there for a long while." for w in ["cat", "dog", "man", "boy"] * 8)
    df = spark.createDataFrame([(1, text), (2, "Short one."), (3, "")], "doc_id int, text string")
    rows = {r.doc_id: r for r in spans.span_scores(df, detectors.stylometry, "stylometry").collect()}
    assert len(rows[1].scores) == 32 and min(rows[1].n_covering) >= 1 and rows[1].n_windows >= 3 and rows[2].n_windows == 1 and rows[3].scores == []
    assert all(0 <= s <= 1 for s in rows[1].scores)


def test_verdicts(spark):
    inf = math.inf
    rows = [(0.9, 200, False, True, 0.5, 0.5, None, None), (0.4, 200, False, True, 0.5, 0.5, None, None), (0.4, 200, False, True, 0.5, 0.5, 0.5, None), (0.9, 50, True, False, None, inf, None, None),
            (0.9, 200, False, True, inf, inf, None, None), (0.2, 20, True, False, None, inf, None, "verified_ai")]
    df = spark.createDataFrame(rows, "score double, n int, sus boolean, cal boolean, whole double, at double, fraction double, prov string")
    out = verdict.decide(F.col("score"), F.col("n"), F.col("sus"), F.col("cal"), F.col("whole"), F.col("at"), F.col("fraction"), F.col("prov"))
    got = df.select(*[v.alias(k) for k, v in out.items()]).collect()
    assert [r.label_out for r in got] == ["ai", "human", "mixed", "abstain", "abstain", "ai"]
    assert got[3].abstain_reasons == ["text_too_short", "unicode_tampering_detected", "no_calibration_for_language"] and got[4].abstain_reasons == ["calibration_too_small_for_fpr_cap"]
    assert got[5].verdict_score == 0.99 and got[5].abstain_reasons == []


def test_supervised(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(120, 3)), rng.integers(0, 2, 120)
    x[:, 0] += y
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i]), 1.0) for i in range(120)], "doc_id int, label int, a double, b double, c double, flat double")
    m = supervised.fit(df, ["a", "b", "c", "flat"])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, b = np.zeros(3), 0.0
    for _ in range(3000):
        err = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - 0.25 * (0.05 * w + z.T @ err / 120), b - 0.25 * err.mean()
    assert np.allclose(m.weights[:3], w, atol=1e-5) and abs(m.bias - b) < 1e-5 and m.weights[3] == 0.0
    assert supervised.LogisticModel.from_json(m.to_json()) == m and m.top_features(1)[0][0] == "a"
    cv = supervised.cross_val_scores(df, ["a", "b", "c"], n_folds=3)
    assert cv.count() == 120 and metrics.auroc(cv.withColumn("detector", F.lit("s"))).first().auroc > 0.6
    with pytest.raises(ValueError):
        supervised.fit(df.filter("label = 1"), ["a"])
    f = supervised.folds({0: [1, 2, 3, 4], 1: [5, 6, 7]}, 2)
    assert sorted(f) == [1, 2, 3, 4, 5, 6, 7] and sum(f[i] for i in (1, 2, 3, 4)) == 2
    e = supervised.fit_ensemble(df.withColumns({"p_score": F.col("a"), "q_score": F.col("b")}), ["p", "q"])
    assert e.weights[0] > 0 and e.keys == ["p_score", "q_score"]


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"text": "Ä b", "label": 0}\n\n{"text": 5, "label": 1, "source": "s", "meta": {"k": 1}}\n', "utf-8")
    rows = jsonl.load_labeled(spark, str(good)).orderBy("line_no").collect()
    assert [(r.line_no, r.text, r.label, r.source) for r in rows] == [(1, "Ä b", 0, "unknown"), (3, "5", 1, "s")] and json.loads(rows[1].meta) == {"k": 1}
    for bad, why in (("{", "invalid JSON"), ('{"text": "a"}', "record needs"), ('{"text": "a", "label": true}', "integer 0 or 1"), ('{"text": "a", "label": 0.7}', "integer 0 or 1"), ('{"text": "a", "label": 1.0}', "integer 0 or 1"), ('{"text": "a", "label": "1"}', "integer 0 or 1"), ('{"text": "a", "label": 2}', "0 or 1")):
        file = tmp_path / "bad.jsonl"
        file.write_text('{"text": "fine", "label": 0}\n' + bad + "\n")
        with pytest.raises(ValueError, match=why) as error:
            jsonl.load_labeled(spark, str(file))
        assert "bad.jsonl:2:" in str(error.value)
    pairs = tmp_path / "pairs.jsonl"
    pairs.write_text('{"original": "a", "rephrased": "b"}\n')
    assert jsonl.load_pairs(spark, str(pairs)).count() == 1
    with pytest.raises(ValueError):
        jsonl.load_text(spark)


def test_calibrations_keep_other_languages(spark, tmp_path):
    path = str(tmp_path / "cal.json")
    human = lambda lang, n: spark.createDataFrame([(lang, i / n, 120) for i in range(n)], "language string, score double, n_words int")
    jsonl.save_calibrations(conformal.calibrate(human("en", 60), 0.05), path)
    jsonl.save_calibrations(conformal.calibrate(human("fr", 5), 0.05), path)
    assert "Infinity" not in open(path).read()
    back = {r.language: r for r in jsonl.load_calibrations(spark, path).collect()}
    assert math.isfinite(back["en"].global_threshold) and math.isinf(back["fr"].global_threshold)


def test_command_line(spark, tmp_path, capsys):
    human, ai = tmp_path / "h.jsonl", tmp_path / "a.jsonl"
    human.write_text("".join(json.dumps({"text": f"We saw the dog {i}. It ran off. Nobody knew why it left so soon.", "label": 0, "meta": {"g": "x" if i % 2 else "y"}}) + "\n" for i in range(6)))
    ai.write_text("".join(json.dumps({"text": f"Furthermore, the vibrant tapestry {i} underscores a seamless journey.", "label": 1}) + "\n" for i in range(6)))
    out = tmp_path / "out.json"
    assert cli.main(["benchmark", "--human", str(human), "--ai", str(ai), "--out", str(out)], spark) == 0
    assert json.loads(out.read_text())["n_human"] == 6 and "AUROC" in capsys.readouterr().out
    assert cli.main(["calibrate", "--human", str(human), "--fpr-cap", "0.2"], spark) == 0
    assert cli.main(["fairness", "--human", str(human), "--group-by", "g"], spark) == 0 and "largest gap" in capsys.readouterr().out
    assert cli.main(["score", "--text", "A plain text."], spark) == 0 and cli.main(["detectors"], spark) == 0
    assert cli.main(["calibrate", "--human", str(ai)], spark) == 2 and cli.main(["score", "--file", str(tmp_path / "none.txt"), "--text", "x"], spark) == 2


def test_render():
    assert report.render([("a", 1.0, None), ("bb", math.inf, 2)], ["n", "v", "k"]).splitlines()[2:] == ["a   1.000  n/a", "bb  never    2"]
