"""Running sums by buckets, the resamples built on them, split-safe JSON lines and the command line's forms."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline import cli
from proofline.operators import metrics, spans
from proofline.operators.running import cumulated
from proofline.sources import jsonl
from proofline.streaming import scoring


def test_cumulated_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, v, rng.randint(1, 9)) for k in ("a", "b", None) for v in sorted({round(rng.random() ** 3, 4) for _ in range(400)})] + [("one", 0.5, 7)]
    df = spark.createDataFrame(rows, "k string, v double, n bigint")
    got = cumulated(df, ["k"], "v", ["n"], 8).collect()
    assert len(got) == len(rows) and max(r.bucket for r in got) > 3
    for r in got:
        assert r.n_below == sum(n for k, v, n in rows if k == r.k and v < r.v) and r.n_whole == sum(n for k, _, n in rows if k == r.k)
    assert sum(r.first for r in got) == len({(r.k, r.bucket) for r in got})
    assert cumulated(df.limit(0), ["k"], "v", ["n"]).count() == 0


def test_bootstrap_by_bucket_is_like_the_whole(spark):
    rng = np.random.default_rng(1)
    rows = [("d", int(y), float(np.round(rng.normal(0.6 if y else 0.4, 0.2), 3))) for y in rng.integers(0, 2, 600)] + [("none", 1, 0.5)]
    df = spark.createDataFrame(rows, "detector string, label int, score double")

    def auroc(pos, neg, scores):
        return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))

    own = {r.detector: r for r in metrics.bootstrap_ci(df, 400).collect()}
    whole = {r.detector: r for r in metrics.bootstrap_ci(df, 400, statistic=auroc).collect()}
    assert own["d"].low == pytest.approx(whole["d"].low, abs=0.01) and own["d"].high == pytest.approx(whole["d"].high, abs=0.01)
    assert own["none"].low is None and whole["none"].low is None


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [json.dumps({"text": f"line {i} " + "x" * 200, "label": i % 2, "meta": {"label": "b"}}) if i % 7 else "" for i in range(3000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = {r.line_no: r.text for r in jsonl.load_labeled(spark, str(tmp_path / "big.jsonl")).collect()}
        assert got == {i + 1: json.loads(x)["text"] for i, x in enumerate(lines) if x}
        (tmp_path / "bad.jsonl").write_text("\n".join([*lines[1:2000], '{"text": "t", "label": 1.0}', *lines[2001:]]))
        with pytest.raises(ValueError, match=r"bad\.jsonl:2000: label must be the integer"):
            jsonl.load_labeled(spark, str(tmp_path / "bad.jsonl"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_covered_sentences(spark):
    w = spark.createDataFrame([(1, 0, 2, 0.2), (1, 1, 3, 0.6), (2, 0, 1, 1.0)], "doc_id bigint, a int, b int, s double")
    got = {(r.doc_id, r.idx): (round(r.score, 6), r.n_windows) for r in spans.covered(w).collect()}
    assert got == {(1, 0): (0.2, 1), (1, 1): (0.4, 2), (1, 2): (0.6, 1), (2, 0): (1.0, 1)}


def test_flag_rate(spark):
    rows = spark.createDataFrame([("en", "2024-01-01 05:00:00", True), ("en", "2024-01-01 20:00:00", False), ("de", "2024-01-02 01:00:00", True)], "lang string, t string, flagged boolean").withColumn("collected_at", F.to_timestamp("t"))
    got = {(r.lang, r.n, r.n_flagged) for r in scoring.flag_rate(rows).collect()}
    assert got == {("en", 2, 1), ("de", 1, 1)}


def test_command_line_forms(spark, small, tmp_path, capsys):
    def out(*argv, status=0):
        assert cli.main([*argv], spark) == status
        return capsys.readouterr().out

    text = "Furthermore, the vibrant tapestry underscores a seamless journey. " * 12
    rows = json.loads(out("score", text, "--json"))["results"]
    assert [r["detector"] for r in rows] == ["ensemble", "phrases", "stylometry"]
    assert "burstiness" in out("score", text, "--details")
    assert {r["detector"] for r in json.loads(out("compare", "--original", text, "--rephrased", "A dog.", "--json"))["results"]} == {"ensemble", "phrases", "stylometry"}
    out("compare", "--original", text, status=2)
    assert "verdict" in json.loads(out("analyze", text, "--json"))["results"][0]
    assert "Sentences" in out("analyze", text, "--spans") and "Sentences" not in out("analyze", text, "--no-spans")
    assert json.loads(out("spans", text, "--json", "--threshold", "0.2"))["results"][0]["total_words"] == 96
    out("benchmark", status=2)
    shown = out("benchmark", "--demo", small, "--out", str(tmp_path / "b.json"))
    assert "Evasion" in shown and all(c in shown for c in cli.CAVEATS)
    assert json.loads((tmp_path / "b.json").read_text())["caveats"] == list(cli.CAVEATS)


def test_spread_moves_small_tables_only(spark, small):
    from proofline import scratch

    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert scratch.spread(df).count() == df.count() and "Repartition" in scratch.spread(df)._jdf.queryExecution().optimizedPlan().toString()
    before, scratch.ROW_GROUP = scratch.ROW_GROUP, 10
    try:
        assert scratch.spread(df) is df
    finally:
        scratch.ROW_GROUP = before
