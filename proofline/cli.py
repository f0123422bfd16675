"""Command line: score, compare, benchmark, analyze, calibrate, spans, robustness, fairness, detectors.

Errors of the user end with status 2, an interrupt with 130.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .functions import combine, detectors
from .functions import text as T
from .operators import attacks, conformal, evasion, metrics, spans
from .plans import engine
from .sources import jsonl

NAMES = ("phrases", "stylometry")
FIGURES = ("n_words", "n_sentences", "burstiness", "short_sentence_rate", "mattr", "mean_word_len", "em_dash_per_kw", "phrase_rate", "triads")
#: What figures on the demo tables can't show; they go with every report made from them.
CAVEATS = (
    "The demo tables are invented texts: figures on them describe the tables, not how good a detector is.",
    "Human and AI texts of the tables differ in source and era as well as in who wrote them.",
    "The rewrites of the pairs start from AI texts of the same tables, so the two tables are not independent.",
)


def _texts(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    given = args.text if args.given is None else args.given
    if given is None and args.file is None:
        return jsonl.load_text(spark, text=sys.stdin.read())
    return jsonl.load_text(spark, given, args.file)


def _shown(df: DataFrame, args: argparse.Namespace, title: str, order: list[str] = ()) -> str:
    return report.to_json(df.orderBy(*order) if order else df) if args.json else report.render_table(df, title, order)


def _demo(spark: SparkSession, args: argparse.Namespace, name: str) -> DataFrame:
    if not args.demo:
        raise ValueError("give the files, or --demo with the folder of the demo tables")
    return spark.read.parquet(f"{args.demo.rstrip('/')}/{name}.parquet")


def _long(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per text and detector, the ensemble included; a text is parsed once."""
    s = detectors.scored(df)
    s = s.withColumns({"ensemble_score": combine.weighted_mean({n: F.col(f"{n}_score") for n in NAMES}), "ensemble_reliable": combine.reliable(F.col("n_words"), *[F.col(f"{n}_reliable") for n in NAMES])})
    each = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(f"{n}_score").alias("score"), F.col(f"{n}_reliable").alias("reliable")) for n in (*NAMES, "ensemble")])
    return s.select(*keep, "n_words", F.inline(each))


def score(spark, args) -> str:
    texts = _texts(spark, args)
    rows = _long(texts, ["doc_id"])
    out = _shown(rows.select("detector", "score", "reliable", "n_words", combine.verdict_band(F.col("score"), F.col("reliable")).alias("verdict")), args, "Scores", ["detector"])
    if not args.details:
        return out
    figures = detectors.scored(texts).select(*FIGURES, F.transform(detectors.top_hits(F.col("lexicon")), lambda h: F.concat(h["phrase"], F.lit(" x"), h["n"].cast("string"))).alias("phrases"))
    return out + "\n\n" + (report.to_json(figures) if args.json else report.render([(k, ", ".join(v) if isinstance(v, list) else v) for k, v in figures.first().asDict().items()], ["figure", "value"], "Details"))


def compare(spark, args) -> str:
    texts = []
    for name in ("original", "rephrased"):
        given, file = getattr(args, name), getattr(args, f"{name}_file")
        if (given is None) == (file is None):
            raise ValueError(f"give either --{name} or --{name}-file")
        texts.append(given if file is None else Path(file).read_text("utf-8"))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    p = _long(df, ["k"]).groupBy("detector").agg(F.max(F.when(F.col("k") == 0, F.col("score"))).alias("original"), F.max(F.when(F.col("k") == 1, F.col("score"))).alias("rephrased"))
    return _shown(p.select("*", (F.col("original") - F.col("rephrased")).alias("delta"), evasion.outcome(F.col("original"), F.col("rephrased"), args.threshold).alias("outcome")), args, "Comparison", ["detector"])


def benchmark(spark, args) -> str:
    human = jsonl.load_labeled(spark, args.human) if args.human else _demo(spark, args, "demo_human")
    ai = jsonl.load_labeled(spark, args.ai) if args.ai else _demo(spark, args, "demo_ai")
    demo = not (args.human and args.ai)
    if human.filter("label <> 0").limit(1).count() or ai.filter("label <> 1").limit(1).count():
        raise ValueError("--human must hold label 0 and --ai label 1 only")
    both = human.select("text", "label").unionByName(ai.select("text", "label"))
    scored = _long(both, ["label"]).persist()
    result = metrics.evaluate(scored, args.threshold)
    out = report.render_benchmark(result)
    pairs = None
    if args.pairs or args.demo:
        given = jsonl.load_pairs(spark, args.pairs) if args.pairs else _demo(spark, args, "demo_evasion_pairs").select("original", "rephrased")
        p = given.withColumn("pair_id", F.monotonically_increasing_id())
        x = p.select("pair_id", F.inline(F.array(F.struct(F.lit(0).alias("k"), F.col("original").alias("text")), F.struct(F.lit(1).alias("k"), F.col("rephrased").alias("text")))))
        w = _long(x, ["pair_id", "k"]).groupBy("pair_id", "detector").agg(F.max(F.when(F.col("k") == 0, F.col("score"))).alias("score_original"), F.max(F.when(F.col("k") == 1, F.col("score"))).alias("score_rephrased"))
        pairs = evasion.evasion_report(w, args.threshold)
        out += "\n\n" + report.render_table(pairs, "Evasion", ["detector"])
    if demo:
        out += "\n\n" + "\n".join(f"* {c}" for c in CAVEATS)
    if args.out:
        counts = both.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
        Path(args.out).write_text(report.to_json(result, n_human=counts[0], n_ai=counts[1], threshold=args.threshold, caveats=list(CAVEATS) if demo else [], evasion=None if pairs is None else [r.asDict() for r in pairs.collect()]), "utf-8")
    return out


def _calibrations(spark, path: str | None) -> DataFrame:
    return jsonl.load_calibrations(spark, path) if path else spark.createDataFrame([], jsonl.CALIBRATION)


def _primary(spark, args):
    """The engine's primary, trained on the labelled file if one is given."""
    return engine.fit_primary(jsonl.load_labeled(spark, args.train)) if args.train else None


def analyze(spark, args) -> str:
    df = _texts(spark, args).withColumn("language", F.lit(args.language))
    model = _primary(spark, args)
    done = engine.analyze(df, _calibrations(spark, args.calibration), model=model, want_spans=not args.no_spans).drop("change_point")
    if args.json:
        return report.to_json(done)
    more = ""
    if args.spans and not args.no_spans:
        score_, name = (engine.primary_detector(model), "primary") if model else (detectors.detector(engine.CORROBORATORS[0]), engine.CORROBORATORS[0])
        more = "\n\n" + report.render_table(spans.span_scores(df, score_, name).select(F.posexplode("scores").alias("sentence", "score")), "Sentences", ["sentence"])
    row = done.first()
    return report.render([(k, v if not isinstance(v, list) else ", ".join(v)) for k, v in row.asDict().items()], ["figure", "value"], "Analysis") + more


def calibrate(spark, args) -> str:
    human = jsonl.load_labeled(spark, args.human)
    if human.filter("label <> 0").limit(1).count():
        raise ValueError("--human must contain only human texts (label 0)")
    scored = engine.score_texts(human.select("text"), model=_primary(spark, args)).select(F.lit(args.language).alias("language"), "score", T.n_words(F.col("text")).alias("n_words"))
    made = conformal.calibrate(scored, args.fpr_cap)
    if args.out:
        jsonl.save_calibrations(made, args.out)
    return report.render_table(made.select("language", "alpha", "n_calibration", "global_threshold", conformal.certified(F.col("global_threshold")).alias("certified"), conformal.shortfall(F.col("alpha"), F.col("n_calibration")).alias("shortfall")), "Calibration")


def spans_(spark, args) -> str:
    df = _texts(spark, args)
    model = _primary(spark, args)
    s = spans.span_scores(df, engine.primary_detector(model), "primary") if model else spans.span_scores(df, detectors.detector(args.detector), args.detector)
    ok = spans.reliable(F.col("n_windows"), F.col("total_words"))
    whole = s.select("n_windows", "total_words", ok.alias("reliable"), spans.ai_word_fraction(F.col("scores"), F.col("n_words_of"), args.threshold).alias("ai_word_fraction"))
    if args.json:
        return report.to_json(s.select("n_windows", "total_words", ok.alias("reliable"), spans.ai_word_fraction(F.col("scores"), F.col("n_words_of"), args.threshold).alias("ai_word_fraction"), "scores"))
    each = s.select(F.posexplode("scores").alias("sentence", "score"))
    return report.render_table(whole, "Spans") + "\n\n" + report.render_table(each, order=["sentence"], limit=report.SPAN_ROWS)


def robustness(spark, args) -> str:
    ai = (jsonl.load_labeled(spark, args.ai) if args.ai else _demo(spark, args, "demo_ai")).filter("label = 1").select(F.monotonically_increasing_id().alias("doc_id"), "text").persist()
    if not ai.limit(1).count():
        raise ValueError("robustness needs AI-labeled texts")
    a = attacks.attack_table(ai, seed=args.seed).select("doc_id", "attack", "attacked")
    model = _primary(spark, args)
    raw = engine.score_texts(a, "attacked", model, defended=False).select("doc_id", "attack", F.col("score").alias("undefended"))
    safe = engine.score_texts(a, "attacked", model).select("doc_id", "attack", F.col("score").alias("defended"))
    base = engine.score_texts(ai, model=model).select("doc_id", F.col("score").alias("baseline"))
    return report.render_table(evasion.robustness_report(raw.join(safe, ["doc_id", "attack"]).join(base, "doc_id")), "Robustness", ["attack"])


def fairness(spark, args) -> str:
    human = jsonl.load_labeled(spark, args.human)
    if human.filter("label <> 0").limit(1).count():
        raise ValueError("--human must contain only human texts (label 0)")
    s = engine.score_texts(human, model=_primary(spark, args)).withColumns({"grp_": F.try_variant_get(F.try_parse_json("meta"), f"$.{args.group_by}", "string"), "detector": F.lit("engine")})
    g = metrics.subgroup_fpr(s, args.threshold, "grp_").withColumn("over_cap", F.col("fpr") > args.fpr_cap)
    gap = metrics.max_subgroup_gap(g).first()
    return report.render_table(g.drop("detector"), f"False positives by {args.group_by}", ["grp"]) + f"\nlargest gap {report.cell(gap.gap if gap else 0.0)}"


def detectors_(spark, args) -> str:
    have = detectors.available_detectors()
    return report.render([(n, n in have) for n in detectors.detector_names()], ["detector", "available"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="proofline")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        for flag, more in options:
            c.add_argument(flag, **more)
        c.set_defaults(run=run)

    flag = {"action": "store_true"}
    text = [("given", {"nargs": "?", "metavar": "TEXT"}), ("--text", {}), ("--file", {})]
    fast = ("--fast", flag | {"help": "skip detectors that need a model; the native ones need none"})
    as_json = ("--json", flag)
    demo = ("--demo", {"help": "folder of the demo tables, for what is not given as a file"})
    threshold = ("--threshold", {"type": float, "default": 0.5})
    cap = ("--fpr-cap", {"type": float, "default": conformal.FPR_CAP})
    train = ("--train", {"help": "labelled JSON lines (both labels) that the supervised primary is trained on"})
    need = {"required": True}
    command("score", score, *text, as_json, ("--details", flag), fast)
    command("compare", compare, ("--original", {}), ("--original-file", {}), ("--rephrased", {}), ("--rephrased-file", {}), threshold, as_json, fast)
    command("benchmark", benchmark, ("--human", {}), ("--ai", {}), ("--pairs", {}), ("--out", {}), threshold, demo, fast)
    command("analyze", analyze, *text, ("--calibration", {}), ("--language", {"default": "en"}), train, ("--spans", flag), ("--no-spans", flag), as_json, fast)
    command("calibrate", calibrate, ("--human", need), cap, ("--language", {"default": "en"}), ("--out", {}), train, fast)
    command("spans", spans_, *text, ("--detector", {"default": "phrases"}), threshold, train, as_json, fast)
    command("robustness", robustness, ("--ai", {}), ("--seed", {"type": int, "default": 0}), train, demo, fast)
    command("fairness", fairness, ("--human", need), ("--group-by", {"default": "domain"}), threshold, cap, train, fast)
    command("detectors", detectors_, fast)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("proofline").getOrCreate()
        print(args.run(spark, args))
        return 0
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
