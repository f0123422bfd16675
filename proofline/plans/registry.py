"""The registered queries: one per operator, each over its whole tables.

Figures are rounded to six places and whole numbers are bigint, so that any engine's result compares.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import combine, detectors, features, normalize
from ..functions import text as T
from ..operators import attacks, conformal, evasion, metrics, spans, supervised, verdict
from ..scratch import folder as scratch_folder
from ..scratch import dealt, spread, written
from ..sources import jsonl
from . import engine

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
SEP = " | "


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = lambda spark, folder: _out(f(spark, folder))
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _out(df: DataFrame) -> DataFrame:
    def plain(c: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return (F.round(F.col(c), 6) + F.lit(0.0)).alias(c)
        return F.col(c).cast("bigint").alias(c) if kind in ("int", "smallint") else F.col(c)

    return df.select(*[plain(c, k) for c, k in df.dtypes])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """What the queries read of the documents; a small table is spread over the cores before texts are parsed."""
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "label"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """The scored table without repeated deliveries and unusable rows."""
    return metrics.usable(metrics.deliveries(table(spark, folder, "scored").drop("loaded_at")))


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return T.parsed(docs(spark, folder).filter("text is not null").select("doc_id", "lang", "text"))


# --- sources and sinks ---------------------------------------------------------------------------------------


@query
def src_demo(spark, folder):
    return union_corpus(spark, folder)


def _as_jsonl(spark, folder, df) -> str:
    path = f"{scratch_folder(spark)}/jsonl-{abs(hash((folder, df.columns[0])))}"
    jsonl.save_jsonl(df, path)
    return path


@query
def src_labeled_jsonl(spark, folder):
    """The human corpus written as JSON lines and read strictly."""
    human = table(spark, folder, "demo_human").select("text", "label", F.coalesce("source", F.lit("unknown")).alias("source"), "meta")
    return jsonl.load_labeled(spark, _as_jsonl(spark, folder, human)).groupBy("label", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query
def src_pairs_jsonl(spark, folder):
    pairs = table(spark, folder, "demo_evasion_pairs").select("original", "rephrased", "meta")
    return jsonl.load_pairs(spark, _as_jsonl(spark, folder, pairs)).agg(F.count("*").alias("n"), F.sum(F.length("original")).alias("n_original"), F.sum(F.length("rephrased")).alias("n_rephrased"))


@query
def src_text(spark, folder):
    return jsonl.load_text(spark, text="One text. Given as it is.").select(T.n_words(F.col("text")).alias("n_words"), F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query
def src_calibration(spark, folder):
    """The calibration table through its JSON form and back."""
    text = json.dumps(jsonl.calibrations_to_json(table(spark, folder, "calibration")))
    import os
    import tempfile

    path = tempfile.mkstemp(suffix=".json")[1]  # a file of the driver, read by the driver
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        back = jsonl.load_calibrations(spark, path)
    finally:
        os.unlink(path)
    whole = F.col("global_threshold")
    return back.select("language", "alpha", "n_calibration", F.when(whole < float("inf"), whole).alias("global_threshold"), F.size("bin_edges").alias("n_edges"), F.size("bin_thresholds").alias("n_bins"))


@query
def union_corpus(spark, folder):
    cols = ["doc_id", "text", "label", "source"]
    return table(spark, folder, "demo_human").select(cols).unionByName(table(spark, folder, "demo_ai").select(cols))


# --- normalisation -------------------------------------------------------------------------------------------


@query
def norm_text(spark, folder):
    return docs(spark, folder).select("doc_id", normalize.mapped(F.col("text")).alias("mapped"))


@query
def norm_nfkc(spark, folder):
    return docs(spark, folder).select("doc_id", normalize.normalized(F.col("text")).alias("clean"))


@query
def norm_counts(spark, folder):
    c = normalize.counts(F.col("text"))
    return docs(spark, folder).select("doc_id", *[c[k].alias(k) for k in ("homoglyphs_replaced", "invisibles_removed", "odd_spaces_replaced", "n_chars")])


@query
def norm_tamper_rate(spark, folder):
    c = normalize.counts(F.col("text"))
    return docs(spark, folder).select("doc_id", c["tamper_rate"].alias("tamper_rate"))


@query
def norm_suspicious(spark, folder):
    return docs(spark, folder).groupBy("lang").agg(F.count_if(normalize.counts(F.col("text"))["is_suspicious"]).alias("n_suspicious"), F.count("*").alias("n"))


@query
def norm_scripts(spark, folder):
    return docs(spark, folder).filter("text is not null").select("doc_id", F.array_join(normalize.scripts(F.col("text")), ",").alias("scripts"))


@query
def set_scripts(spark, folder):
    return docs(spark, folder).filter("text is not null").select(F.explode(normalize.scripts(F.col("text"))).alias("script")).groupBy("script").agg(F.count("*").alias("n"))


# --- tokens, sentences, statistics -----------------------------------------------------------------------------


@query
def words(spark, folder):
    return docs(spark, folder).select("doc_id", F.array_join(T.words(F.col("text")), " ").alias("tokens"), T.n_words(F.col("text")).alias("n_words"))


@query
def blocks(spark, folder):
    return docs(spark, folder).select("doc_id", F.array_join(T.blocks(F.col("text")), SEP).alias("blocks"))


@query
def sentences(spark, folder):
    return docs(spark, folder).select("doc_id", F.array_join(T.sentences(F.col("text")), SEP).alias("sentences"))


@query
def sentence_lengths(spark, folder):
    return parsed(spark, folder).select("doc_id", F.array_join(F.transform("lengths", lambda n: n.cast("int").cast("string")), " ").alias("lengths"))


@query
def mean_stdev_cv(spark, folder):
    m = T.mean(F.col("lengths"))
    return parsed(spark, folder).select("doc_id", m.alias("mean"), T.stdev(F.col("lengths")).alias("sd"), T.variation(m, T.stdev(F.col("lengths"))).alias("cv"))


@query
def mattr(spark, folder):
    return docs(spark, folder).filter("text is not null").select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", T.mattr(F.col("w")).alias("mattr"))


@query
def mattr_window(spark, folder):
    """The moving window at other widths."""
    w = docs(spark, folder).filter("text is not null").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", T.mattr(F.col("w"), 7).alias("mattr_7"), T.mattr(F.col("w"), 21).alias("mattr_21"))


@query
def logistic(spark, folder):
    return scored(spark, folder).select("doc_id", "detector", "run_no", T.logistic((F.col("score") - 0.5) * 8).alias("p"))


@query
def softplus(spark, folder):
    return scored(spark, folder).select("doc_id", "detector", "run_no", T.softplus((F.col("score") - 0.5) * 100).alias("s"))


@query
def feature_vector(spark, folder):
    return features.feature_table(docs(spark, folder).filter("text is not null"))


# --- detectors ---------------------------------------------------------------------------------------------------


@query
def det_stylometry(spark, folder):
    return detectors.stylometry(parsed(spark, folder)).select("doc_id", "stylometry_score", "stylometry_reliable", "n_sentences", "burstiness", "mattr")


@query
def lex_hits(spark, folder):
    hits = docs(spark, folder).filter("text is not null").select("doc_id", detectors.lexicon_hits(F.col("text")).alias("h"))
    return hits.select("doc_id", F.aggregate("h", F.lit(0), lambda a, h: a + h["n"]).alias("n_hits"), F.aggregate("h", F.lit(0.0), lambda a, h: a + h["n"] * h["weight"]).alias("weight"))


@query
def structural_hits(spark, folder):
    return docs(spark, folder).select("doc_id", *[c.alias(n) for n, c in detectors.structural_hits(F.col("text")).items()])


@query
def triads(spark, folder):
    return docs(spark, folder).select("doc_id", detectors.triads(F.col("text")).alias("triads"))


@query
def det_phrases(spark, folder):
    return detectors.phrases(parsed(spark, folder)).select("doc_id", "phrases_score", "phrases_reliable", "phrase_rate")


@query
def det_phrases_details(spark, folder):
    p = detectors.phrases(parsed(spark, folder))
    return p.select("doc_id", F.posexplode(detectors.top_hits(F.col("lexicon"))).alias("at", "h")).select("doc_id", (F.col("at") + 1).alias("place"), "h.phrase", "h.n")


@query
def topk_lexicon(spark, folder):
    """The 12 phrases that weigh most over all documents (a report)."""
    hits = docs(spark, folder).filter("text is not null").select(F.explode(detectors.lexicon_hits(F.col("text"))).alias("h"))
    return hits.groupBy("h.phrase").agg(F.sum("h.n").alias("n"), F.sum(F.col("h.n") * F.col("h.weight")).alias("weight")).orderBy(F.desc("weight"), "phrase").limit(12)


@query
def det_registry(spark, folder):
    have = set(detectors.available_detectors())
    return spark.createDataFrame([(n, n in have) for n in detectors.detector_names()], "name string, available boolean")


def _mean_char(texts: list[str]) -> list[float | None]:
    return [sum(c in "aeiou" for c in t.lower()) / len(t) if t else None for t in texts]


@query
def det_transformer(spark, folder):
    """A detector that is plugged in as a batch function: the share of vowels stands for a model's score."""
    return detectors.model_detector("vowel", _mean_char)(docs(spark, folder).select("doc_id", "text"), "text").select("doc_id", "vowel_score", "vowel_reliable")


# --- combination -----------------------------------------------------------------------------------------------


def _both(spark, folder) -> DataFrame:
    return detectors.scored(docs(spark, folder).filter("text is not null").select("doc_id", "lang", "source", "label", "text"))


def _wide(spark, folder) -> DataFrame:
    """One row per document and run of the scored table with a column per detector (null where it has no score)."""
    return scored(spark, folder).groupBy("doc_id", "run_no").pivot("detector", DETECTORS).agg(F.max("score"))


DETECTORS = ["ensemble", "phrases", "stylometry", "supervised"]


@query
def ens_weighted(spark, folder):
    parts = {n: F.col(n) for n in DETECTORS}
    w = _wide(spark, folder)
    return w.select("doc_id", "run_no", combine.weighted_mean(parts).alias("preset"), combine.weighted_mean(parts, {}).alias("plain"), combine.weighted_mean(parts, {n: 0.0 for n in parts}).alias("zero"))


@query
def ens_reliable(spark, folder):
    b = _both(spark, folder)
    return b.select("doc_id", combine.reliable(F.col("n_words"), F.col("stylometry_reliable"), F.col("phrases_reliable")).alias("is_reliable"))


@query
def verdict_band(spark, folder):
    return _wide(spark, folder).select("doc_id", "run_no", combine.verdict_band(F.coalesce(F.col("stylometry"), F.lit(0.5)), F.col("stylometry").isNotNull()).alias("band"))


@query
def verdict_bands(spark, folder):
    """The flagship: how many documents of each language fall into each band of the ensemble's score."""
    b = _both(spark, folder)
    score = combine.weighted_mean({n: F.col(f"{n}_score") for n in ("stylometry", "phrases")})
    band = combine.verdict_band(score, combine.reliable(F.col("n_words"), F.col("stylometry_reliable"), F.col("phrases_reliable")))
    return b.groupBy("lang", band.alias("band")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


@query
def blend(spark, folder):
    """The supervised score as the primary; it is null, so unusable, where it has none."""
    return _wide(spark, folder).select("doc_id", "run_no", combine.blend(F.col("supervised"), {n: F.col(n) for n in ("phrases", "stylometry")}).alias("blended"), F.col("supervised").isNotNull().alias("primary_usable"))


@query
def ood_flag(spark, folder):
    gap = combine.ood_gap(F.col("supervised"), [F.coalesce(F.col(n), F.lit(0.5)) for n in ("phrases", "stylometry")])
    return _wide(spark, folder).select("doc_id", "run_no", gap.alias("gap"), combine.is_ood(gap).alias("is_ood"))


def _status() -> Column:
    """The provenance status by source: sources of the documents that are known to sign what they hold."""
    return F.when(F.col("source") == "model_outputs_a", combine.VERIFIED_AI).when(F.col("source") == "model_outputs_b", combine.INVALID).when(F.col("source") == "lab_notes", combine.HUMAN_CLAIM).when(F.col("source") == "open_forum", combine.ABSENT)


def _signals(spark, folder) -> DataFrame:
    """Provenance signals as a side table."""
    return docs(spark, folder).select("doc_id", _status().alias("status")).filter("status is not null")


@query
def provenance_combine(spark, folder):
    """Every usable score of every detector and run with its document's provenance."""
    j = scored(spark, folder).join(_signals(spark, folder), "doc_id", "left")
    return j.select("doc_id", "detector", "run_no", "status", combine.with_provenance(F.col("score"), F.col("status")).alias("combined"))


@query
def provenance_flags(spark, folder):
    return docs(spark, folder).select("doc_id").join(_signals(spark, folder), "doc_id", "left").select("doc_id", combine.is_ai_evidence(F.col("status")).alias("is_ai_evidence"), combine.is_informative(F.col("status")).alias("is_informative"))


# --- metrics -----------------------------------------------------------------------------------------------------


@query
def filter_label(spark, folder):
    return scored(spark, folder).filter("label = 0").groupBy("detector", "domain").agg(F.count("*").alias("n"))


@query
def validate(spark, folder):
    return metrics.validate(metrics.deliveries(table(spark, folder, "scored").drop("loaded_at")))


@query
def confusion(spark, folder):
    return metrics.confusion(scored(spark, folder))


@query
def classification(spark, folder):
    return metrics.classification(scored(spark, folder))


@query
def brier(spark, folder):
    return metrics.brier(scored(spark, folder))


@query
def ece(spark, folder):
    return metrics.ece(scored(spark, folder))


@query
def avg_ranks(spark, folder):
    return metrics.average_ranks(scored(spark, folder))


@query
def auroc(spark, folder):
    return metrics.auroc(scored(spark, folder))


@query
def roc_points(spark, folder):
    r = metrics.roc_points(scored(spark, folder))
    return r.withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


@query
def tpr_at_fpr(spark, folder):
    r = metrics.tpr_at_fpr(scored(spark, folder), 0.05)
    return r.withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


@query
def threshold_at_fpr(spark, folder):
    return metrics.threshold_at_fpr(scored(spark, folder), 0.05)


@query
def domain_adjusted_tpr(spark, folder):
    return metrics.domain_adjusted_tpr(scored(spark, folder))


@query
def subgroup_fpr(spark, folder):
    return metrics.subgroup_fpr(scored(spark, folder), 0.5, "domain")


@query
def wilson(spark, folder):
    return metrics.subgroup_fpr(scored(spark, folder), 0.5, "source").select("detector", "grp", "low", "high")


@query
def order_groups(spark, folder):
    return metrics.subgroup_fpr(scored(spark, folder), 0.5, "domain").select("detector", "grp", "n").orderBy("detector", "grp")


@query
def max_subgroup_gap(spark, folder):
    return metrics.max_subgroup_gap(metrics.subgroup_fpr(scored(spark, folder), 0.5, "domain"))


@query
def fpr_resolution(spark, folder):
    return metrics.fpr_resolution(scored(spark, folder))


@query
def evaluate_scores(spark, folder):
    r = metrics.evaluate(scored(spark, folder))
    return r.select("detector", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "fpr", "brier", "ece", "auroc", "tpr_5", "tpr_1", "resolution")


@query
def bootstrap_ci(spark, folder):
    return metrics.bootstrap_ci(scored(spark, folder))


@query
def fairness(spark, folder):
    """False positive rates of human texts by a member of meta, against a cap."""
    human = table(spark, folder, "demo_human").select("doc_id", F.col("meta.era").alias("era"))
    s = scored(spark, folder).filter("label = 0").join(human, "doc_id").withColumn("era", F.lower(F.trim("era")))
    return metrics.subgroup_fpr(s, 0.5, "era").withColumn("over_cap", F.col("fpr") > 0.05)


@query
def distinct_sources(spark, folder):
    return scored(spark, folder).groupBy("detector").agg(F.count_distinct("label").alias("n_classes"), F.count_distinct("source").alias("n_sources"))


@query
def join_corr_scores(spark, folder):
    """Wide scores back to one row per document, run and detector."""
    w = _wide(spark, folder)
    return w.unpivot(["doc_id", "run_no"], DETECTORS, "detector", "score").filter("score is not null")


@query
def join_positional(spark, folder):
    """Two detectors' scores of the same document and run, aligned by key."""
    s = scored(spark, folder)
    a = s.filter("detector = 'stylometry'").select("doc_id", "run_no", F.col("score").alias("a"))
    b = s.filter("detector = 'phrases'").select("doc_id", "run_no", F.col("score").alias("b"))
    return a.join(b, ["doc_id", "run_no"]).groupBy("run_no").agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("mean_gap"))


# --- conformal -----------------------------------------------------------------------------------------------------


def _human(spark, folder) -> DataFrame:
    return table(spark, folder, "human_calib")


@query
def conformal_threshold(spark, folder):
    t = conformal.order_thresholds(_human(spark, folder).filter("score is not null"), ["language"], 0.05)
    return t.withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


@query
def min_calibration_size(spark, folder):
    return table(spark, folder, "calibration").select("language", conformal.min_size(F.col("alpha")).alias("least"))


@query
def calibrate(spark, folder):
    c = conformal.calibrate(_human(spark, folder), 0.05)
    bins = c.select("language", F.explode("bin_thresholds").alias("bin", "threshold"), "bin_counts", "n_calibration").select("language", "n_calibration", "bin", "threshold", F.element_at("bin_counts", F.col("bin")).alias("n"))
    return bins.withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


def _calibrated(spark, folder) -> DataFrame:
    return conformal.with_calibration(_human(spark, folder), table(spark, folder, "calibration"))


@query
def join_calibration(spark, folder):
    return _calibrated(spark, folder).groupBy("language", "calibrated", "alpha").agg(F.count("*").alias("n"))


@query
def join_bin_lookup(spark, folder):
    return _calibrated(spark, folder).filter("calibrated").select("calib_id", conformal.bin_index(F.col("n_words"), F.col("bin_edges")).alias("bin"))


@query
def threshold_for(spark, folder):
    f = conformal.flagged(_calibrated(spark, folder))
    return f.select("calib_id", F.when(F.col("threshold") < float("inf"), F.col("threshold")).alias("threshold"))


@query
def flagged(spark, folder):
    return conformal.flagged(_calibrated(spark, folder)).select("calib_id", "flagged")


@query
def certified(spark, folder):
    return table(spark, folder, "calibration").select("language", conformal.certified(F.col("global_threshold")).alias("certified"), conformal.shortfall(F.col("alpha"), F.col("n_calibration")).alias("shortfall"))


@query
def empirical_fpr(spark, folder):
    return conformal.empirical_fpr(_human(spark, folder), table(spark, folder, "calibration"))


@query
def upsert_calibration(spark, folder):
    new = conformal.calibrate(_human(spark, folder).filter("language = 'en'"), 0.05)
    old = table(spark, folder, "calibration").select(new.columns)
    u = conformal.upsert(old, new.withColumns({"bin_counts": F.col("bin_counts").cast("map<int,bigint>")}))
    return u.select("language", "alpha", "n_calibration")


# --- pairs, attacks --------------------------------------------------------------------------------------------------


def _pair_scores(spark, folder) -> DataFrame:
    """Both texts of each pair, scored by every native detector and the ensemble in one pass over one column of texts:
    a row per pair and detector."""
    pairs = spread(table(spark, folder, "demo_evasion_pairs").select("pair_id", "original", "rephrased"))
    both = pairs.select("pair_id", F.inline(F.array(F.struct(F.lit(0).alias("k"), F.col("original").alias("text")), F.struct(F.lit(1).alias("k"), F.col("rephrased").alias("text")))))
    s = detectors.scored(both.filter("text is not null"))
    s = s.withColumn("ensemble_score", combine.weighted_mean({n: F.col(f"{n}_score") for n in ("stylometry", "phrases")}))
    each = s.select("pair_id", "k", F.inline(F.array(*[F.struct(F.lit(n).alias("detector"), F.col(f"{n}_score").alias("score")) for n in ("stylometry", "phrases", "ensemble")])))
    return each.groupBy("pair_id", "detector").agg(F.max(F.when(F.col("k") == 0, F.col("score"))).alias("score_original"), F.max(F.when(F.col("k") == 1, F.col("score"))).alias("score_rephrased"))


@query
def join_pairs(spark, folder):
    return _pair_scores(spark, folder)


@query
def evasion_report(spark, folder):
    return evasion.evasion_report(_pair_scores(spark, folder))


@query
def compare_pair(spark, folder):
    p = _pair_scores(spark, folder)
    return p.select("pair_id", "detector", (F.col("score_original") - F.col("score_rephrased")).alias("delta"), evasion.outcome(F.col("score_original"), F.col("score_rephrased")).alias("outcome"))


def _attacked(spark, folder) -> DataFrame:
    return attacks.attack_table(table(spark, folder, "demo_ai").select("doc_id", "text"))


@query
def attack_all(spark, folder):
    """Every text under each attack: how many characters differ in number, and whether normalising undoes it."""
    a = _attacked(spark, folder)
    same = normalize.normalized(F.col("attacked")) == normalize.normalized(F.col("text"))
    return a.groupBy("attack").agg(F.count("*").alias("n"), F.sum(F.length("attacked") - F.length("text")).alias("longer"), F.count_if(same).alias("undone"))


@query
def robustness(spark, folder):
    """Every AI text under each attack, scored by the engine with its primary, with and without normalisation."""
    model = engine.fit_primary_plain(dealt(table(spark, folder, "documents").select("text", "label")))
    return engine.robustness(dealt(table(spark, folder, "demo_ai").select("text")), model=model)


# --- spans -------------------------------------------------------------------------------------------------------------


def _stand_in(df: DataFrame) -> DataFrame:
    """Sentence scores that any engine can make: a sentence's words over 37, at most 1."""
    lengths = F.transform("sents", T.n_words)
    return df.withColumn("n_words_of", lengths).withColumn("scores", F.transform("n_words_of", lambda n: F.least(F.lit(1.0), n / F.lit(37.0))))


@query
def change_point(spark, folder):
    d = _stand_in(parsed(spark, folder)).select("doc_id", spans.change_point(F.col("scores")).alias("c"))
    return d.select("doc_id", "c.cut", "c.delta", "c.is_significant")


@query
def ai_word_fraction(spark, folder):
    return _stand_in(parsed(spark, folder)).select("doc_id", spans.ai_word_fraction(F.col("scores"), F.col("n_words_of")).alias("fraction"))


@query
def span_windows(spark, folder):
    return spans.with_windows(docs(spark, folder).filter("text is not null").select("doc_id", "text")).select("doc_id", F.posexplode("windows").alias("at", "w")).select("doc_id", "at", "w.a", "w.b")


@query
def join_span_windows(spark, folder):
    """How many windows cover each sentence."""
    w = span_windows(spark, folder).withColumn("s", F.lit(0.0))
    return spans.covered(w).select("doc_id", "idx", "n_windows")


@query
def span_scores(spark, folder):
    s = spans.span_scores(docs(spark, folder).filter("text is not null"), detectors.stylometry, "stylometry")
    return s.select("doc_id", "n_windows", "total_words", spans.reliable(F.col("n_windows"), F.col("total_words")).alias("reliable"), spans.ai_word_fraction(F.col("scores"), F.col("n_words_of")).alias("fraction"), T.mean(F.col("scores")).alias("mean_score"))


# --- models, verdicts, the engine -----------------------------------------------------------------------------------------


def _training(spark, folder) -> tuple[DataFrame, list[str]]:
    d = docs(spark, folder).filter("text is not null and label is not null").select("doc_id", "label", "text")
    rows = features.with_features(d).filter("n_words > 0").select("doc_id", "label", "n_words", *features.NAMES)
    return written(rows, "features"), list(features.NAMES)


@query
def standardizer(spark, folder):
    rows = features.feature_table(docs(spark, folder).filter("text is not null")).filter("n_words > 0")
    return spark.createDataFrame([(k, m, s) for k, (m, s) in supervised.standardizer(rows, features.NAMES).items()], "feature string, mean double, sd double")


@query
def sup_fit(spark, folder):
    rows, keys = _training(spark, folder)
    m = supervised.fit(rows, keys)
    return spark.createDataFrame([(k, round(w, 4)) for k, w in zip(m.keys, m.weights)], "feature string, weight double")


@query
def topk_features(spark, folder):
    rows, keys = _training(spark, folder)
    return spark.createDataFrame([(i + 1, k, w) for i, (k, w) in enumerate(supervised.fit(rows, keys).top_features())], "place int, feature string, weight double")


@query
def sup_score(spark, folder):
    rows, keys = _training(spark, folder)
    return rows.select("doc_id", "label", supervised.fit(rows, keys).score().alias("score"), supervised.reliable(F.col("n_words")).alias("is_reliable"))


@query
def cross_val(spark, folder):
    rows, keys = _training(spark, folder)
    return supervised.cross_val_scores(rows, keys)


@query
def ens_logistic(spark, folder):
    w = _wide(spark, folder).join(scored(spark, folder).select("doc_id", "label").distinct(), "doc_id")
    rows = w.select("label", *[F.coalesce(F.col(n), F.lit(0.5)).alias(f"{n}_score") for n in DETECTORS])
    m = supervised.fit_ensemble(rows, DETECTORS)
    return spark.createDataFrame([*zip(m.keys, m.weights), ("bias", m.bias)], "name string, weight double")


@query
def decide(spark, folder):
    """Verdicts from stylometry, with provenance by source, calibration by language, and the share of AI-like words by
    stand-in sentence scores in texts that are long enough for spans."""
    d = docs(spark, folder).filter("text is not null").select("doc_id", F.col("lang").alias("language"), "text").join(_signals(spark, folder), "doc_id", "left")
    s = _stand_in(detectors.stylometry(T.parsed(d))).withColumn("suspicious", normalize.counts(F.col("text"))["is_suspicious"])
    share = F.when(F.col("n_words") >= 2 * spans.WINDOW_WORDS, spans.ai_word_fraction(F.col("scores"), F.col("n_words_of")))
    s = s.select("doc_id", "language", "status", "n_words", "suspicious", F.col("stylometry_score").alias("score"), share.alias("share"))
    j = conformal.flagged(conformal.with_calibration(s, table(spark, folder, "calibration")))
    out = verdict.decide(F.col("score"), F.col("n_words"), F.col("suspicious"), F.col("calibrated"), F.col("global_threshold"), F.col("threshold"), F.col("share"), F.col("status"))
    return j.select("doc_id", out["label_out"].alias("verdict"), out["verdict_score"].alias("verdict_score"), F.array_join(out["abstain_reasons"], ",").alias("reasons"))


def _primary(spark, folder):
    """The engine's primary, fitted on the labelled documents."""
    return engine.fit_primary(docs(spark, folder))


def _analyzed(spark, folder) -> DataFrame:
    d = docs(spark, folder).filter("text is not null").withColumn("status", _status())
    return engine.analyze(d, table(spark, folder, "calibration"), language="lang", model=_primary(spark, folder), provenance="status")


@query
def engine_score_texts(spark, folder):
    return engine.score_texts(docs(spark, folder).filter("text is not null").select("doc_id", "text"), model=_primary(spark, folder)).select("doc_id", "score")


@query
def engine_analyze(spark, folder):
    return _analyzed(spark, folder).drop("change_point", "explanation").withColumn("abstain_reasons", F.array_join("abstain_reasons", ","))


@query
def explain(spark, folder):
    return _analyzed(spark, folder).groupBy("verdict", "explanation").agg(F.count("*").alias("n"))


@query
def streaming_scores(spark, folder):
    """The same scores from a stream over the documents, run once to its end."""
    from ..streaming.scoring import score_stream_once

    return score_stream_once(spark, f"{folder}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
