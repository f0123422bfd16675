"""The whole pipeline from a text to a verdict, as one plan.

Normalise, score with the corroborating detectors and the optional supervised primary, blend, flag out-of-distribution
texts, fold in provenance, attribute spans, decide. Everything up to the blend is one stage over the scan; spans add one
shuffle by document, calibrations one small join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import combine, detectors, features, normalize, plain
from ..operators import attacks, conformal, evasion, spans, supervised, verdict
from ..operators.supervised import LogisticModel
from ..scratch import once, written

CORROBORATORS = ("phrases", "stylometry")
PRIMARY_KEYS = [*features.NAMES, *(f"detector_{n}" for n in CORROBORATORS)]


def _figures(df: DataFrame, text: str, lexicon: str | None = None) -> DataFrame:
    """``df`` with the columns ``PRIMARY_KEYS``, the corroborators' scores and ``n_words``; the text is parsed once."""
    made = detectors.phrases(detectors.stylometry(features.with_features(df, text), text), text, lexicon)
    return made.withColumns({f"detector_{n}": F.col(f"{n}_score") for n in CORROBORATORS})


def fit_primary(df: DataFrame, text: str = "text", label: str = "label") -> LogisticModel:
    """The supervised primary, fitted on texts as they are. Texts without words or without a label are left out."""
    rows = _figures(df.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, label), text).filter("n_words > 0")
    return supervised.fit(written(rows.select(label, *PRIMARY_KEYS), "training"), PRIMARY_KEYS, label)


def fit_primary_plain(df: DataFrame, text: str = "text", label: str = "label") -> LogisticModel:
    """``fit_primary`` with figures made in Python, which takes less CPU time."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = plain.Scorer()
        for b in batches:
            rows = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (f := scorer.figures(t)) is not None:
                    rows.append((y, *(f[k] for k in PRIMARY_KEYS)))
                scorer.forget()
            columns = list(zip(*rows)) or [()] * (len(PRIMARY_KEYS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], [label, *PRIMARY_KEYS])

    rows = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, F.col(label).cast("double").alias(label))
    figures = rows.mapInArrow(made, ", ".join(f"`{k}` double" for k in (label, *PRIMARY_KEYS)))
    return supervised.fit(written(figures, "training"), PRIMARY_KEYS, label)


def primary_detector(model: LogisticModel):
    """The primary as a detector of texts: adds ``primary_score``, 0.5 for a text without words."""
    return lambda df, text: _scores(df.drop("tokens", "sents", "lengths"), text, model).withColumn("primary_score", F.coalesce("primary", F.lit(0.5)))


def _scores(df: DataFrame, text: str, model: LogisticModel | None, lexicon: str | None = None) -> DataFrame:
    """``df`` with the corroborators' scores, ``primary`` (null without a model or without words), ``n_words``."""
    if model is None:
        return detectors.scored(df, text, lexicon).withColumn("primary", F.lit(None).cast("double"))
    return _figures(df, text, lexicon).withColumn("primary", F.when(F.col("n_words") > 0, model.score()))


def blended() -> Column:
    return combine.blend(F.col("primary"), {n: F.col(f"{n}_score") for n in CORROBORATORS})


def score_texts(df: DataFrame, text: str = "text", model: LogisticModel | None = None, defended: bool = True) -> DataFrame:
    """``df`` with ``score``; ``defended=False`` skips normalisation."""
    kept = df.columns
    hits = detectors.normalized_lexicon_hits(normalize.mapped(F.col(text))) if defended else detectors.lexicon_hits(F.col(text))
    used = df.withColumns({"_t": normalize.normalized(F.col(text)) if defended else F.col(text), "_hits": hits})
    return once(_scores(used, "_t", model, "_hits").select(*kept, blended().alias("score")))


def robustness(df: DataFrame, text: str = "text", model: LogisticModel | None = None, seed: int = 0) -> DataFrame:
    """Mean scores of the texts under each attack, ``evasion.robustness_report``. A score depends on nothing but the text
    (if defended, the normalised one), so that of a text's 13 versions only the different ones are scored, once each. A
    null text counts as a row and has no score."""
    names, linear = attacks.attack_names(), None if model is None else plain.linear(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, attacker = plain.Scorer(), attacks.Attacker(seed)
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                if t is None:
                    rows += [(n, None, None, None) for n in names]
                    continue
                scores: dict[str, float] = {}

                def score(version: str) -> float:
                    if version not in scores:
                        scores[version] = scorer.score(version, linear)
                    return scores[version]

                baseline, versions = score(plain.normalized(t)), attacker.all(t)
                rows += [(n, baseline, score(versions[n]), score(plain.normalized(versions[n]))) for n in names]
                scorer.forget()
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.string(), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["attack", "baseline", "undefended", "defended"])

    return evasion.robustness_report(df.select(text).mapInArrow(made, "attack string, baseline double, undefended double, defended double"))


def analyze(df: DataFrame, calibrations: DataFrame, key: str = "doc_id", text: str = "text", language: str = "language", model: LogisticModel | None = None, provenance: str | None = None, want_spans: bool = True) -> DataFrame:
    """One row per text with its scores, flags and verdict. Calibrated thresholds are for normalised texts; a null
    language has no calibration."""
    base = df.select(key, F.col(language).alias("language"), F.col(text).alias("_raw"), (F.col(provenance) if provenance else F.lit(None).cast("string")).alias("provenance"))
    base = base.withColumn("_hits", detectors.normalized_lexicon_hits(normalize.mapped(F.col("_raw"))))
    base = normalize.with_report(base, "_raw").drop("_raw")
    scored = _scores(base, "clean", model, "_hits")
    gap = combine.ood_gap(F.col("primary"), [F.col(f"{n}_score") for n in CORROBORATORS])
    scored = scored.select(
        key, "language", "provenance", "is_suspicious", "homoglyphs_replaced", "invisibles_removed", "n_words", "primary", *[f"{n}_score" for n in CORROBORATORS],
        combine.with_provenance(blended(), F.col("provenance")).alias("score"), gap.alias("ood_gap"), combine.is_ood(gap).alias("is_ood"),
    )
    scored = once(scored)
    if want_spans:
        name = CORROBORATORS[0] if model is None else "primary"
        score = detectors.detector(name) if model is None else primary_detector(model)
        # the explode keeps Spark from inlining the Python function that made ``clean`` into all that is built on it
        s = spans.span_scores(base.select(key, F.explode(F.array("clean")).alias("clean")), score, name, key, "clean")
        ok = spans.reliable(F.col("n_windows"), F.col("total_words"))
        s = s.select(key, F.when(ok, spans.ai_word_fraction(F.col("scores"), F.col("n_words_of"))).alias("ai_word_fraction"), F.when(ok, spans.change_point(F.col("scores"))).alias("change_point"))
        scored = scored.join(s, key, "left")
    else:
        scored = scored.withColumns({"ai_word_fraction": F.lit(None).cast("double"), "change_point": F.lit(None).cast("struct<cut:int,delta:double>")})
    joined = conformal.with_calibration(scored, calibrations)
    joined = joined.withColumn("_threshold", conformal.threshold_for(F.col("n_words"), F.col("bin_edges"), F.col("bin_thresholds"), F.col("global_threshold")))
    out = verdict.decide(F.col("score"), F.col("n_words"), F.col("is_suspicious"), F.col("calibrated"), F.col("global_threshold"), F.col("_threshold"), F.col("ai_word_fraction"), F.col("provenance"))
    done = joined.withColumns({"verdict": out["label_out"], "verdict_score": out["verdict_score"], "abstain_reasons": out["abstain_reasons"], "threshold": out["threshold_out"]})
    done = done.withColumn("explanation", verdict.explain(F.col("verdict"), F.col("abstain_reasons"), F.col("ai_word_fraction")))
    return done.select(
        key, "language", "n_words", "score", "primary", *[f"{n}_score" for n in CORROBORATORS], "ood_gap", "is_ood", "is_suspicious", "ai_word_fraction", "change_point",
        "verdict", "verdict_score", "abstain_reasons", "threshold", "alpha", "explanation",
    )
