"""From a score and its context to a verdict, or to an abstention with its reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.combine import VERIFIED_AI
from . import conformal

# --- fixed values ------------------------------------------------------------------------------------------
MIN_WORDS, MIXED_LOWER, MIXED_UPPER, VERIFIED_SCORE = 100, 0.15, 0.85, 0.99
HUMAN, AI, MIXED, ABSTAIN = "human", "ai", "mixed", "abstain"
TOO_SHORT, NO_CALIBRATION, UNCERTIFIED, TAMPERED = "text_too_short", "no_calibration_for_language", "calibration_too_small_for_fpr_cap", "unicode_tampering_detected"
# -------------------------------------------------------------------------------------------------------------


def reasons(n_words: Column, suspicious: Column, calibrated: Column, is_certified: Column) -> Column:
    """Why no verdict is given, in a fixed order."""
    tests = ((n_words < MIN_WORDS, TOO_SHORT), (suspicious, TAMPERED), (~calibrated, NO_CALIBRATION), (calibrated & ~is_certified, UNCERTIFIED))
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests]), lambda r: r.isNotNull())


def decide(score: Column, n_words: Column, suspicious: Column, calibrated: Column, whole: Column, threshold: Column, fraction: Column, provenance: Column) -> dict[str, Column]:
    """Columns label, verdict_score, abstain_reasons, threshold. ``fraction`` is null where spans are not reliable;
    ``whole`` is the global threshold of the calibration, ``threshold`` the one for this length."""
    why = reasons(n_words, suspicious, calibrated, conformal.certified(whole))
    proven = F.coalesce(provenance == VERIFIED_AI, F.lit(False))
    mixed = F.coalesce(fraction.between(MIXED_LOWER, MIXED_UPPER), F.lit(False))
    label = F.when(proven, F.lit(AI)).when(F.size(why) > 0, F.lit(ABSTAIN)).when(mixed, F.lit(MIXED)).when(score >= threshold, F.lit(AI)).otherwise(F.lit(HUMAN))
    return {
        "label_out": label,
        "verdict_score": F.when(proven, F.greatest(score, F.lit(VERIFIED_SCORE))).otherwise(score),
        "abstain_reasons": F.when(proven, F.array().cast("array<string>")).otherwise(why),
        "threshold_out": F.when(~proven & (F.size(why) == 0), threshold),
    }


def explain(label: Column, why: Column, fraction: Column) -> Column:
    """One sentence for a reader."""
    return (
        F.when(label == ABSTAIN, F.concat(F.lit("no verdict: "), F.array_join(F.transform(why, lambda r: F.translate(r, "_", " ")), "; ")))
        .when(label == MIXED, F.format_string("human and AI passages: about %.0f%% of the words are AI-like", F.coalesce(fraction, F.lit(0.0)) * 100))
        .when(label == AI, F.lit("AI: the score reaches the threshold that caps false positives"))
        .otherwise(F.lit("human: the score stays below the threshold that caps false positives"))
    )
