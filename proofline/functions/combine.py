"""Row-wise combination of detector scores: ensemble, verdict bands, blend, out-of-distribution flag, provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------------------------
ENSEMBLE_WEIGHTS = {"binoculars": 3.0, "perplexity": 2.5, "stylometry": 1.0, "phrases": 1.0}
BANDS = ((0.80, "likely AI-generated"), (0.60, "leaning AI-generated"), (0.40, "uncertain"), (0.20, "leaning human-written"), (0.00, "likely human-written"))
UNRELIABLE = "insufficient evidence (text too short for any detector to be reliable)"
PRIMARY_WEIGHT, OOD_GAP = 0.60, 0.45
VERIFIED_AI, HUMAN_CLAIM, INVALID, ABSENT, UNKNOWN = "verified_ai", "verified_human_claim", "invalid", "absent", "unknown"
# -------------------------------------------------------------------------------------------------------------


def weighted_mean(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Mean by weight: the preset weights if none are given, 1 for names without one; 0.5 if the weights sum to 0.
    Null scores are left out."""
    weights = ENSEMBLE_WEIGHTS if weights is None else weights
    used = {n: F.when(c.isNotNull(), F.lit(float(weights.get(n, 1.0)))).otherwise(F.lit(0.0)) for n, c in scores.items()}
    whole = sum(used.values(), F.lit(0.0))
    return F.when(whole == 0, F.lit(0.5)).otherwise(F.try_divide(sum((used[n] * F.coalesce(c, F.lit(0.0)) for n, c in scores.items()), F.lit(0.0)), whole))


def reliable(n_words: Column, *parts: Column, least: int = 50) -> Column:
    some = F.lit(False)
    for p in parts:
        some = some | p
    return (n_words >= least) & some


def verdict_band(score: Column, is_reliable: Column) -> Column:
    out = F.when(~is_reliable, F.lit(UNRELIABLE))
    for least, name in BANDS:
        out = out.when(score >= least, F.lit(name))
    return out.otherwise(F.lit(BANDS[-1][1]))


def blend(primary: Column, corroborators: dict[str, Column], weights: dict[str, float] | None = None, primary_weight: float = PRIMARY_WEIGHT) -> Column:
    """Primary and weighted corroborators; a null primary is not usable. With neither, 0.5."""
    if not corroborators:
        return F.coalesce(primary, F.lit(0.5))
    mean = weighted_mean(corroborators, weights or {n: 1.0 for n in corroborators})
    return F.when(primary.isNull(), mean).otherwise(F.lit(primary_weight) * primary + F.lit(1 - primary_weight) * mean)


def ood_gap(primary: Column, corroborators: list[Column]) -> Column:
    """Distance of the primary from the plain mean of the corroborators; 0 without a primary."""
    mean = sum(corroborators, F.lit(0.0)) / len(corroborators)
    return F.when(primary.isNull(), F.lit(0.0)).otherwise(F.abs(primary - mean))


def is_ood(gap: Column) -> Column:
    return gap >= OOD_GAP


def with_provenance(score: Column, status: Column) -> Column:
    """The score is never lowered; a null status is "not checked"."""
    return F.when(status == VERIFIED_AI, F.greatest(score, F.lit(0.99))).when(status == INVALID, F.greatest(score, F.least(F.lit(1.0), score + 0.10))).otherwise(score)


def is_ai_evidence(status: Column) -> Column:
    return F.coalesce(status == VERIFIED_AI, F.lit(False))


def is_informative(status: Column) -> Column:
    return F.coalesce(status.isin(VERIFIED_AI, INVALID), F.lit(False))
