"""The arithmetic of the two model-based detectors, on given figures. Models and weights are the caller's:
``detectors.model_detector`` turns a batch function that computes them into a detector."""

from __future__ import annotations

import math

import numpy as np

# --- fixed values ------------------------------------------------------------------------------------------
PPL_MID, PPL_SCALE, BURST_MID, BURST_SCALE, PPL_WEIGHT, BURST_WEIGHT = 3.65, 0.45, 0.55, 0.20, 0.7, 0.3
RATIO_MID, RATIO_SCALE, MIN_SENTENCES, MIN_SENTENCE_WORDS = 0.94, 0.05, 3, 3
# -------------------------------------------------------------------------------------------------------------


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x >= 0 else 1.0 - 1.0 / (1.0 + math.exp(x))


def perplexity_score(log_ppl: float | None, sentence_log_ppl: list[float]) -> float | None:
    """From the mean negative log-likelihood per token of a text and those of its sentences of at least three words.
    None for a text of fewer than two tokens."""
    if log_ppl is None:
        return None
    low = _logistic((PPL_MID - log_ppl) / PPL_SCALE)
    if len(sentence_log_ppl) < MIN_SENTENCES:
        return low
    return PPL_WEIGHT * low + BURST_WEIGHT * _logistic((BURST_MID - float(np.std(sentence_log_ppl, ddof=1))) / BURST_SCALE)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    shifted = logits - logits.max(-1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(-1, keepdims=True))


def binoculars_ratio(observer: np.ndarray, performer: np.ndarray, tokens: np.ndarray) -> float | None:
    """Observer's log perplexity over the cross-entropy of the observer's distribution with the performer's log
    probabilities. The logits are one row per token; row i predicts token i + 1."""
    if len(tokens) < 2:
        return None
    seen, other, ids = _log_softmax(observer[:-1]), _log_softmax(performer[:-1]), np.asarray(tokens[1:])
    cross = float(-(np.exp(seen) * other).sum(-1).mean())
    return None if cross == 0.0 else float(-seen[np.arange(len(ids)), ids].mean()) / cross


def binoculars_score(ratio: float | None) -> float | None:
    return None if ratio is None else _logistic((RATIO_MID - ratio) / RATIO_SCALE)
