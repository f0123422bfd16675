"""Detectors: from a text to a score in [0, 1], whether it is reliable, and details.

Stylometry and all counts of the phrase detector but the lexicon are Column expressions. The lexicon's phrases claim
their span of text, the longest first; that order can't be expressed by one pattern, so it runs as an Arrow function
that looks only for phrases a text contains.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from . import text as T
from .features import em_dashes
from .lexicon import LEXICON, RATE_SCALE, SCORE_FLOOR, STRUCTURAL, TRIAD, TRIADS_PER_SENTENCE

# --- fixed values: stylometry's midpoint, scale, whether AI is high, and weight --------------------------
STYLOMETRY = {
    "burstiness": (0.42, 0.12, False, 0.34),
    "short_sentence_rate": (0.08, 0.05, False, 0.16),
    "mattr": (0.72, 0.06, False, 0.14),
    "mean_word_len": (4.55, 0.35, True, 0.16),
    "em_dash_per_kw": (2.0, 1.2, True, 0.20),
}
MIN_RELIABLE_WORDS, MIN_SENTENCES = 50, 4
# ---------------------------------------------------------------------------------------------------------


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def stylometry(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with stylometry_score, stylometry_reliable and the raw figures. It needs the columns of ``text.parsed``.
    No words: score 0.5, not reliable."""
    lengths, tokens = F.col("lengths"), F.col("tokens")
    df = df.withColumns({"n_words": F.size(tokens), "n_sentences": F.size(lengths), "_mean": T.mean(lengths)})
    few = F.col("n_sentences") < MIN_SENTENCES
    df = df.withColumns(
        {
            "burstiness": T.variation(F.col("_mean"), T.stdev(lengths, F.col("_mean"))),
            "short_sentence_rate": F.coalesce(F.try_divide(F.size(F.filter(lengths, lambda v: v <= 4)), F.size(lengths)), F.lit(0.0)),
            "mattr": T.mattr(tokens),
            "mean_word_len": T.mean(F.transform(tokens, lambda w: F.length(w).cast("double"))),
            "em_dash_per_kw": F.coalesce(F.try_divide(em_dashes(F.col(text)) * 1000.0, F.col("n_words")), F.lit(0.0)),
        }
    )
    top = bottom = F.lit(0.0)
    for name, (mid, scale, high, weight) in STYLOMETRY.items():
        used = F.when(few, F.lit(0.0)).otherwise(F.lit(weight)) if name in ("burstiness", "short_sentence_rate") else F.lit(weight)
        x = (F.col(name) - mid) / scale
        top, bottom = top + used * T.logistic(x if high else -x), bottom + used
    score = F.when(F.col("n_words") == 0, F.lit(0.5)).otherwise(clamped(top / bottom))
    return df.withColumns({"stylometry_score": score, "stylometry_reliable": (F.col("n_words") >= MIN_RELIABLE_WORDS) & ~few}).drop("_mean")


@lru_cache(maxsize=1)
def _phrases() -> list[tuple[str, re.Pattern]]:
    return [(p, re.compile(rf"(?<!\w){re.escape(p)}(?!\w)")) for p in sorted(LEXICON, key=len, reverse=True)]


def claim(lowered: str) -> dict[str, int]:
    """Hits per phrase. A matched span is blanked out, so that shorter phrases in it are not charged again."""
    hits = {}
    for phrase, pattern in _phrases():
        if phrase in lowered:
            lowered, n = pattern.subn("\u0001", lowered)
            if n:
                hits[phrase] = n
    return hits


_HITS = ArrayType(StructType([StructField("phrase", StringType()), StructField("n", IntegerType()), StructField("weight", DoubleType())]))


@pandas_udf(_HITS)
def lexicon_hits(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"phrase": p, "n": n, "weight": LEXICON[p]} for p, n in claim(t.lower()).items()] if t else [])


@pandas_udf(_HITS)
def normalized_lexicon_hits(texts: pd.Series) -> pd.Series:
    """Hits of mapped texts after NFKC. One Python function on top of another would make Spark inline all expressions
    between them, so that this one does both."""
    form = lambda t: unicodedata.normalize("NFKC", t).lower()
    return texts.map(lambda t: [{"phrase": p, "n": n, "weight": LEXICON[p]} for p, n in claim(form(t)).items()] if t else [])


def structural_hits(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(java)) for name, java, _ in STRUCTURAL}


def triads(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TRIAD))


def phrases(df: DataFrame, text: str = "text", lexicon: str | None = None) -> DataFrame:
    """``df`` with phrases_score, phrases_reliable and the counts. It needs the columns of ``text.parsed``; ``lexicon``
    may name a column that holds the lexicon's hits already."""
    t = F.col(text)
    df = df.withColumns({"lexicon": F.col(lexicon) if lexicon else lexicon_hits(t), **structural_hits(t), "triads": triads(t), "n_words": F.size("tokens")})
    lexical = F.aggregate("lexicon", F.lit(0.0), lambda a, h: a + h["n"] * h["weight"])
    structural = sum((F.col(name) * weight for name, _, weight in STRUCTURAL), F.lit(0.0))
    over = F.col("triads") - F.lit(TRIADS_PER_SENTENCE) * F.greatest(F.size("sents"), F.lit(1))
    weighted = lexical + structural + T.softplus(over)
    rate = F.try_divide(weighted * 1000.0, F.col("n_words"))
    score = F.lit(SCORE_FLOOR) + F.lit(1.0 - SCORE_FLOOR) * (F.lit(1.0) - F.exp(-F.col("phrase_rate") / RATE_SCALE))
    df = df.withColumns({"phrase_rate": rate})
    return df.withColumns({"phrases_score": F.when(F.col("n_words") == 0, F.lit(0.5)).otherwise(clamped(score)), "phrases_reliable": F.col("n_words") >= MIN_RELIABLE_WORDS})


def top_hits(lexicon: Column, k: int = 12) -> Column:
    """The k hits with the largest weight times count, ties by phrase."""
    key = lambda h: F.struct((-h["n"] * h["weight"]).alias("by"), h["phrase"].alias("phrase"), h["n"].alias("n"))
    return F.slice(F.array_sort(F.transform(lexicon, key)), 1, k)


def scored(df: DataFrame, text: str = "text", lexicon: str | None = None) -> DataFrame:
    """``df`` with all native detectors' columns; the text is parsed once."""
    return phrases(stylometry(T.parsed(df, text), text), text, lexicon)


# --- detectors as plug-ins ---------------------------------------------------------------------------------

_REGISTRY: dict[str, Callable[[DataFrame, str], DataFrame]] = {"stylometry": stylometry, "phrases": phrases}
OPTIONAL = {"perplexity": ("torch", "transformers"), "binoculars": ("torch", "transformers")}


def detector_names() -> list[str]:
    """Names of all detectors, without constructing one."""
    return sorted([*_REGISTRY, *OPTIONAL])


def available_detectors() -> list[str]:
    """Names of the detectors whose libraries are installed."""
    from importlib.util import find_spec

    return sorted([*_REGISTRY, *(n for n, needs in OPTIONAL.items() if n not in _REGISTRY and all(map(find_spec, needs)))])


def register(name: str, score: Callable[[DataFrame, str], DataFrame]) -> None:
    """Adds a detector: ``score(df, text)`` adds the columns <name>_score and <name>_reliable."""
    _REGISTRY[name] = score


def detector(name: str) -> Callable[[DataFrame, str], DataFrame]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown detector {name!r}; known: {detector_names()}")
    return _REGISTRY[name]


def model_detector(name: str, score_batch: Callable[[list[str]], list[float | None]]) -> Callable[[DataFrame, str], DataFrame]:
    """A detector from a function that scores a batch of texts in Python; it may load a model once per worker.
    A score of None (for instance of an empty text) becomes 0.5 and is not reliable."""

    @pandas_udf(DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else float(s) for s in score_batch([t or "" for t in texts])], dtype="float64")

    def score(df: DataFrame, text: str = "text") -> DataFrame:
        df = df.withColumns({"_raw": run(F.col(text)), "_n": T.n_words(F.col(text))})
        given = F.col("_raw").isNotNull() & ~F.isnan("_raw")
        return df.withColumns({f"{name}_score": F.when(given, clamped(F.col("_raw"))).otherwise(F.lit(0.5)), f"{name}_reliable": given & (F.col("_n") >= MIN_RELIABLE_WORDS)}).drop("_raw", "_n")

    return score


class TransformerClassifier:
    """The place for a fine-tuned classifier: subclass it and implement ``score_batch``."""

    name = "transformer"

    def score_batch(self, texts: list[str]) -> list[float | None]:
        raise NotImplementedError("subclass TransformerClassifier and implement score_batch with a model or an API")

    def __call__(self, df: DataFrame, text: str = "text") -> DataFrame:
        return model_detector(self.name, self.score_batch)(df, text)
