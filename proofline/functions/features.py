"""The interpretable feature vector of a text: 23 figures over the parsed columns of ``text.parsed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# --- fixed values: word lists and limits ---------------------------------------------------------------
FIRST_PERSON = ("i", "i'm", "i've", "my", "me")
HEDGES = ("maybe", "probably", "roughly", "sort", "kind", "seems", "guess")
SHORT_SENTENCE, LONG_SENTENCE, LONG_WORD = 4, 30, 8
NAMES = (
    "burstiness mean_sentence_len sd_sentence_len short_sentence_rate long_sentence_rate mattr mean_word_len sd_word_len "
    "long_word_rate em_dash_per_kw semicolon_per_kw colon_per_kw comma_per_kw question_per_kw exclaim_per_kw quote_per_kw "
    "paren_per_kw digit_rate uppercase_rate contraction_per_kw first_person_per_kw hedge_per_kw log_n_words"
).split()
# ---------------------------------------------------------------------------------------------------------


def em_dashes(text: Column) -> Column:
    return T.occurrences(text, "—") + T.occurrences(text, " -- ")


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the parsed columns and the features. A text without words has null features."""
    base = T.parsed(df, text)
    t, tokens, lengths = F.col(text), F.col("tokens"), F.col("lengths")
    base = base.withColumns({"n_words": F.size("tokens"), "word_lens": F.transform("tokens", lambda w: F.length(w).cast("double"))})
    base = base.withColumns({"mean_sentence_len": T.mean(lengths), "mean_word_len": T.mean(F.col("word_lens"))})
    base = base.withColumns({"sd_sentence_len": T.stdev(lengths, F.col("mean_sentence_len")), "sd_word_len": T.stdev(F.col("word_lens"), F.col("mean_word_len"))})
    n, n_sents = F.col("n_words"), F.greatest(F.size(lengths), F.lit(1))
    per_kw = F.when(n > 0, F.lit(1000.0) / n)
    share = lambda keep: F.size(F.filter(tokens, keep))
    size = F.greatest(F.length(t), F.lit(1))
    made = {
        "burstiness": T.variation(F.col("mean_sentence_len"), F.col("sd_sentence_len")),
        "short_sentence_rate": F.size(F.filter(lengths, lambda v: v <= SHORT_SENTENCE)) / n_sents,
        "long_sentence_rate": F.size(F.filter(lengths, lambda v: v >= LONG_SENTENCE)) / n_sents,
        "mattr": T.mattr(tokens),
        "long_word_rate": F.try_divide(share(lambda w: F.length(w) >= LONG_WORD), n),
        "em_dash_per_kw": em_dashes(t) * per_kw,
        **{f"{k}_per_kw": T.occurrences(t, c) * per_kw for k, c in (("semicolon", ";"), ("colon", ":"), ("comma", ","), ("question", "?"), ("exclaim", "!"), ("paren", "("))},
        "quote_per_kw": (T.occurrences(t, '"') + T.occurrences(t, "“")) * per_kw,
        "digit_rate": F.regexp_count(t, F.lit(r"[\p{Nd}²³¹⁰-⁹₀-₉①-⑨]")) / size,
        "uppercase_rate": F.regexp_count(t, F.lit(r"(?U)\p{Upper}")) / size,
        "contraction_per_kw": share(lambda w: w.contains("'")) * per_kw,
        "first_person_per_kw": share(lambda w: w.isin(*FIRST_PERSON)) * per_kw,
        "hedge_per_kw": share(lambda w: w.isin(*HEDGES)) * per_kw,
        "log_n_words": F.log1p(n),
    }
    done = base.withColumns(made)
    return done.withColumns({k: F.when(n > 0, F.col(k)) for k in NAMES})


def feature_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return with_features(df.select(key, text), text).select(key, "n_words", *NAMES)
