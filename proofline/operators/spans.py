"""Scores of sentences from overlapping windows of sentences, and the best single change point.

A window must hold enough words to be judged, so a sentence gets the mean score of the windows that cover it. The greedy
choice of windows follows one sentence after the other and is an Arrow function over sentence lengths; windows are
scored by any detector as rows of a table; what comes back per document is an array no longer than the document.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import text as T

# --- fixed values ------------------------------------------------------------------------------------------
WINDOW_WORDS, STRIDE_WORDS = 120, 60
MIN_WINDOWS, MIN_SEGMENT, MIN_DELTA, SPAN_THRESHOLD = 3, 2, 0.25, 0.5
# -------------------------------------------------------------------------------------------------------------


def windows_of(lengths: list[int], window: int = WINDOW_WORDS, stride: int = STRIDE_WORDS) -> list[tuple[int, int]]:
    """Half-open sentence ranges: each is the shortest from its start with ``window`` words; the next starts about
    ``stride`` words later, and the last one reaches the end."""
    n, out, start = len(lengths), [], 0
    upto = [0]
    for v in lengths:
        upto.append(upto[-1] + v)
    while start < n:
        end = start
        while end < n and upto[end] - upto[start] < window:
            end += 1
        out.append((start, end))
        if end == n:
            break
        step = start
        while step < n - 1 and upto[step] - upto[start] < stride:
            step += 1
        start = max(step, start + 1)
    return out


@pandas_udf(ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])))
def span_windows(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda v: [] if v is None else [{"a": a, "b": b} for a, b in windows_of([int(x) for x in v])])


def with_windows(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its sentences, their word counts and the windows."""
    df = df.withColumn("sents", T.sentences(F.col(text)))
    df = df.withColumn("n_words_of", F.transform("sents", T.n_words))
    return df.withColumn("windows", span_windows("n_words_of"))


def span_scores(df: DataFrame, score: Callable[[DataFrame, str], DataFrame], name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words_of, scores, n_covering, n_windows, total_words): arrays over the document's sentences.

    ``score`` adds ``<name>_score`` to a table of texts. A text without sentences has empty arrays."""
    base = with_windows(df.select(key, text), text)
    texts = F.transform("windows", lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), F.array_join(F.slice("sents", w["a"] + 1, w["b"] - w["a"]), " ").alias("window_text")))
    windows = base.select(key, F.inline(texts))
    judged = score(T.parsed(windows, "window_text"), "window_text").select(key, "a", "b", F.col(f"{name}_score").alias("s"))
    per = covered(judged, key)
    held = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "score", "n_windows"))).alias("w"))
    none = F.array().cast("array<struct<idx:int,score:double,n_windows:bigint>>")
    joined = base.select(key, "n_words_of", F.size("windows").alias("n_windows")).join(held, key, "left").withColumn("w", F.coalesce("w", none))
    return joined.select(
        key,
        "n_words_of",
        F.transform("w", lambda w: F.coalesce(w["score"], F.lit(0.5))).alias("scores"),
        F.transform("w", lambda w: w["n_windows"].cast("int")).alias("n_covering"),
        "n_windows",
        F.aggregate("n_words_of", F.lit(0), lambda a, v: a + v).alias("total_words"),
    )


def covered(windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, score, n_windows) for each sentence of windows (key, a, b, s): the mean score of those that cover it.
    Every sentence is in a window, as a window begins no later than the one before ends."""
    each = windows.select(key, F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int") - 1)).alias("idx"), "s")
    return each.groupBy(key, "idx").agg(F.avg("s").alias("score"), F.count("*").alias("n_windows"))


def reliable(n_windows: Column, total_words: Column, window: int = WINDOW_WORDS) -> Column:
    return (n_windows >= MIN_WINDOWS) & (total_words >= 2 * window)


def ai_word_fraction(scores: Column, n_words_of: Column, threshold: float = SPAN_THRESHOLD) -> Column:
    """Share of the words that are in sentences at or above the threshold; 0 without words."""
    both = F.aggregate(
        F.zip_with(scores, n_words_of, lambda s, n: F.struct(n.cast("double").alias("n"), F.when(s >= threshold, n.cast("double")).otherwise(F.lit(0.0)).alias("ai"))),
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("ai")), lambda a, v: F.struct((a["n"] + v["n"]).alias("n"), (a["ai"] + v["ai"]).alias("ai")),
    )
    return F.when(both["n"] > 0, both["ai"] / both["n"]).otherwise(F.lit(0.0))


def change_point(scores: Column, least: int = MIN_SEGMENT, delta: float = MIN_DELTA) -> Column:
    """Struct (cut, delta, mean_before, mean_after, is_significant) of the split with the largest two-sample statistic,
    the first if several are equal to 12 places; null with fewer than twice ``least`` scores."""
    n = F.size(scores)
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("stat"), F.lit(0).alias("cut"), F.lit(0.0).alias("before"), F.lit(0.0).alias("after"))

    def scan(whole: Column) -> Column:
        """One pass in index order, with the sum of all scores at hand."""

        def step(acc: Column, value: Column) -> Column:
            i, upto = acc["i"] + 1, acc["sum"] + value
            before, after = upto / i, F.coalesce(F.try_divide(whole - upto, n - i), F.lit(0.0))
            stat = F.round(F.abs(after - before) * F.sqrt(i * (n - i) / n), 12)
            better = (i >= least) & (i <= n - least) & (stat > acc["stat"])
            pick = lambda new, old: F.when(better, new).otherwise(acc[old]).alias(old)
            return F.struct(i.alias("i"), upto.alias("sum"), pick(stat, "stat"), pick(i, "cut"), pick(before, "before"), pick(after, "after"))

        return F.aggregate(scores, start, step)

    best = F.element_at(F.transform(F.array(T.total(scores)), scan), 1)  # an array of one, so that the sum is made once
    shift = lambda b: b["after"] - b["before"]
    found = F.transform(
        F.array(best),
        lambda b: F.struct(b["cut"].alias("cut"), shift(b).alias("delta"), b["before"].alias("mean_before"), b["after"].alias("mean_after"), (F.abs(shift(b)) >= delta).alias("is_significant")),
    )
    return F.when(n >= 2 * least, F.element_at(found, 1))
