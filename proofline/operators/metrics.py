"""Evaluation metrics over a scored table (detector, label, score, ...), one row per detector or group.

Every metric is an aggregate by detector. Those that rank work on counts per distinct score and cumulate them with
``running.cumulated``, so that no task ever sorts all scores of a detector. Comparisons with a threshold are inclusive. Rows with a null label
or score are left out by ``usable``. Where a metric is undefined (a missing class), it is null.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import cumulated

Z95 = 1.96
ECE_BINS = 10


def usable(scored: DataFrame) -> DataFrame:
    """Rows with a label of 0 or 1 and a score."""
    return scored.filter("label in (0, 1) and score is not null")


def deliveries(scored: DataFrame) -> DataFrame:
    """``scored`` without repeated deliveries: rows that are equal but for ``loaded_at`` count once."""
    return scored.dropDuplicates([c for c in scored.columns if c != "loaded_at"])


def validate(scored: DataFrame) -> DataFrame:
    """One row per detector: rows, both class counts, labels that are no label, and whether ranking metrics are defined."""
    return scored.groupBy("detector").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 0).alias("n_human"),
        F.count_if(F.col("label") == 1).alias("n_ai"),
        F.count_if(F.coalesce(~F.col("label").isin(0, 1), F.lit(True)) | F.col("score").isNull()).alias("n_unusable"),
    ).withColumn("valid", (F.col("n_human") > 0) & (F.col("n_ai") > 0) & (F.col("n_unusable") == 0))


def confusion(scored: DataFrame, threshold: float = 0.5, by: str = "detector") -> DataFrame:
    flag, ai = F.col("score") >= threshold, F.col("label") == 1
    return scored.groupBy(by).agg(F.count_if(flag & ai).alias("tp"), F.count_if(flag & ~ai).alias("fp"), F.count_if(~flag & ~ai).alias("tn"), F.count_if(~flag & ai).alias("fn"))


def _or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def classification(scored: DataFrame, threshold: float = 0.5, by: str = "detector") -> DataFrame:
    """Accuracy, precision, recall, F1 and false positive rate; each is 0 where its denominator is."""
    c = confusion(scored, threshold, by)
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))
    c = c.withColumns({"precision": _or_zero(tp, tp + fp), "recall": _or_zero(tp, tp + fn), "accuracy": _or_zero(tp + tn, tp + fp + tn + fn), "fpr": _or_zero(fp, fp + tn)})
    return c.withColumn("f1", _or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def brier(scored: DataFrame, by: str = "detector") -> DataFrame:
    return scored.groupBy(by).agg(F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"))


def ece(scored: DataFrame, by: str = "detector", bins: int = ECE_BINS) -> DataFrame:
    """Expected calibration error over equal-width bins; scores outside [0, 1] fall into the outer bins."""
    cell = F.least(F.greatest((F.col("score") * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    per = scored.groupBy(by, cell.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("confidence"), F.avg("label").alias("accuracy"))
    return per.groupBy(by).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def score_counts(scored: DataFrame, by: str = "detector") -> DataFrame:
    """Rows and AI rows per distinct score: what all ranking metrics start from."""
    return scored.groupBy(by, "score").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("n_pos"))


def _cumulated(scored: DataFrame, by: str) -> DataFrame:
    """(detector, score, n, n_pos, the two below the score and over all scores, the bucket): what ranks are made of."""
    return cumulated(score_counts(scored, by), [by], "score", ["n", "n_pos"])


def average_ranks(scored: DataFrame, by: str = "detector") -> DataFrame:
    """(detector, score, n, n_pos, rank): ranks from the lowest score, ties share their mean rank."""
    return _cumulated(scored, by).select(by, "score", "n", "n_pos", (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank"))


def _auroc() -> Column:
    """Over the rows of one detector in ``_cumulated``: AI rows above each human row, ties counted half."""
    p, n, below = F.col("n_pos").cast("double"), F.col("n") - F.col("n_pos"), F.col("n_below") - F.col("n_pos_below")
    return F.try_divide(F.sum(p * (below + n / 2)), F.sum("n_pos").cast("double") * F.sum(F.col("n") - F.col("n_pos")))


def auroc(scored: DataFrame, by: str = "detector") -> DataFrame:
    """Area under the ROC curve; null if a class is missing."""
    return _cumulated(scored, by).groupBy(by).agg(_auroc().alias("auroc"))


def _rates() -> tuple[Column, Column]:
    """False and true positive rate at the threshold of a row of ``_cumulated``."""
    n, below = F.col("n_whole") - F.col("n_pos_whole"), F.col("n_below") - F.col("n_pos_below")
    return F.try_divide((n - below).cast("double"), n), F.try_divide((F.col("n_pos_whole") - F.col("n_pos_below")).cast("double"), F.col("n_pos_whole"))


def roc_points(scored: DataFrame, by: str = "detector") -> DataFrame:
    """(detector, threshold, fpr, tpr) for each distinct score, and the origin with threshold infinity."""
    fpr, tpr = _rates()
    points = _cumulated(scored, by).select(by, F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    origin = scored.select(by).distinct().select(by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def _best(budget: float) -> Column:
    """Struct (tpr, threshold) of the best rate within the budget over one detector's rows, at the highest threshold
    that reaches it; the origin if no score is within it."""
    fpr, tpr = _rates()
    inside = F.max(F.when(fpr <= budget, F.struct(tpr.alias("tpr"), F.col("score").alias("threshold"))))
    origin = F.struct(F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return F.when(inside["tpr"] > 0, inside).otherwise(origin)


def tpr_at_fpr(scored: DataFrame, budget: float, by: str = "detector") -> DataFrame:
    """(detector, tpr, threshold): the best rate within the budget, at the highest threshold that reaches it."""
    return _cumulated(scored, by).groupBy(by).agg(_best(budget).alias("b")).select(by, F.col("b.tpr").alias("tpr"), F.col("b.threshold").alias("threshold"))


def threshold_at_fpr(scored: DataFrame, target: float, by: str = "detector") -> DataFrame:
    """(detector, cut): a text is flagged if score > cut. ``cut`` is the first human score, from above, that may
    not be flagged; -infinity if all may be. It is found on distinct scores."""
    human = scored.filter("label = 0").groupBy(by, "score").agg(F.count("*").alias("n"))
    ranked = cumulated(human, [by], "score", ["n"])
    refused = F.col("n_whole") - F.col("n_below") > F.floor(F.col("n_whole") * F.lit(float(target)))
    return ranked.groupBy(by).agg(F.coalesce(F.max(F.when(refused, F.col("score"))), F.lit(float("-inf"))).alias("cut"))


def domain_adjusted_tpr(scored: DataFrame, target: float = 0.05, by: str = "detector", domain: str = "domain") -> DataFrame:
    """The rate of flagged AI texts at the threshold of all human texts, averaged over domains. A null domain is one."""
    cut = threshold_at_fpr(scored, target, by)
    per = scored.filter("label = 1").join(F.broadcast(cut), by).groupBy(by, domain).agg(F.avg((F.col("score") > F.col("cut")).cast("double")).alias("tpr"))
    return per.groupBy(by).agg(F.avg("tpr").alias("macro_tpr"), F.count("*").alias("n_domains"))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of a rate; (0, 1) with no rows."""
    p = F.try_divide(hits.cast("double"), n)
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    whole = 1 + z * z / n
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (middle - half) / whole)), F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (middle + half) / whole))


def subgroup_fpr(scored: DataFrame, threshold: float, group: str, by: str | None = "detector") -> DataFrame:
    """Human texts per group: count, flagged, rate and its interval. Null groups are one group, ``unknown``."""
    keys = [*([by] if by else []), F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("grp")]
    g = scored.filter("label = 0").groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("n_flagged"))
    low, high = wilson(F.col("n_flagged"), F.col("n"))
    return g.withColumns({"fpr": _or_zero(F.col("n_flagged").cast("double"), F.col("n")), "low": low, "high": high})


def max_subgroup_gap(groups: DataFrame, by: str = "detector") -> DataFrame:
    return groups.groupBy(by).agg(F.when(F.count("*") >= 2, F.max("fpr") - F.min("fpr")).otherwise(F.lit(0.0)).alias("gap"))


def fpr_resolution(scored: DataFrame, by: str = "detector") -> DataFrame:
    """The smallest rate that can be told from 0, and which budgets are measurable with it."""
    n = scored.groupBy(by).agg(F.count_if(F.col("label") == 0).alias("n_neg"))
    r = F.coalesce(F.try_divide(F.lit(1.0), F.col("n_neg")), F.lit(float("inf")))
    return n.withColumn("resolution", r).withColumns({"measurable_5": F.col("resolution") <= 0.05, "measurable_1": F.col("resolution") <= 0.01})


def evaluate(scored: DataFrame, threshold: float = 0.5, by: str = "detector") -> DataFrame:
    """All metrics of each detector, without the bootstrap intervals: one aggregate by bin, and one of the ranked scores."""
    flag, ai = F.col("score") >= threshold, F.col("label") == 1
    cell = F.least(F.greatest((F.col("score") * ECE_BINS).cast("int"), F.lit(0)), F.lit(ECE_BINS - 1))
    per = scored.groupBy(by, cell.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("label").alias("y"), F.sum((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("q"),
        F.count_if(flag & ai).alias("tp"), F.count_if(flag & ~ai).alias("fp"), F.count_if(~flag & ~ai).alias("tn"), F.count_if(~flag & ai).alias("fn"),
    )
    plain = per.groupBy(by).agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "tn", "fn")], (F.sum("q") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))
    plain = plain.withColumns({"precision": _or_zero(tp, tp + fp), "recall": _or_zero(tp, tp + fn), "accuracy": _or_zero(tp + tn, tp + fp + tn + fn), "fpr": _or_zero(fp, fp + tn), "n_neg": F.col("fp") + F.col("tn")})
    plain = plain.withColumn("f1", _or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    plain = plain.withColumn("resolution", F.coalesce(F.try_divide(F.lit(1.0), F.col("n_neg")), F.lit(float("inf"))))
    plain = plain.withColumns({"measurable_5": F.col("resolution") <= 0.05, "measurable_1": F.col("resolution") <= 0.01})
    ranked = _cumulated(scored, by).groupBy(by).agg(_auroc().alias("auroc"), _best(0.05).alias("b5"), _best(0.01).alias("b1"))
    ranked = ranked.select(by, "auroc", F.col("b5.tpr").alias("tpr_5"), F.col("b5.threshold").alias("threshold_5"), F.col("b1.tpr").alias("tpr_1"), F.col("b1.threshold").alias("threshold_1"))
    return plain.join(ranked, by, "left")


# --- bootstrap ---------------------------------------------------------------------------------------------


def _percentiles(stats: np.ndarray, alpha: float) -> tuple[float, float]:
    stats, n = np.sort(stats), len(stats)
    at = lambda k: float(stats[int(min(max(k, 0), n - 1))])
    return at(np.floor(alpha / 2 * n)), at(np.ceil((1 - alpha / 2) * n) - 1)


def bootstrap_ci(scored: DataFrame, n_boot: int = 1000, alpha: float = 0.05, seed: int = 1234, by: str = "detector", statistic: Callable[[np.ndarray, np.ndarray, np.ndarray], float] | None = None) -> DataFrame:
    """Percentile interval over resamples that keep both class sizes; null without both classes.

    A resample of a class is a multinomial draw over its distinct scores. It is made in two steps: how many rows fall
    into each bucket of scores, which every task draws alike from one seed, then how they fall within the bucket. So
    a bucket is resampled on its own, and what a detector's resamples of the AUROC need of it is three numbers each.
    Another ``statistic(pos, neg, scores)`` of counts per ascending distinct score sees all of a detector's scores, in
    one task: it's for detectors whose distinct scores fit into one."""
    if statistic is not None:

        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("score")
            pos, neg, name = part["n_pos"].to_numpy(), (part["n"] - part["n_pos"]).to_numpy(), part[by].iloc[0]
            if not pos.sum() or not neg.sum():
                return pd.DataFrame({by: [name], "low": [None], "high": [None]})
            rng, scores = np.random.default_rng([seed, *map(ord, str(name))]), part["score"].to_numpy()
            low, high = _percentiles(np.array([statistic(rng.multinomial(pos.sum(), pos / pos.sum()), rng.multinomial(neg.sum(), neg / neg.sum()), scores) for _ in range(n_boot)]), alpha)
            return pd.DataFrame({by: [name], "low": [low], "high": [high]})

        return score_counts(scored, by).groupBy(by).applyInPandas(run, f"{by} string, low double, high double")

    def resample(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("score")
        name, bucket, parts = str(part[by].iloc[0]), int(part["bucket"].iloc[0]), sorted(part["parts"].dropna().iloc[0], key=lambda p: p["bucket"])
        own = [p["bucket"] for p in parts].index(bucket)
        drawn = []
        for k, (counts, in_bucket) in enumerate((([p["n_pos"] for p in parts], part["n_pos"].to_numpy()), ([p["n"] - p["n_pos"] for p in parts], (part["n"] - part["n_pos"]).to_numpy()))):
            whole = np.array(counts, np.float64)
            rows = np.random.default_rng([seed, k, *map(ord, name)]).multinomial(int(whole.sum()), whole / whole.sum(), n_boot)[:, own] if whole.sum() else np.zeros(n_boot, np.int64)
            drawn.append((rows, in_bucket / max(1, in_bucket.sum()), np.random.default_rng([seed, k, bucket, *map(ord, name)])))
        inside, at_once = [], max(1, 4_000_000 // len(part))
        for at in range(0, n_boot, at_once):
            pos, neg = (rng.multinomial(rows[at : at + at_once], share) if share.any() else np.zeros((len(rows[at : at + at_once]), len(part)), np.int64) for rows, share, rng in drawn)
            inside.append((pos * (np.cumsum(neg, 1) - neg / 2)).sum(1))
        pos, neg = (rows.astype(float).tolist() for rows, _, _ in drawn)
        return pd.DataFrame({by: [part[by].iloc[0]], "bucket": [bucket], "pos": [pos], "neg": [neg], "inside": [np.concatenate(inside).tolist()]})

    def combine(part: pd.DataFrame) -> pd.DataFrame:
        """A detector's buckets: one row each, a bounded number."""
        part = part.sort_values("bucket")
        pos, neg, inside = (np.stack(part[k].to_list()) for k in ("pos", "neg", "inside"))
        whole = pos.sum(0) * neg.sum(0)
        if not whole.all():
            return pd.DataFrame({by: [part[by].iloc[0]], "low": [None], "high": [None]})
        low, high = _percentiles((inside + pos * (np.cumsum(neg, 0) - neg)).sum(0) / whole, alpha)
        return pd.DataFrame({by: [part[by].iloc[0]], "low": [low], "high": [high]})

    ranked = _cumulated(scored, by).select(by, "bucket", "score", "n", "n_pos", F.when(F.col("first"), F.col("parts")).alias("parts"))
    per = ranked.groupBy(by, "bucket").applyInPandas(resample, f"{by} string, bucket int, pos array<double>, neg array<double>, inside array<double>")
    return per.groupBy(by).applyInPandas(combine, f"{by} string, low double, high double")


def bootstrap_exact(labels: list[int], scores: list[float], statistic: Callable[[list[int], list[float]], float], n_boot: int = 1000, alpha: float = 0.05, seed: int = 1234) -> tuple[float, float]:
    """The interval of a small list by drawing rows one by one from a seeded generator, positives first: reproducible
    draw by draw, for reports on a few hundred texts."""
    groups = [[i for i, y in enumerate(labels) if y == c] for c in (1, 0)]
    if not all(groups):
        raise ValueError("bootstrap needs both classes present")
    rng, stats = random.Random(seed), []
    for _ in range(n_boot):
        drawn = [rng.choice(g) for g in groups for _ in g]
        stats.append(statistic([labels[i] for i in drawn], [scores[i] for i in drawn]))
    stats.sort()
    low, high = int(np.floor(alpha / 2 * n_boot)), int(np.ceil((1 - alpha / 2) * n_boot)) - 1
    return stats[min(max(low, 0), n_boot - 1)], stats[min(max(high, 0), n_boot - 1)]
