"""Paired scores: how many flagged originals escape after rewriting, and robustness under attacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evasion_report(pairs: DataFrame, threshold: float = 0.5, by: str | None = "detector", original: str = "score_original", rephrased: str = "score_rephrased") -> DataFrame:
    """Pairs, mean scores, mean drop, flagged originals, evaded, and the rate, which is null if nothing was flagged.
    Pairs with a null score are left out."""
    o, r = F.col(original), F.col(rephrased)
    used = pairs.filter(o.isNotNull() & r.isNotNull())
    figures = [
        F.count("*").alias("n_pairs"), F.avg(o).alias("mean_original"), F.avg(r).alias("mean_rephrased"), F.coalesce(F.avg(o - r), F.lit(0.0)).alias("mean_delta"),
        F.count_if(o >= threshold).alias("flagged"), F.count_if((o >= threshold) & (r < threshold)).alias("evaded"),
    ]
    out = used.groupBy(by).agg(*figures) if by else used.agg(*figures)
    return out.withColumn("evasion_rate", F.try_divide(F.col("evaded").cast("double"), F.col("flagged")))


def outcome(original: Column, rephrased: Column, threshold: float = 0.5) -> Column:
    """What happened to one pair. A rewrite that reaches the threshold counts as flagged whatever its original scored."""
    return F.when((original >= threshold) & (rephrased < threshold), "evaded").when(rephrased >= threshold, "still flagged").otherwise("never flagged")


def robustness_report(rows: DataFrame) -> DataFrame:
    """(attack, n, baseline, undefended, defended, drop, residual) from the columns baseline, undefended, defended."""
    r = rows.groupBy("attack").agg(F.count("*").alias("n"), *[F.avg(k).alias(k) for k in ("baseline", "undefended", "defended")])
    return r.withColumns({"drop": F.col("baseline") - F.col("undefended"), "residual": F.col("baseline") - F.col("defended")})
