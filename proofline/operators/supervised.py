"""The supervised detector: a logistic model over standardised features, its cross-validation, and the ensemble's fit."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values ------------------------------------------------------------------------------------------
L2, FLAT = 0.05, 1e-9
ENSEMBLE_ITERATIONS, ENSEMBLE_RATE, ENSEMBLE_L2 = 800, 0.5, 1e-2
MIN_RELIABLE_WORDS = 50
# -------------------------------------------------------------------------------------------------------------


def standardizer(rows: DataFrame, keys: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation per feature in one aggregate; a missing value counts as 0, a flat feature has 1."""
    values = {k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in keys}
    r = rows.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())], *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(values.values())]).first()
    out = {}
    for i, k in enumerate(keys):
        m, s = r[f"m{i}"], r[f"s{i}"]
        out[k] = (m or 0.0, s if s is not None and s > FLAT else 1.0)
    return out


@dataclass
class LogisticModel:
    """Weights over standardised features. ``score`` is a Column of built-in expressions."""

    keys: list[str]
    weights: list[float]
    bias: float
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)

    def score(self) -> Column:
        x = F.lit(self.bias)
        for k, w in zip(self.keys, self.weights):
            m, s = self.scale.get(k, (0.0, 1.0))
            x = x + F.lit(float(w)) * ((F.coalesce(F.col(k).cast("double"), F.lit(0.0)) - F.lit(float(m))) / F.lit(float(s)))
        return T.logistic(x)

    def top_features(self, k: int = 8) -> list[tuple[str, float]]:
        """The k largest weights by size, the first of equals first, rounded to 4 places."""
        return [(n, round(w, 4)) for n, w in sorted(zip(self.keys, self.weights), key=lambda p: -abs(p[1]))[:k]]

    def to_json(self) -> str:
        return json.dumps({"keys": self.keys, "weights": self.weights, "bias": self.bias, "scale": self.scale})

    @staticmethod
    def from_json(text: str) -> LogisticModel:
        d = json.loads(text)
        return LogisticModel(d["keys"], d["weights"], d["bias"], {k: tuple(v) for k, v in d["scale"].items()})


def fit(rows: DataFrame, keys: list[str], label: str = "label", l2: float = L2) -> LogisticModel:
    """Distributed fit of the regularised logistic model: mean log loss plus l2 / 2 of the squared weights, the bias
    free, on features standardised here. Rows with a null in all features (texts without words) are refused, as is a
    table with one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    keys = sorted(keys)
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes"), F.count_if(F.coalesce(*[F.col(k).cast("double") for k in keys]).isNull()).alias("empty")).first()
    if seen.classes < 2:
        raise ValueError("need both classes to train")
    if seen.empty:
        raise ValueError("every training text must be non-empty")
    scale = standardizer(rows, keys)
    columns = [((F.coalesce(F.col(k).cast("double"), F.lit(0.0)) - F.lit(scale[k][0])) / F.lit(scale[k][1])).alias(k) for k in keys]
    table = VectorAssembler(inputCols=keys, outputCol="features").transform(rows.select(F.col(label).cast("double").alias("label"), *columns)).select("label", "features")
    model = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(table)
    return LogisticModel(keys, [float(w) for w in model.coefficients], float(model.intercept), scale)


def reliable(n_words: Column) -> Column:
    return n_words >= MIN_RELIABLE_WORDS


def fit_ensemble(rows: DataFrame, names: list[str], label: str = "label") -> LogisticModel:
    """The ensemble's combiner by a fixed recipe of full gradient steps from zero, which stops before it converges.
    Distinct score rows are counted first; each step is one pass over that table in the driver if it is small (at most
    ``1_000_000`` distinct rows, which is checked), otherwise the gradient is an aggregate of Spark."""
    names = sorted(names)
    counts = rows.groupBy(*[F.col(f"{n}_score").alias(n) for n in names], F.col(label).cast("double").alias("y")).agg(F.count("*").alias("c"))
    n = counts.agg(F.count("*"), F.sum("c"), F.count_distinct("y")).first()
    if n[2] is None or n[2] < 2:
        raise ValueError("need both classes to calibrate")
    w, b, size = np.zeros(len(names)), 0.0, n[1]
    if n[0] <= 1_000_000:
        p = counts.toPandas()
        x, y, c = p[names].to_numpy(float), p["y"].to_numpy(float), p["c"].to_numpy(float)
        for _ in range(ENSEMBLE_ITERATIONS):
            err = (1 / (1 + np.exp(-(x @ w + b))) - y) * c / size
            w, b = w - ENSEMBLE_RATE * (ENSEMBLE_L2 * w + x.T @ err), b - ENSEMBLE_RATE * err.sum()
    else:
        counts = counts.persist()
        for _ in range(ENSEMBLE_ITERATIONS):
            z = sum((F.lit(float(wi)) * F.col(k) for wi, k in zip(w, names)), F.lit(float(b)))
            err = (T.logistic(z) - F.col("y")) * F.col("c") / size
            g = counts.agg(F.sum(err), *[F.sum(err * F.col(k)) for k in names]).first()
            w, b = w - ENSEMBLE_RATE * (ENSEMBLE_L2 * w + np.array(g[1:])), b - ENSEMBLE_RATE * g[0]
        counts.unpersist()
    return LogisticModel([f"{k}_score" for k in names], [float(v) for v in w], float(b))


def folds(ids_by_class: dict[int, list], n_folds: int = 5, seed: int = 0) -> dict:
    """Fold per id: one shared generator shuffles class 0, then class 1; each is dealt in turn."""
    n = sum(map(len, ids_by_class.values()))
    if n_folds < 2 or n_folds > n:
        raise ValueError(f"n_folds must be in [2, {n}]")
    rng, out = random.Random(seed), {}
    for c in (0, 1):
        order = list(ids_by_class.get(c, []))
        rng.shuffle(order)
        out |= {i: k % n_folds for k, i in enumerate(order)}
    return out


def cross_val_scores(rows: DataFrame, keys: list[str], key: str = "doc_id", label: str = "label", n_folds: int = 5, seed: int = 0, fold: Column | None = None) -> DataFrame:
    """(key, label, fold, score): each row scored by a model that never saw it; 0.5 where a fold's training rows lack a
    class. ``fold`` may give the folds; by default rows are dealt by a hash of the key within their class, which
    needs no order of all rows (``folds`` deals a small list exactly)."""
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col(key)), F.lit(n_folds)).cast("int") if fold is None else fold)
    out = None
    for k in range(n_folds):
        train, test = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        try:
            score = fit(train, keys, label).score()
        except ValueError:
            score = F.lit(0.5)
        part = test.select(key, label, "fold", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
