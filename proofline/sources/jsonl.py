"""Line-based JSON sources, strict or fast, and the JSON form of calibrations.

Strict reading keeps line numbers, so that an error names ``path:line``. Files of any size are read in splits: lines are
numbered within their split, and the lines of a file's earlier splits, counted in one pass, are added. ``strict=False``
reads with Spark's own reader and a schema, and drops the reasons.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELED = "text string, label bigint, source string, meta string"
PAIRS = "original string, rephrased string, meta string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of all lines with something on them."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    raw = raw.withColumn("at", F.monotonically_increasing_id())
    # one row per split; rows of a split are consecutive
    splits = raw.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    lines = raw.join(splits, ["path", "start"]).select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("line"))
    return lines.filter("line <> ''")


def _text_of(value: Column, key: str) -> Column:
    """A member as text: strings as they are, other values as their JSON."""
    return F.try_variant_get(value, f"$.{key}", "string")


def _with_errors(lines: DataFrame, needed: list[str]) -> DataFrame:
    v = F.try_parse_json("line")
    df = lines.withColumn("v", v)
    has = {k: F.expr(f"try_variant_get(v, '$.{k}', 'variant')").isNotNull() for k in needed}
    missing = F.lit(False)
    for ok in has.values():
        missing = missing | ~ok
    names = " and ".join(f"'{k}'" for k in needed)
    return df.withColumn("error", F.when(F.col("v").isNull(), F.lit("invalid JSON")).when(missing, F.lit(f"record needs {names}")))


def check_labeled(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, text, label, source, meta, error) for each line; ``error`` is null where the line is right. A
    label must be a JSON integer that is 0 or 1; true, 0.7, 1.0 and "1" are none."""
    df = _with_errors(_lines(spark, path), ["text", "label"])
    value = F.expr("try_variant_get(v, '$.label', 'variant')")
    raw = F.to_json(value)
    whole = F.schema_of_variant(value) == "BIGINT"
    label = F.try_variant_get("v", "$.label", "bigint")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(~whole, F.concat(F.lit("label must be the integer 0 or 1, got "), raw)).when(~label.isin(0, 1), F.lit("label must be 0 or 1"))
    meta = F.try_variant_get("v", "$.meta", "string")
    return df.select(
        "path", "line_no", _text_of(F.col("v"), "text").alias("text"), F.when(whole, label).cast("int").alias("label"),
        F.coalesce(_text_of(F.col("v"), "source"), F.lit("unknown")).alias("source"), F.when(meta.isin("", "0", "false", "[]"), "{}").otherwise(F.coalesce(meta, F.lit("{}"))).alias("meta"), error.alias("error"),
    )


def check_pairs(spark: SparkSession, path: str) -> DataFrame:
    df = _with_errors(_lines(spark, path), ["original", "rephrased"])
    return df.select("path", "line_no", _text_of(F.col("v"), "original").alias("original"), _text_of(F.col("v"), "rephrased").alias("rephrased"), F.coalesce(F.try_variant_get("v", "$.meta", "string"), F.lit("{}")).alias("meta"), "error")


def _refuse(checked: DataFrame) -> DataFrame:
    bad = checked.filter("error is not null").orderBy("path", "line_no").first()
    if bad is not None:
        raise ValueError(f"{bad.path}:{bad.line_no}: {bad.error}")
    return checked.drop("error")


def load_labeled(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, line_no, text, label, source, meta). Strict reading raises ``path:line: reason`` for the first bad line."""
    if strict:
        return _refuse(check_labeled(spark, path))
    df = spark.read.schema(LABELED).json(path)
    return df.filter("text is not null and label in (0, 1)").select("text", F.col("label").cast("int").alias("label"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("meta", F.lit("{}")).alias("meta"))


def load_pairs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    if strict:
        return _refuse(check_pairs(spark, path))
    return spark.read.schema(PAIRS).json(path).filter("original is not null and rephrased is not null")


def load_text(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """One row (doc_id, text) per file of ``path``, or of the given text; exactly one of the two."""
    if (text is None) == (path is None):
        raise ValueError("give either a text or a path")
    if text is not None:
        return spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    return spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


# --- calibrations: a language's row as JSON, infinity as null -----------------------------------------------


def _finite(value: float | None) -> float | None:
    return None if value is None or math.isinf(value) else round(value, 6)


def calibrations_to_json(calibrations: DataFrame) -> dict[str, dict]:
    """The calibrations as a JSON object by language: a row per language, collected."""
    from ..operators.conformal import min_calibration_size

    out = {}
    for r in calibrations.collect():
        least = min_calibration_size(r.alpha)
        out[str(r.language)] = {
            "alpha": r.alpha, "language": r.language, "n_calibration": r.n_calibration, "certified": r.global_threshold is not None and not math.isinf(r.global_threshold),
            "shortfall": max(0, least - r.n_calibration), "min_calibration_size": least, "global_threshold": _finite(r.global_threshold), "bin_edges": list(r.bin_edges or []),
            "bin_thresholds": {str(k): _finite(v) for k, v in sorted((r.bin_thresholds or {}).items())}, "bin_counts": {str(k): v for k, v in sorted((r.bin_counts or {}).items())},
        }
    return out


def save_calibrations(calibrations: DataFrame, path: str, merge: bool = True) -> None:
    """Writes the JSON file; with ``merge`` the languages of an existing file that are not replaced stay."""
    file = Path(path)
    old = json.loads(file.read_text(encoding="utf-8")) if merge and file.exists() else {}
    file.write_text(json.dumps(old | calibrations_to_json(calibrations), indent=2, allow_nan=False), encoding="utf-8")


CALIBRATION = "language string, alpha double, n_calibration bigint, global_threshold double, bin_edges array<int>, bin_thresholds map<int,double>, bin_counts map<int,bigint>"


def load_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """One row per language; a null threshold is infinity."""
    inf = lambda v: math.inf if v is None else float(v)
    rows = [
        (name, float(d["alpha"]), int(d.get("n_calibration", 0)), inf(d.get("global_threshold")), [int(e) for e in d.get("bin_edges", [])], {int(k): inf(v) for k, v in d.get("bin_thresholds", {}).items()}, {int(k): int(v) for k, v in d.get("bin_counts", {}).items()})
        for name, d in json.loads(Path(path).read_text(encoding="utf-8")).items()
    ]
    return spark.createDataFrame(rows, CALIBRATION)


def save_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row; non-finite numbers are written as null."""
    clean = df.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
    clean.write.mode("overwrite").json(path)
