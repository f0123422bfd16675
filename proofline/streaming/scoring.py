"""Scoring on streams: the row-wise pipeline runs unchanged; calibrations join as a static side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import combine, detectors
from ..functions import text as T
from ..operators import conformal
from ..scratch import folder


def scored(texts: DataFrame, text: str = "text") -> DataFrame:
    """A batch or a stream of texts with the ensemble's ``score``."""
    kept = texts.columns
    both = detectors.scored(texts.filter(F.col(text).isNotNull()), text)
    return both.select(*kept, "n_words", combine.weighted_mean({n: F.col(f"{n}_score") for n in ("stylometry", "phrases")}).alias("score"))


def flagged(scored_stream: DataFrame, calibrations: DataFrame, language: str = "lang") -> DataFrame:
    """A scored stream with its calibrated threshold and flag; the calibration table is static."""
    return conformal.flagged(conformal.with_calibration(scored_stream, calibrations, language))


def flag_rate(flagged_stream: DataFrame, time: str = "collected_at", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Flagged share per language and window of event time; rows later than the watermark are left out."""
    return flagged_stream.withWatermark(time, late).groupBy(F.window(time, width), "lang").agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))


def score_stream_once(spark: SparkSession, path: str) -> DataFrame:
    """Reads a folder's (or one file's) documents as a stream, scores what is there, and returns the written result."""
    schema = spark.read.parquet(path).select("doc_id", "text", "lang").schema
    glob = path.rstrip("/") + "*"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(glob)
    out = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    run = scored(stream).drop("text").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
