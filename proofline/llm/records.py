"""The corpus tables as records named ``field:id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = {
    "human": ("demo_human", "doc_id", "text"),
    "ai": ("demo_ai", "doc_id", "text"),
    "orig": ("demo_evasion_pairs", "pair_id", "original"),
    "reph": ("demo_evasion_pairs", "pair_id", "rephrased"),
}


def _named(field: str, key: str) -> Column:
    return F.concat(F.lit(f"{field}:"), F.col(key).cast("string"))


def records(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    """(rec, text) of the given fields, of every row. Fields of one table are read in one scan."""
    out, done = None, set()
    for field in fields:
        if field in done:
            continue
        table, key, _ = _FIELDS[field]
        own = [f for f in fields if _FIELDS[f][:2] == (table, key)]
        done |= set(own)
        df = spark.read.parquet(f"{folder}/{table}.parquet")
        if len(own) == 1:
            part = df.select(_named(field, key).alias("rec"), F.col(_FIELDS[field][2]).alias("text"))
        else:
            both = F.array(*(F.struct(_named(f, key).alias("rec"), F.col(_FIELDS[f][2]).alias("text")) for f in own))
            part = df.select(F.inline(both))
        out = part if out is None else out.unionByName(part)
    return out


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of demo_human and demo_ai: doc_id, text."""
    return spark.read.parquet(f"{folder}/demo_human.parquet").select("doc_id", "text").unionByName(spark.read.parquet(f"{folder}/demo_ai.parquet").select("doc_id", "text"))
