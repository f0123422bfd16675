"""Problem 3: texts that look the same and are not the same string.

The consistent form is made in ``canon``. Here records are grouped by it. Copies of the same string are one class;
only pairs of different classes are joined and then expanded, so a string that a third of all rows hold costs nothing
unless it has look-alikes. Texts are compared by SHA-256 digests of the whole form and of the whole string.

Null texts belong to no group; empty texts are equal strings and form no pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .canon import forms


def look_alike_classes(records: DataFrame, text: str = "text", rec: str = "rec") -> DataFrame:
    """(rec, form, raw) of each record with a text: digests of its consistent form and of its string. Two records
    look alike if their forms are equal."""
    return forms(records, text, {"form": "sha256(visual)", "raw": "sha256(text)"}, [rec]).filter("form is not null").withColumnRenamed(rec, "rec")


def look_alike_pairs(records: DataFrame, text: str = "text", rec: str = "rec") -> DataFrame:
    """Pairs (rec_a, rec_b) that look alike and differ as strings, rec_a before rec_b by code point."""
    seen = written(look_alike_classes(records, text, rec), "forms")
    classes = seen.groupBy("form", "raw").agg(F.lit(1).alias("n"))
    several = classes.groupBy("form").agg(F.count("*").alias("n")).filter("n > 1").select("form")
    some = classes.join(several, "form").select("form", "raw")
    pairs = some.select("form", F.col("raw").alias("raw_a")).join(some.select("form", F.col("raw").alias("raw_b")), "form").filter("raw_a < raw_b")
    a = seen.select("form", F.col("raw").alias("raw_a"), F.col("rec").alias("a"))
    b = seen.select("form", F.col("raw").alias("raw_b"), F.col("rec").alias("b"))
    return pairs.join(a, ["form", "raw_a"]).join(b, ["form", "raw_b"]).select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b"))
