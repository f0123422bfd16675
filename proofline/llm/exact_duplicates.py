"""Problem 4: records that are the same but for white space, case, punctuation or field order.

Canonical records are range-partitioned and externally sorted by (digest of the key, id); each partition is then scanned
once, comparing the full keys of adjacent rows. Only digests and ids are sampled for the ranges, so no text reaches the
driver. The id is part of the sort order, so a key held by a third of all rows is
spread over many partitions; runs cut by a partition's border are stitched from two rows per partition.

Nulls: rows whose text is null take part in no group. Empty texts, and texts without letters or digits, form one
group each like any other equal text. Ties: the smallest id is the representative.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .canon import forms


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, leading, first_id, id): ``leading`` marks the run a partition begins with. Then one border row with
    digests of the partition's first and last key (within a partition whole keys are compared)."""
    part = TaskContext.get().partitionId()
    last_key, first_key, first_id, leading = None, None, None, True
    digest = lambda key: hashlib.sha256(key.encode()).hexdigest()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column(0), batch.column(1).to_numpy()
        begins = np.empty(len(keys), bool)
        begins[0] = last_key is None or keys[0].as_py() != last_key
        begins[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        if first_key is None:
            first_key, first_id = keys[0].as_py(), int(ids[0])
        at = np.where(begins, np.arange(len(keys)), -1)
        at = np.maximum.accumulate(at)
        firsts = np.where(at >= 0, ids[at], first_id)
        later = np.cumsum(begins) > (1 if last_key is None else 0)
        lead = ~later & leading
        leading, last_key, first_id = bool(lead[-1]), keys[-1].as_py(), int(firsts[-1])
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(lead), pa.array(firsts), pa.array(ids), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=["part", "leading", "first_id", "id", "first_key", "last_key"])
    if first_key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([leading]), pa.array([first_id]), pa.nulls(1, pa.int64()), pa.array([digest(first_key)]), pa.array([digest(last_key)])], names=["part", "leading", "first_id", "id", "first_key", "last_key"])


def duplicate_groups(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """One row (first_id, id) for each row of ``df`` with a text: the smallest id of its group, and its own.
    The ids must be unique; other columns are not read."""
    spark = df.sparkSession
    keyed = written(forms(df, text, {"key": "key", "digest": "sha256(key)"}, [id]).toDF("id", "key", "digest").filter("key is not null").withColumn("id", F.col("id").cast("bigint")), "keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keyed.repartitionByRange(parts, "digest", "id").sortWithinPartitions("digest", "id").select("key", "id")
    runs = written(sorted_.mapInArrow(_scan, "part bigint, leading boolean, first_id bigint, id bigint, first_key string, last_key string"), "runs")
    # one border row per partition: their number is bounded by the partitions, whatever the data
    borders = runs.filter("id is null").orderBy("part").collect()
    carried, last_key, last_first = [], None, None
    for b in borders:
        # the last run of a partition began in an earlier one if it is also its leading run
        goes_on = last_key is not None and b.first_key == last_key
        if goes_on:
            carried.append((b.part, last_first))
        if not (b.leading and goes_on):
            last_first = b.first_id
        last_key = b.last_key
    runs = runs.filter("id is not null")
    if not carried:
        return runs.select("first_id", "id")
    fix = F.broadcast(spark.createDataFrame(carried, "part bigint, carried bigint"))
    return runs.join(fix, "part", "left").select(F.when(F.col("leading"), F.coalesce("carried", "first_id")).otherwise(F.col("first_id")).alias("first_id"), "id")


def representatives(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """One row (first_id, copies, text) for each distinct text of ``df``: the record with the smallest id stands for
    its copies, itself counted."""
    counted = duplicate_groups(df, text, id).groupBy("first_id").agg(F.count("*").alias("copies"))
    records = df.select(F.col(f"`{id}`").cast("bigint").alias("first_id"), F.col(f"`{text}`").alias("text"))
    return counted.join(records, "first_id").select("first_id", "copies", "text")
