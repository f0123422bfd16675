"""Problem 7: putting items of varying length into containers of a fixed capacity with little room left over.

The items are spread over shards by a hash of their id, each of about ``windows_per_shard`` windows, so that a shard's
size is bounded whatever the data; each shard is packed by multiway differencing. An item that exceeds the capacity is
cut into full pieces, which fill a window each, and a remainder that is packed like any other item.

Nulls: a null or non-positive size takes no room and is left out. Repeated ids are separate items only if
their rows differ in size; ids are meant to be unique. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .differencing import windows

WINDOWS_PER_SHARD = 128


def pack(items: DataFrame, capacity: int, id: str = "doc_id", size: str = "tokens", windows_per_shard: int = WINDOWS_PER_SHARD) -> DataFrame:  # noqa: A002
    """One row (id, piece, size, shard, slot) for each piece of each item; (shard, slot) is its window. Full pieces of
    cut items have windows of their own, with shard null and slot null."""
    sized = items.select(F.col(f"`{id}`").alias("id"), F.col(f"`{size}`").cast("bigint").alias("size")).filter("size > 0")
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // (capacity * windows_per_shard)))
    full = sized.filter(F.col("size") > capacity).select(
        "id", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int") - 1)).alias("piece"), F.lit(capacity).cast("bigint").alias("size"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("int").alias("slot")
    )
    rest = sized.select("id", F.floor((F.col("size") - 1) / capacity).cast("int").alias("piece"), ((F.col("size") - 1) % capacity + 1).alias("size"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "id"], ascending=False, kind="stable")
        place, _ = windows(part["size"].tolist(), capacity)
        return part.assign(slot=pd.array(place, dtype="int32"))

    packed = rest.groupBy("shard").applyInPandas(fill, f"id {sized.schema['id'].dataType.simpleString()}, piece int, size bigint, shard int, slot int")
    return packed.unionByName(full)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: windows used, the least possible number, tokens, and the share of room that is filled."""
    whole = packed.filter("shard is null").agg(F.count("*").alias("n"), F.sum("size").alias("t"))
    mixed = packed.filter("shard is not null").groupBy("shard", "slot").agg(F.sum("size").alias("t")).agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.max("t").alias("fullest"))
    both = whole.select("n", "t", F.lit(None).cast("bigint").alias("fullest")).unionByName(mixed).agg(F.sum("n").alias("windows"), F.sum("t").alias("tokens"), F.max("fullest").alias("fullest"))
    return both.select("windows", F.ceil(F.col("tokens") / capacity).alias("least"), "tokens", F.expr(f"try_divide(tokens, windows * {capacity})").alias("filled"), "fullest")
