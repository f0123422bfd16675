"""Problem 6: splits in which all rows of one author or assistant stay together.

Each distinct source string is read as evidence (``sources``): a surname with a given name or an initial, a title, an
assistant. Strings and pieces of evidence are the nodes of a graph whose connected components are the entities:

*  A string with a given name is linked with the name, and with its surname, initial and title together if no other
   given name has the same three.
*  A string with an initial is linked with the surname, initial and title if some full name has them, else with the one
   full name of that surname and initial, else, there being none or several, with the initial or its title.

The components' row counts are balanced by largest differencing: components are spread over shards of about
``SHARD_ROWS`` by hash, each shard makes ``BINS`` nearly equal bins, and ``FAN`` shards' bins at a time are combined by
differencing again until one set of bins is left; no step sees more than ``FAN * BINS`` bins. Whole bins go to the splits
by target share. A component larger than a bin fills one alone.

Nulls: rows whose source is null, empty, ``unknown`` or ``anonymous`` name nobody; they're no group and are spread by a
hash of their id. Targets are shares of all rows and need not sum to 1. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, written
from .components import components
from .differencing import difference
from .sources import read_source

BINS, SHARD_ROWS, FAN, FREE = 128, 20_000, 64, 4096


def evidence(strings: DataFrame) -> DataFrame:
    """(source, kind, sur, given, title) for each distinct non-null string of column ``source`` that names somebody. Of
    several readings the first is taken whose name another string has as its only reading, else the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, k, len(found), *r) for s in b.column(0).to_pylist() for found in [read_source(s)] for k, r in enumerate(found)]
            kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["source", "place", "n", "kind", "sur", "given", "title"])

    distinct = strings.select("source").filter("source is not null").distinct()
    read = written(distinct.mapInArrow(work, "source string, place int, n int, kind string, sur string, given string, title string"), "readings")
    sure = read.filter("n = 1").select("kind", "sur", "given").distinct().withColumn("known", F.lit(True))
    best = F.min(F.struct(F.col("known").isNull().alias("new"), "place", "kind", "sur", "given", "title")).alias("r")
    chosen = read.filter("n > 1").join(sure, ["kind", "sur", "given"], "left").groupBy("source").agg(best).select("source", "r.kind", "r.sur", "r.given", "r.title")
    return read.filter("n = 1").select(chosen.columns).unionAll(chosen)


def entities(strings: DataFrame) -> DataFrame:
    """(source, entity) for each distinct non-null string of column ``source`` that names somebody: the connected
    component of the string, called by its smallest piece of evidence."""
    read = written(evidence(strings).withColumn("initial", F.substring("given", 1, 1)), "sources")
    author = read.filter("kind = 'author'")
    full, short = author.filter("length(given) <> 1"), author.filter("length(given) = 1")
    known = full.groupBy("sur", "initial").agg(F.countDistinct("given").alias("n"), F.min("given").alias("one"))
    works = full.filter("title <> ''").groupBy("sur", "initial", "title").agg(F.countDistinct("given").alias("n_work"))
    key = lambda *parts: F.concat_ws("|", *parts)
    name = lambda given: key(F.lit("author"), F.col("sur"), given)
    work = key(F.lit("by title"), "sur", "initial", "title")
    meant = F.when(F.col("n_work") == 1, work).when(F.col("n") == 1, name(F.col("one"))).when(F.col("n") > 1, key(F.lit("by initial"), "sur", "initial", "title")).otherwise(name(F.col("initial")))
    links = (
        read.filter("kind = 'assistant'").select("source", key("kind", "sur").alias("key"))
        .unionAll(full.select("source", name(F.col("given"))))
        .unionAll(full.join(works.filter("n_work = 1"), ["sur", "initial", "title"]).select("source", work))
        .unionAll(short.join(known, ["sur", "initial"], "left").join(works, ["sur", "initial", "title"], "left").select("source", meant))
    )
    found = components(links.select(F.concat(F.lit("string|"), "source").alias("a"), F.col("key").alias("b")))
    out = found.filter("startswith(node, 'string|')").select(F.expr("substring(node, 8)").alias("source"), F.col("label").alias("entity"))
    return out


def same_entity_pairs(strings: DataFrame) -> DataFrame:
    """Pairs (source_a, source_b) of different strings that name the same author or assistant."""
    e = written(entities(strings), "entities")
    return e.toDF("source_a", "entity").join(e.toDF("source_b", "entity"), "entity").filter("source_a < source_b").select("source_a", "source_b")


def balanced_bins(weights: DataFrame, bins: int = BINS, shard_rows: int = SHARD_ROWS, fan: int = FAN) -> tuple[DataFrame, list[int]]:
    """(entity, bin) and the bins' totals, for (entity, n)."""
    shards = max(1, -(-weights.count() // shard_rows))

    def shared_out(df: DataFrame, columns: str, order: list[str]) -> DataFrame:
        def work(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(order, ascending=False, kind="stable")
            place, _ = difference(part["n"].tolist(), bins)
            return part.assign(slot=pd.array(place, dtype="int32"))

        return df.groupBy("shard").applyInPandas(work, columns)

    placed = written(shared_out(weights.withColumn("shard", F.pmod(F.xxhash64("entity"), F.lit(shards)).cast("int")), "entity string, n bigint, shard int, slot int", ["n", "entity"]), "bins")
    while shards > 1:  # bins of one shard may meet in one bin: what counts is that the totals come out equal
        sums = placed.groupBy(F.col("shard").alias("old"), F.col("slot").alias("old_slot")).agg(F.sum("n").alias("n"))
        merged = shared_out(sums.withColumn("shard", F.floor(F.col("old") / fan).cast("int")), "old int, old_slot int, n bigint, shard int, slot int", ["n", "old", "old_slot"]).drop("n")
        before = placed
        placed = written(placed.withColumnsRenamed({"shard": "old", "slot": "old_slot"}).join(merged, ["old", "old_slot"]).select("entity", "n", "shard", "slot"), "bins")
        drop(before)
        shards = -(-shards // fan)
    totals = [0] * bins
    for r in placed.groupBy("slot").agg(F.sum("n").alias("n")).collect():
        totals[r.slot] = r.n
    return placed.select("entity", F.col("slot").alias("bin")), totals


def bins_to_splits(totals: list[int], targets: list[tuple[str, float]]) -> list[str]:
    """The split of each bin: the largest bins first, each to the split that lacks most of its target."""
    whole, got, out = sum(totals), {s: 0 for s, _ in targets}, [""] * len(totals)
    for b in sorted(range(len(totals)), key=lambda b: (-totals[b], b)):
        name = max(targets, key=lambda t: (t[1] * whole - got[t[0]], t[1], t[0]))[0]
        out[b] = name
        got[name] += totals[b]
    return out


def split(rows: DataFrame, targets: list[tuple[str, float]], keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``source`` of ``rows``, the ``entity``, and the ``split``. The first column of ``keep``
    spreads rows that name nobody."""
    whom = entities(rows.select("source"))
    free = F.concat(F.lit("free|"), F.pmod(F.xxhash64(*[f"`{k}`" for k in keep]), F.lit(FREE)).cast("string"))
    held = written(rows.select(*keep, "source").join(whom, "source", "left").withColumn("entity", F.coalesce("entity", free)), "split")
    weights = held.groupBy("entity").agg(F.count("*").alias("n"))
    placed, totals = balanced_bins(weights)
    names = bins_to_splits(totals, targets)
    spark = rows.sparkSession
    by_bin = F.broadcast(spark.createDataFrame(list(enumerate(names)), "bin int, split string"))
    return held.join(placed, "entity").join(by_bin, "bin").select(*keep, "source", "entity", "split")


def split_report(parts: DataFrame, targets: DataFrame) -> DataFrame:
    """split_name, target_share, n_rows, share of each target split."""
    got = parts.groupBy(F.col("split").alias("split_name")).agg(F.count("*").alias("n_rows"))
    whole = got.agg(F.sum("n_rows").alias("whole"))
    return targets.select("split_name", "target_share").join(F.broadcast(got), "split_name", "left").crossJoin(F.broadcast(whole)).select("split_name", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.expr("try_divide(coalesce(n_rows, 0), whole)").alias("share"))
