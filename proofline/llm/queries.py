"""The queries of this subpackage, each over its whole tables with the operators' production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_duplicates, lookalikes, mixing, near_duplicates, packing, quality, readability, sampling, splitting, tokens
from .canon import canonical_text
from .records import corpus, records

P1 = {"width": 3, "threshold": 0.5, "inclusive": False}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(records(spark, folder, "ai", "orig", "reph"), **P1)


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(records(spark, folder, "ai", "orig", "reph"), **P1)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(corpus(spark, folder)).filter(~F.col("is_prose")).select("doc_id")


def p2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(corpus(spark, folder))


def p2_figures(spark: SparkSession, folder: str) -> DataFrame:
    """The figures the rules of running text are about, and the verdict."""
    shares = ("mean_word_length", "common_word_share", "alphabetic_word_share", "marks_per_word", "bullet_line_share")
    q = quality.quality(corpus(spark, folder))
    return q.select("doc_id", "n_chars", "n_words", "n_lines", F.col("n_stop_words"), *[F.round(k, 6).alias(k) for k in shares], "is_prose")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.look_alike_pairs(records(spark, folder, "human", "ai", "reph"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of equal-looking records each record is in, without pairs."""
    return lookalikes.look_alike_classes(records(spark, folder, "human", "ai", "reph"))


def p3_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_text(records(spark, folder, "human", "ai", "reph"), "text", "canonical", ["rec"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates.duplicate_groups(corpus(spark, folder)).filter("first_id <> id").withColumnRenamed("id", "doc_id")


def p4_representatives(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates.representatives(corpus(spark, folder))


def _sample_plans(spark: SparkSession, folder: str):
    """(table, frame, targets, fraction) of each table named in sample_targets; the target table is small and fixed."""
    rows = _table(spark, folder, "sample_targets").collect()
    for table in sorted({r.table_name for r in rows}):
        own = [r for r in rows if r.table_name == table]
        targets = [sampling.Target(r.field_name, r.category, r.target_share, r.min_rows) for r in own]
        yield table, _table(spark, folder, table), targets, own[0].sample_fraction


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(table, *r) for table, df, targets, fraction in _sample_plans(spark, folder) for r in sampling.plan(df, targets, fraction)[2]]
    return spark.createDataFrame(rows, f"table_name string, {sampling.REPORT}")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_report(spark, folder).filter("short").select("table_name", "field_name", "category")


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for table, df, targets, fraction in _sample_plans(spark, folder):
        part = sampling.draw(df.select("doc_id", "meta"), targets, fraction, "doc_id").select(F.lit(table).alias("table_name"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


def p5_floors(spark: SparkSession, folder: str) -> DataFrame:
    """Of each target category: rows at hand, and whether the sample has the minimum or all there are."""
    least = _table(spark, folder, "sample_targets").select("table_name", "field_name", "category", "min_rows")
    report = p5_report(spark, folder).join(least, ["table_name", "field_name", "category"])
    return report.select("table_name", "field_name", "category", "available", (F.col("drawn") >= F.least("available", "min_rows")).alias("floor_met"))


def _sourced(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "demo_human").select("doc_id", "source").unionByName(_table(spark, folder, "demo_ai").select("doc_id", "source"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.same_entity_pairs(_sourced(spark, folder))


def _split_targets(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    return [(r.split_name, r.target_share) for r in _table(spark, folder, "split_targets").orderBy("split_name").collect()]


def p6_split(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split(_sourced(spark, folder), _split_targets(spark, folder))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_report(p6_split(spark, folder), _table(spark, folder, "split_targets"))


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that were placed, and entities of named sources in more than one split (none)."""
    parts = p6_split(spark, folder)
    whole = parts.agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"))
    several = parts.groupBy("entity").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_torn"))
    return whole.crossJoin(F.broadcast(several))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    from ..scratch import written

    return written(tokens.with_tokens(_table(spark, folder, "documents"), "text", ["doc_id"]), "sizes")


def _packed(spark: SparkSession, folder: str):
    sizes = _sizes(spark, folder)
    for r in _table(spark, folder, "containers").orderBy("container").collect():
        yield r.container, r.capacity_tokens, packing.pack(sizes, r.capacity_tokens)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents the packing operator had to cut for window_4k: those with more than one piece."""
    sizes = _sizes(spark, folder)
    capacity = _table(spark, folder, "containers").filter("container = 'window_4k'").first().capacity_tokens
    return packing.pack(sizes, capacity).filter("piece > 0").select(F.col("id").alias("doc_id")).distinct()


def p7_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name, _, packed in _packed(spark, folder):
        part = packed.select(F.lit(name).alias("container"), F.col("id").alias("doc_id"), "piece", F.col("size").alias("tokens"), "shard", "slot")
        out = part if out is None else out.unionByName(part)
    return out


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Per container: documents placed, windows that are too full, documents in several pieces that would fit into one."""
    out = None
    for name, capacity, packed in _packed(spark, folder):
        full = packed.filter("shard is not null").groupBy("shard", "slot").agg(F.sum("size").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("n_too_full"))
        docs = packed.groupBy("id").agg(F.count("*").alias("pieces"), F.sum("size").alias("t")).agg(F.count("*").alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= capacity)).alias("n_cut"))
        part = docs.crossJoin(F.broadcast(full)).select(F.lit(name).alias("container"), "n_docs", "n_too_full", "n_cut")
        out = part if out is None else out.unionByName(part)
    return out


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name, capacity, packed in _packed(spark, folder):
        part = packing.fill_report(packed, capacity).withColumn("container", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _mix(spark: SparkSession, folder: str):
    targets = _table(spark, folder, "mix_targets")
    return mixing.mix(mixing.sized(_table(spark, folder, "documents"), targets), targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1].filter("short").select("source")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Per listed source: the most often any document may be used, and documents used more often (none)."""
    targets = _table(spark, folder, "mix_targets").select("source", F.col("max_repeats").cast("bigint").alias("max_repeats"))
    over = p8_mix(spark, folder).join(F.broadcast(targets), "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("n_over"), (F.count("*") - F.count_distinct("doc_id")).alias("n_repeated"))
    return targets.join(over, "source", "left").select("source", "max_repeats", F.coalesce("n_over", F.lit(0)).alias("n_over"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"))


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    return readability.document_levels(_table(spark, folder, "documents"), _table(spark, folder, "level_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_levels(spark, folder).filter("level = 4").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}
