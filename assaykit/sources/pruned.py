"""A4, A5: slices that read only the files that can hold their rows.

Beside a Parquet table stands a summary with a row for each file: how many rows and NULLs each column has there, its least and largest value, and which of ``BUCKETS`` hash buckets its values
fall in (a Bloom filter of one hash, which answers for values that are anywhere in the range). A slice is first put to the summary, and what it leaves is read. A
file that the summary does not know, or that has changed since, is always read, so a summary may lag behind its table and rows are never lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.sources.relations import Condition, _literal, slice_predicate, slice_rows

BUCKETS = 1024


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("short")


def summarise(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """file, size, changed, rows, and for each column a struct of nulls, lo, hi and buckets (no more than ``BUCKETS`` for a file). Aggregated map-side, a row per file."""
    df = spark.read.parquet(path)
    cell = lambda c: F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.collect_set(_bucket(F.col(c))).alias("buckets")).alias(c)
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"), *columns)
    return rows.groupBy("file", "size", "changed").agg(F.count("*").alias("rows"), *[cell(c) for c in columns])


def may_hold(df: DataFrame, summary: DataFrame, conditions: Sequence[Condition]) -> Column:
    """Whether a file of the summary can hold rows of df's slice; conditions on columns without a summary exclude nothing."""
    slice_predicate(df, conditions)  # refuses what a slice refuses
    out = F.lit(True)
    for c in conditions:
        if c.column not in summary.columns:
            continue
        s = F.col(c.column)
        filled = F.col("rows") > s["nulls"]
        values = [_literal(df, c.column, v) for v in c.values]
        one = filled
        if c.operator in ("=", "in"):
            hits = [(s["lo"] <= v) & (s["hi"] >= v) & F.array_contains(s["buckets"], _bucket(v)) for v in values]
            one = filled & F.greatest(*hits) if len(hits) > 1 else filled & hits[0]
        elif c.operator == "not_in" and len(values):
            alone = [(s["lo"] == v) & (s["hi"] == v) for v in values]
            one = filled & ~(F.greatest(*alone) if len(alone) > 1 else alone[0])
        out = out & F.coalesce(one, F.lit(False))
    return out


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """file, size and changed of the table's files; nothing is read of them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def _files(spark: SparkSession, path: str, summary: DataFrame, keep: Column) -> list[str]:
    """Files to read: those that may hold rows, new ones and changed ones. A name for each file comes to the driver, which lists the table's files anyway."""
    known = summary.withColumn("_keep", keep).select("file", "size", "changed", "_keep")
    rows = _listed(spark, path).join(known, ["file", "size", "changed"], "left").where(F.coalesce("_keep", F.lit(True)))
    return sorted(r.file for r in rows.select("file").collect())


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    whole = spark.read.parquet(path)
    return spark.read.schema(whole.schema).option("basePath", path).parquet(*files) if files else whole.where("false")


def slice_of_files(spark: SparkSession, path: str, summary: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """A4: the rows of the table's slice, from the files that may hold any."""
    df = spark.read.parquet(path)
    return slice_rows(_read(spark, path, _files(spark, path, summary, may_hold(df, summary, conditions))), conditions)


def membership_of_files(spark: SparkSession, path: str, summary: DataFrame, column: str, other: DataFrame, key: str, conditions: Sequence[Condition] = ()) -> DataFrame:
    """A5: rows whose ``column`` appears in ``other.key`` where the conditions hold, from the files whose values can meet the keys.

    Of the keys, their range and buckets alone (at most ``BUCKETS``) are put to the summary.
    """
    keys = slice_rows(other, conditions).select(F.col(key).alias("_key"))
    one = keys.agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"), F.collect_set(_bucket(F.col("_key"))).alias("_buckets"))
    s = F.col(column)
    keep = F.coalesce((s["lo"] <= F.col("_hi")) & (s["hi"] >= F.col("_lo")) & F.arrays_overlap(s["buckets"], F.col("_buckets")), F.lit(False))
    files = _files(spark, path, summary.crossJoin(F.broadcast(one)), keep)  # one row
    return _read(spark, path, files).join(keys, F.col(column) == F.col("_key"), "left_semi")
