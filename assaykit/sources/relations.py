"""Relations that checks run on: named tables, current records of histories, slices, and appends to result tables."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Population:
    """How to find the current record in a history table."""

    record_key: tuple[str, ...]
    version_by: tuple[str, ...] = ()
    deleted_column: str | None = None
    deleted_value: object = None


def table_scan(spark: SparkSession, name: str, physical: dict[str, str] | None = None) -> DataFrame:
    """A registered name -> its physical name or path -> the table."""
    place = (physical or {}).get(name, name)
    return spark.read.parquet(place) if "/" in place else spark.table(place)


def current_records(df: DataFrame, population: Population | None) -> DataFrame:
    """The newest version of each record, then without deletions. Rows with a NULL key part all stay."""
    if population is None:
        return df
    out = df
    if population.version_by:
        order = Window.partitionBy(*population.record_key).orderBy(*[F.col(c).desc_nulls_last() for c in population.version_by])
        no_key = F.lit(False)
        for k in population.record_key:
            no_key = no_key | F.col(k).isNull()
        # rows without a key never meet in the window, so they are no hot group
        ranked = df.where(~no_key).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        out = ranked.unionByName(df.where(no_key))
    if population.deleted_column:
        out = out.where(~F.col(population.deleted_column).eqNullSafe(F.lit(population.deleted_value)))
    return out


def latest(df: DataFrame, keys: Sequence[str], version: str, *ties: str) -> DataFrame:
    """The row with the highest version per key."""
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc(), *[F.col(t) for t in ties])
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def population_in_force(register: DataFrame) -> DataFrame:
    return latest(register, ["target_table"], "population_version")


@dataclass(frozen=True)
class Condition:
    """One condition of a slice: operator =, in, not_in or not_null; or rows whose column appears in other.key where conditions hold."""

    column: str
    operator: str
    values: tuple = ()


def _literal(df: DataFrame, column: str, value: object) -> Column:
    kind = df.schema[column].dataType
    fits = {T.StringType: str, T.BooleanType: bool, T.IntegerType: int, T.LongType: int, T.ShortType: int, T.DoubleType: (int, float), T.FloatType: (int, float)}
    wanted = fits.get(type(kind))
    if wanted and (not isinstance(value, wanted) or (isinstance(value, bool) and wanted is not bool)):
        raise ValueError(f"{value!r} is no {kind.simpleString()} for {column}")
    return F.lit(value).cast(kind)


def slice_predicate(df: DataFrame, conditions: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        if c.column not in df.columns:
            raise ValueError(f"no column {c.column}")
        values = [_literal(df, c.column, v) for v in c.values]
        if c.operator == "not_null" and not values:
            one = F.col(c.column).isNotNull()
        elif c.operator == "=" and len(values) == 1:
            one = F.col(c.column) == values[0]
        elif c.operator in ("in", "not_in") and values:
            one = F.col(c.column).isin(*values)
            one = one if c.operator == "in" else ~one
        else:
            raise ValueError(f"condition {c}")
        out = out & one
    return out


def slice_rows(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    return df.where(slice_predicate(df, conditions))


def slice_membership(df: DataFrame, column: str, other: DataFrame, key: str, conditions: Sequence[Condition] = ()) -> DataFrame:
    """Rows whose ``column`` appears in ``other.key`` where the conditions hold."""
    keys = slice_rows(other, conditions).select(F.col(key).alias("_key"))
    return df.join(keys, F.col(column) == F.col("_key"), "left_semi")


def relation(df: DataFrame, population: Population | None = None, conditions: Sequence[Condition] = ()) -> DataFrame:
    """The slice on top of the current records, never below them."""
    return slice_rows(current_records(df, population), conditions)


def population_counts(df: DataFrame, population: Population | None = None, conditions: Sequence[Condition] = ()) -> DataFrame:
    """One row: table_rows >= population_rows >= slice_rows."""
    inside = slice_predicate(df, conditions)
    if population is None:
        return df.agg(F.count("*").alias("table_rows"), F.count("*").alias("population_rows"), F.count_if(inside).alias("slice_rows"))
    current = current_records(df, population).agg(F.count("*").alias("population_rows"), F.count_if(inside).alias("slice_rows"))
    return df.agg(F.count("*").alias("table_rows")).crossJoin(current)  # one row each


def slice_population(df: DataFrame, inside: Column) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(inside).alias("slice_rows"))


def select_tables(rules: DataFrame, monitored: DataFrame, named: Sequence[str] = ()) -> DataFrame:
    """Rules of the named tables, else of the tables selected now, else all."""
    if named:
        return rules.where(F.col("target_table").isin(*named))
    selected = latest(monitored, ["target_table"], "table_version").where("status = 'selected'")
    if selected.isEmpty():
        return rules
    return rules.join(selected.select("target_table"), "target_table", "left_semi")


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a target table, in its order and types; what df lacks is NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def append(df: DataFrame, path: str, schema: T.StructType) -> None:
    as_schema(df, schema).write.mode("append").parquet(path)


def new_rows(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of df for each key that the target does not hold; the least row by content where df repeats a key."""
    others = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")) if others else df.distinct()
    one = one.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    return one.join(target.select(*keys), list(keys), "left_anti")


def newer_rows(df: DataFrame, target: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Rows of df whose key the target does not hold with this sequence number or a later one; the least row by content where df repeats one."""
    top = target.groupBy(*keys).agg(F.max(sequence).alias("_top"))
    one = new_rows(df, target.where("false"), [*keys, sequence])
    return one.join(top, list(keys), "left").where(F.col("_top").isNull() | (F.col(sequence) > F.col("_top"))).drop("_top")


def guarded_append(df: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], sequence: str | None = None) -> DataFrame:
    """Appends rows that are not there yet, by key or by key and sequence number, and reads the table back; repeating the call changes nothing.
    A target that holds no table yet is empty."""
    spark = df.sparkSession
    try:
        target = spark.read.schema(schema).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        target = spark.createDataFrame([], schema)
    rows = as_schema(df, schema)
    append(newer_rows(rows, target, keys, sequence) if sequence else new_rows(rows, target, keys), path, schema)
    return spark.read.schema(schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a folder of its own in local mode, as in tests, and an error on a cluster."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sample_rows_frame(samples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """JSON sample rows as columns."""
    row = F.from_json("sample_row", "map<string,string>")
    return samples.withColumn("_row", row).select("sample_id", *[F.col("_row").getItem(c).alias(c) for c in columns])


def parse_slice(spec: str) -> list[Condition]:
    return [Condition(c["column"], c["operator"], tuple(c.get("values", ()))) for c in json.loads(spec)]


Transform = Callable[[DataFrame], DataFrame]
