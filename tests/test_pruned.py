"""Slices from the files that can hold them."""

import pytest
from pyspark.sql import functions as F

from assaykit.sources import pruned, relations
from assaykit.sources.relations import Condition


@pytest.fixture(scope="module")
def table(spark):
    path = f"{relations.shared_folder(spark)}/pruned-test"
    rows = spark.range(4000).select("id", (F.col("id") * 2).alias("even"), F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") / 400).cast("int"))).alias("s"))
    rows.repartitionByRange(10, "id").write.parquet(path)
    return path, relations.checkpointed(pruned.summarise(spark, path, ["id", "even", "s"]))


SLICES = [[Condition("id", "=", (17,))], [Condition("id", "in", (3, 3999))], [Condition("even", "=", (17,))], [Condition("s", "=", ("s4",)), Condition("id", "not_null")], [Condition("s", "not_in", ("s1", "s2"))], [Condition("id", "=", (9000,))], [Condition("id", "=", (5,)), Condition("s", "not_null")]]


@pytest.mark.parametrize("conditions", SLICES, ids=str)
def test_rows_are_equal_and_files_fewer(spark, table, conditions):
    path, summary = table
    df = spark.read.parquet(path)
    got = pruned.slice_of_files(spark, path, summary, conditions)
    assert sorted(map(str, got.collect())) == sorted(map(str, relations.slice_rows(df, conditions).collect()))
    if conditions[0].operator in ("=", "in"):
        assert len(got.inputFiles()) <= 3 < len(df.inputFiles())


def test_new_and_changed_files_are_read(spark):
    path = f"{relations.shared_folder(spark)}/pruned-new"
    spark.range(10).write.parquet(path)
    summary = relations.checkpointed(pruned.summarise(spark, path, ["id"]))
    spark.range(500, 510).coalesce(1).write.mode("append").parquet(path)
    assert [r.id for r in pruned.slice_of_files(spark, path, summary, [Condition("id", "=", (505,))]).collect()] == [505]
    with pytest.raises(ValueError):
        pruned.slice_of_files(spark, path, summary, [Condition("nope", "=", (1,))])


def test_membership(spark, table):
    path, summary = table
    other = spark.createDataFrame([(5, "a"), (3990, "b"), (None, "a"), (70_000, "a")], "k long, g string")
    got = pruned.membership_of_files(spark, path, summary, "id", other, "k", [Condition("g", "=", ("a",))])
    assert [r.id for r in got.collect()] == [5]
    assert pruned.membership_of_files(spark, path, summary, "id", other.limit(0), "k").count() == 0
