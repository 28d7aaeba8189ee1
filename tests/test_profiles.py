"""Counts of columns against plain Python, on both sides of the sketch's size."""

import random

import pytest

from assaykit.operators import profiling
from assaykit.plans import core


def _plain(values):
    filled = [v for v in values if v is not None and v.strip(" ") != ""]
    blank = [v for v in values if v is not None and v.strip(" ") == ""]
    return (len(values), values.count(None), len(blank), len(filled), len(set(filled)), min(map(len, filled), default=None), max(map(len, filled), default=None))


@pytest.mark.parametrize("lg", [4, 6, 14])
def test_counts_equal_plain_python(spark, lg):
    """16 keys fill a sketch of lg 4 exactly: columns of 15, 16, 17 and many values are on its edge."""
    rng = random.Random(5)
    pick = lambda n: [None if rng.random() < 0.1 else "  " if rng.random() < 0.1 else f"{'é' * (i % 5)}v{i % n}" for i in range(3000)]
    columns = {"a": pick(1), "b": pick(15), "c": pick(16), "d": pick(17), "e": pick(63), "f": pick(64), "g": pick(65), "h": pick(2500), "nulls": [None] * 3000, "blanks": [""] * 3000}
    for name in "bcdefg":
        n = len(set(v for v in columns[name] if v and v.strip()))
        assert n >= 15
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns)).repartition(7)
    made = {r["column"]: tuple(r)[1:8] for r in profiling.profile_columns(df, list(columns), lg=lg).collect()}
    assert made == {c: _plain(v) for c, v in columns.items()}


@pytest.mark.parametrize("n", [15, 16, 17, 33, 1000])
def test_distinct_values_at_the_sketch_size(spark, n):
    df = spark.range(0, n * 3, 1, 5).selectExpr(f"id % {n} AS k", "id", "CAST(NULL AS STRING) AS none")
    made = {r["column"]: r for r in profiling.suggest_row_key(df, ["id"], lg=4).collect()}
    assert [made[c]["distinct_count"] for c in ("k", "id", "none")] == [n, 3 * n, 0]
    assert made["id"]["suggested"] and made["id"]["ratio"] == 1.0 and not made["k"]["suggested"]


def test_table_without_rows(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert {r["column"]: tuple(r)[1:8] for r in profiling.profile_columns(df, ["a", "b"]).collect()} == {c: (0, 0, 0, 0, 0, None, None) for c in "ab"}
    assert [(r["distinct_count"], r["ratio"]) for r in profiling.suggest_row_key(df).collect()] == [(0, None), (0, None)]


def test_no_cell_is_shuffled_below_the_sketch_size(spark):
    """Plans of both passes: a column of few values is not in the second."""
    df = spark.range(0, 500, 1, 3).selectExpr("CAST(id % 3 AS STRING) AS few", "CAST(id AS STRING) AS many")
    small, both = (profiling.profile_columns(df, c, lg=6)._jdf.queryExecution().optimizedPlan().toString() for c in (["few"], ["few", "many"]))
    assert "Range" not in small and "Join" not in small
    assert "many" in both and "AS few" not in both


def test_sizes_beyond_64_bits(spark):
    """Sums of keys times powers of ten, as those of nine million orders."""
    class T:
        orders = spark.range(40).selectExpr("4000000000000001 + id AS o_orderkey", "id AS o_custkey")

    sums = {k: sum(4_000_000_000_000_001 + i for i in range(k, 40, 10)) for k in range(10)}
    want = {k: None if k == 9 else round(4.0 + float(n * 10**k // 10) / 160e6, 1) for k, n in sums.items()}
    got = core.i12(T).collect()
    assert {r.k: r.seconds for r in got} == want
    assert {r.k: r.allowed for r in got} == {k: None if k == 9 else False for k in range(10)}
