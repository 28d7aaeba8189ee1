"""Headline timings: N row rules in one aggregate against a scan for each, shared joins, profiles and grouping.

Prints one JSON line. BENCH_SF_DIR is the input, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assaykit.operators import checks, grouping, profiling
from assaykit.operators.rules import JoinRule, RowRule
from assaykit.plans import core

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def line_rules(n: int) -> list[RowRule]:
    return [RowRule(f"r{i}", "lineitem", F.col("l_quantity") > i % 7, violates=F.col("l_extendedprice") * (1 - F.col("l_discount")) > 1000.0 * (i + 1)) for i in range(n)]


def join_rules(n: int) -> list[JoinRule]:
    return [JoinRule(f"j{i}", "lineitem", F.col("l_quantity") > i, join="lines", violates=F.col("l_extendedprice") > F.col("o_totalprice") / (i + 2)) for i in range(n)]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    t = core.Tables(spark, SF)
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    samples = t.lineitem.select(F.lit("lineitem").alias("target_table"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"), "l_orderkey", "l_linenumber", "l_partkey").where("l_partkey % (i + 2) = 0")
    samples = samples.select("target_table", F.format_string("rule_%02d", "i").alias("rule_id"), F.concat_ws("|", "l_orderkey", "l_linenumber").alias("row_key"), F.lit("kept").alias("outcome"))
    runs = {f"batched_{n}_rules": (lambda n=n: checks.row_level_batch(t.lineitem, line_rules(n)).collect()) for n in (1, 10, 50, 200)}
    runs["one_by_one_10_rules"] = lambda: checks.one_by_one(t.lineitem, line_rules(10)).collect()
    runs |= {f"shared_join_{n}_rules": (lambda n=n: checks.row_level_batch(lines, join_rules(n)).collect()) for n in (1, 5, 20)}
    runs["separate_joins_5_rules"] = lambda: [checks.row_level_batch(lines, [r]).collect() for r in join_rules(5)]
    runs["profile_text_columns"] = lambda: [profiling.profile_columns(d, c).collect() for d, c in ((t.documents, ["text", "lang", "source"]), (t.customer, ["c_name", "c_mktsegment"]), (t.part, ["p_name", "p_brand", "p_type"]))]
    runs["shared_rows_20_rules"] = lambda: grouping.shared_rows(samples, 0.0).collect()
    runs["current_records"] = lambda: core.QUERIES["a2_current_records"](spark, SF).count()
    runs["check_run_all_kinds"] = lambda: core.flagship(t).collect()
    spark.range(1).count()
    seconds = {}
    for name, work in runs.items():
        work()  # compiles and warms up
        began = time.time()
        work()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "batched check run, 10 rules", "value": seconds["batched_10_rules"], "unit": "sec", "queries": seconds, "sf": os.path.basename(SF)}))


if __name__ == "__main__":
    main()
