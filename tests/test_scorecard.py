"""Scorecard figures worked out by hand, sketches of keys, samples and the incremental state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assaykit.operators import checks, metrics
from assaykit.operators.rules import RowRule
from assaykit.sources import relations
from assaykit.sources.current import CurrentRecords
from assaykit.sources.relations import Population


@pytest.fixture(scope="module")
def verdicts(spark):
    """Table a: 3 raised (1 pass, 2 breach), 1 shadow; table b: 1 breach, 1 error."""
    rows = [
        ("r1", "a", "x", "pass", "P1_block", 100, 0, 0.0), ("r2", "a", "y", "breach", "P1_block", 90, 30, 33.33), ("r3", "a", None, "breach", "P2_alert", 100, 30, 30.0),
        ("s1", "a", "z", "skipped", "P1_block", 100, 99, 99.0), ("r4", "b", "x", "breach", "P3_monitor", 10, 2, 20.0), ("e1", "b", "w", "error", "P1_block", None, None, None),
    ]
    return spark.createDataFrame([("run", *r) for r in rows], "run_id string, rule_id string, target_table string, target_column string, status string, severity string, rows_scanned long, violation_count long, violation_pct double")


def test_detection_summary(verdicts):
    got = metrics.detection_summary(verdicts).first().asDict()
    assert got == {"rules_raised": 4, "rules_breaching": 3, "rules_skipped": 2, "pass_rate_pct": 25.0, "violations": 62, "p1_breaching": 1, "worst_rate_pct": 99.0, "rules_run": 6, "rules_passing": 1, "tables": 2, "columns": 4, "rows_scanned": 110}


def test_quality_and_insights(verdicts):
    a, b = (r.asDict() for r in metrics.quality_by(verdicts, "target_table").orderBy("target_table").collect())
    assert a == {"target_table": "a", "rules_raised": 3, "rules_breaching": 2, "pass_rate_pct": 33.3, "violations": 60, "p1_breaching": 1, "worst_rate_pct": 99.0}
    assert (b["pass_rate_pct"], b["violations"], b["worst_rate_pct"]) == (0.0, 2, 20.0)
    a, b = (r.asDict() for r in metrics.table_insights(verdicts).orderBy("target_table").collect())
    assert (a["rows"], a["columns_checked"], a["columns_failing"], a["rules_skipped"], a["worst_rule"], a["worst_rate_pct"]) == (100, 3, 1, 1, "r2", 33.33)
    assert (b["rows"], b["columns_checked"], b["rules_raised"], b["worst_rule"]) == (10, 2, 1, "r4")


def test_records_affected_floor(spark, verdicts):
    keys = [("r2", "a", str(k)) for k in range(30)] + [("r3", "a", str(k)) for k in range(20)] + [("r4", "b", "1"), ("r4", "b", "1"), ("r1", "a", "77"), ("s1", "a", "78")]
    samples = spark.createDataFrame([("run", *k) for k in keys] + [("old", "r4", "b", "9")], "run_id string, rule_id string, target_table string, row_key string")
    assert metrics.records_affected_floor(verdicts, samples).first().asDict() == {"floor": 31, "checks": 3, "truncated": ["r3", "r4"], "exact": False}
    assert dict(map(tuple, metrics.records_by_table(verdicts, samples).collect())) == {"a": 30, "b": 1}
    clean = verdicts.where("status <> 'breach'")
    assert metrics.records_affected_floor(clean, samples).first().asDict() == {"floor": 0, "checks": 0, "truncated": [], "exact": True}
    assert metrics.records_affected_floor(verdicts, samples.limit(0)).first().asDict() == {"floor": 0, "checks": 0, "truncated": [], "exact": False}


def test_key_sketches(spark):
    """Exact up to 2**lg keys, within three standard errors beyond, and joined over rules whose rows overlap."""
    df = spark.range(50_000).withColumn("k", F.col("id") % 40_000).repartition(5)
    rules = [RowRule("small", "t", violates=F.col("k") < 500), RowRule("part", "t", violates=F.col("k") < 900), RowRule("large", "t", violates=F.col("k") % 2 == 0), RowRule("none", "t", violates=F.col("k") < 0)]
    made = checks.key_sketches(df, rules, ["k"], lg=10)
    got = {r.rule_id: r for r in metrics.records_affected(made, ["rule_id"], 10).collect()}
    assert (got["small"].records, got["small"].exact, got["part"].records, got["none"].records) == (500, True, 900, 0)
    assert not got["large"].exact and got["large"].low <= 20_000 <= got["large"].high
    both = metrics.records_affected(made.where("rule_id in ('small', 'part')").withColumn("t", F.lit("t")), ["t"], 10).first()
    assert (both.records, both.exact) == (900, True)


def test_keys_beyond_a_sketch_are_counted(spark):
    """16 keys fill a sketch of lg 4; groups of fewer, as many and more."""
    df = spark.range(3000).withColumn("k", F.col("id") % 1000).repartition(3)
    rules = [RowRule(f"below_{n}", "t", violates=F.col("k") < n) for n in (0, 15, 16, 17, 18, 900)]
    made, keys = checks.key_sketches(df, rules, ["k"], lg=4), checks.violating_keys(df, rules, ["k"])
    got = metrics.records_affected(made, ["rule_id"], 4, keys).collect()
    assert {(r.rule_id, r.records, r.exact, r.low, r.high) for r in got} == {(f"below_{n}", n, True, n, n) for n in (0, 15, 16, 17, 18, 900)}
    every = [x.withColumn("rule_id", F.lit("all")) for x in (made, keys)]
    assert [tuple(r) for r in metrics.records_affected(every[0], ["rule_id"], 4, every[1]).collect()] == [("all", 900, True, 900, 900)]
    assert all(not r.exact for r in metrics.records_affected(made, ["rule_id"], 4).where("records >= 16").collect())


def test_samples_leave_a_task_bounded(spark):
    df = spark.range(20_000).repartition(4).withColumn("text", F.repeat(F.lit("x"), 50))
    rules = [RowRule("all", "t", violates=F.col("id") >= 0), RowRule("few", "t", violates=F.col("id") % 5000 == 0)]
    made = checks.violation_samples(df, rules, ["id"], {"all": ["text"], "few": []}, cap=7)
    got = made.collect()
    assert sorted((r.rule_id, r.row_key) for r in got) == sorted([("all", k) for k in sorted(map(str, range(20_000)))[:7]] + [("few", str(k)) for k in (0, 5000, 10_000, 15_000)])
    assert all(("text" in r.sample_row) == (r.rule_id == "all") for r in got)
    plan = made._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange hashpartitioning(_rule"):]
    assert before.count("WindowGroupLimit") >= 2 and "to_json" not in before
    rows = int(str(made.rdd.getNumPartitions())) and sum(1 for _ in made.toLocalIterator())
    assert rows == 11


def test_outcomes_by_hand(spark):
    rows = [("P1_block", "closed_verified", 4.0, True, "x", 5), ("P1_block", "closed_rejected", None, False, "x", 1), ("P2_alert", "closed_verified", 20.0, False, "x", 2), ("P3_monitor", "reopened", None, False, "y", None), ("P3_monitor", "deferred", None, False, "y", 3)]
    state = spark.createDataFrame(rows, "severity string, lifecycle_state string, mttr_days double, is_recurrence boolean, business_domain string, total_violation_rows long")
    got = {r.severity: r for r in metrics.outcome_metrics(state).collect()}
    assert (got["P1_block"].closure_rate_pct, got["P1_block"].mttr_met, got["P1_block"].closure_met, got["P1_block"].recurrence_pct) == (50.0, True, False, 50.0)
    assert (got["P2_alert"].target_days, got["P2_alert"].mttr_met, got["P2_alert"].closure_met) == (15.0, False, True)
    assert got["P3_monitor"].target_days is None and got["P3_monitor"].mttr_met is None
    assert (got["all"].problems, got["all"].mttr_days, got["all"].mttr_met, got["all"].closure_rate_pct) == (5, 12.0, None, 40.0)
    x, y = metrics.breakdown(state, "business_domain").orderBy("business_domain").collect()
    assert tuple(x) == ("x", 3, 0, 2, 66.7, 12.0, 1, 8) and tuple(y) == ("y", 2, 1, 0, 0.0, None, 0, 3)


def test_funnel_and_coverage_by_hand(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [("c1", None, 0, None, None, "awaiting_review"), ("c2", "accepted", 1, ts, None, "awaiting_verification"), ("c3", "accepted", 2, ts, ts, "closed_verified"), ("c4", "rejected", 0, None, None, "closed_rejected")]
    state = spark.createDataFrame(rows, "cohort_id string, latest_decision string, distinct_approvers long, executed_ts timestamp, verified_ts timestamp, lifecycle_state string")
    assert [r.problems for r in metrics.triage_funnel(state).orderBy("step").collect()] == [4, 3, 2, 2, 1, 1]
    events = spark.createDataFrame([("c1", "recommended"), ("c2", "recommended"), ("c2", "approved"), ("c3", "executed"), ("c9", "reviewed")], "cohort_id string, event_type string")
    assert tuple(metrics.disposition_coverage(state, events).first()) == (4, 2, 50.0, False)


def test_incremental_state_equals_the_window(spark):
    """Batches in any order, late versions, ties of keys, rows without a key, and few buckets touched by a small batch."""
    population = Population(("k", "l"), ("v", "w"), "s", "D")
    rows = [(k % 23 if k % 19 else None, "a" if k % 3 else None, (k * 7) % 11 if k % 13 else None, k, "D" if k % 5 == 0 else "N") for k in range(400)]
    df = spark.createDataFrame(rows, "k int, l string, v int, w int, s string")
    state = CurrentRecords(spark, f"{relations.shared_folder(spark)}/current-test", population, buckets=8)
    with pytest.raises(ValueError):
        state.records()
    for part in ("w % 3 = 2", "w % 3 = 0", "w < 0", "w % 3 = 1 and w > 9", "w % 3 = 1 and w <= 9"):
        touched = state.apply(df.where(part))
        assert (part == "w < 0") == (not touched)
    assert sorted(state.records().select(*df.columns).collect(), key=str) == sorted(relations.current_records(df, population).collect(), key=str)
    places = state._places()
    (bucket,) = state.apply(spark.createDataFrame([(1, "a", 99, 1, "N")], df.schema))
    assert {b for b, n in state._places().items() if n != places[b]} == {bucket}
