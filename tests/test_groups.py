"""Groups, comparisons of tables, discovery and register operators on small frames worked out by hand or against a plain form."""

import random
import time

from pyspark.sql import functions as F

from assaykit.operators import consistency, grouping, metrics, profiling, registers
from assaykit.operators.consistency import Hop


def pairs(rows):
    return sorted(map(tuple, rows))


def test_extended_components_equal_those_from_scratch(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(55)]
    frame = lambda e: spark.createDataFrame(e, "a string, b string")
    labels = grouping.connected(frame(edges[:20]))
    for part in (edges[20:21], edges[21:40], edges[40:]):
        labels = grouping.extended(labels, frame(part))
    assert pairs(labels.collect()) == pairs(grouping.connected(frame(edges)).collect())


def test_groups_by_hand(spark):
    """r1 to r3 began together, r3 shares records with r4; r5 began alone, r6 never passed."""
    day = lambda d: f"2024-01-0{d} 10:00:00"
    rows = [("r1", day(1), 2, 5, "regression"), ("r2", day(1), 1, 5, "regression"), ("r3", day(1), 1, 5, "regression"), ("r4", day(2), 0, 9, "chronic"), ("r5", day(3), 3, 5, "regression"), ("r6", day(1), 0, 7, "chronic")]
    history = spark.createDataFrame(rows, "rule_id string, first_breach string, passes_before long, runs long, kind string").withColumn("first_breach", F.to_timestamp("first_breach"))
    samples = [("r3", str(k)) for k in range(4)] + [("r4", str(k)) for k in range(1, 7)] + [("r5", ""), ("r5", "|x"), ("r5", "a||b"), ("r6", "1"), ("r3", "1")]
    verdicts = spark.createDataFrame([("run", r, "t", "k" if r == "r6" else "v") for r, *_ in rows], "run_id string, rule_id string, target_table string, target_column string")
    held = spark.createDataFrame([("run", r, "t", k) for r, k in samples] + [("old", "r5", "t", "1")], "run_id string, rule_id string, target_table string, row_key string")
    keys = spark.createDataFrame([("t", 1, ["v"]), ("t", 2, ["k", "j"])], "target_table string, table_version int, row_key array<string>")
    usable = grouping.usable_samples(held, verdicts, keys)
    assert pairs(grouping.dropped_samples(usable).collect()) == [("blank key", 3, 3, 1), ("kept", 11, 10, 2), ("rule on the key column", 1, 1, 1)]
    shared = grouping.shared_rows(usable)
    assert pairs(shared.collect()) == [("r3", "r4", 3, 0.75)]
    got = {r.rule_id: r for r in grouping.form_groups(history, grouping.problem_edges(history, shared)).collect()}
    moved, rec = "co-movement: all 3 were clean and first breached on 2024-01-01", "shared rows: r3 and r4 fail on 3 of the same records (75% of the smaller sample)"
    assert {got[r].basis for r in ("r1", "r2", "r3", "r4")} == {f"{moved}; {rec}"} and {got[r].group_key for r in ("r1", "r4")} == {"r1"}
    assert got["r5"].basis == "not grouped - this check first breached on 2024-01-03 and no other check broke on that date"
    assert got["r6"].basis == "not grouped - this check stands alone. It has never passed in 7 runs" and got["r6"].group_key == "r6"
    alone = grouping.form_groups(history.where("rule_id < 'r4'"), grouping.problem_edges(history.where("rule_id < 'r4'"), shared.limit(0))).collect()
    assert {(r.group_key, r.basis) for r in alone} == {("2024-01-01", moved)}


def test_shared_rows_of_many_rules(spark):
    """More rules than a mask holds, against sets in Python; repeated samples count once, and equal keys of two tables are two records."""
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(2)}", f"r{rng.randrange(130):03d}", str(rng.randrange(40)), "kept") for _ in range(3000)] + [("t0", None, "1", "kept"), ("t0", "r000", "x", "blank key")]
    frame = spark.createDataFrame(rows, "target_table string, rule_id string, row_key string, outcome string")
    of = {}
    for t, r, k, o in rows:
        if o == "kept" and r:
            of.setdefault(r, set()).add((t, k))
    want = {(a, b, n, n / min(len(of[a]), len(of[b]))) for a in of for b in of if a < b and (n := len(of[a] & of[b])) and n / min(len(of[a]), len(of[b])) >= 0.5}
    assert {tuple(r) for r in grouping.shared_rows(frame).collect()} == want and want
    assert grouping.shared_rows(frame.where("false")).collect() == []


def test_events_and_playbooks_by_hand(spark):
    events = spark.createDataFrame([("c", 1, "recommended", None, None, None), ("c", 2, "reviewed", "accepted", None, " see above "), ("c", 3, "verified", None, False, ""), ("c", 4, "verified", "  ", True, None)], "cohort_id string, event_seq int, event_type string, decision string, verification_passed boolean, reason string")
    events = events.withColumns({"event_ts": F.lit("2024-02-03").cast("timestamp"), "actor_identity": F.lit("ann")})
    assert grouping.event_chain(events).first().chain == "recommended > reviewed (accepted) > verified FAILED > verified PASSED"
    assert [(r.event_seq, str(r.day), r.event, r.who, r.reason) for r in grouping.steward_notes(events).collect()] == [(2, "2024-02-03", "reviewed (accepted)", "ann", "see above")]
    rules = spark.createDataFrame([("a", "format"), ("b", "format"), ("c", "unique")], "rule_id string, rule_type string")
    books = spark.createDataFrame([("p1", "a", "format"), ("p2", None, "format"), ("p3", "  ", "unique")], "playbook_id string, rule_id string, rule_type string")
    assert pairs(grouping.playbook_candidates(rules, books).collect()) == [("a", "p1", "rule"), ("a", "p2", "type"), ("b", "p2", "type"), ("c", "p3", "type")]


def plain_diff(left, right):
    """Over rows (key, a, b) with unique keys."""
    l, r = {x[0]: x[1:] for x in left}, {x[0]: x[1:] for x in right}
    both = l.keys() & r.keys()
    return {"rows_left_only": len(l.keys() - r.keys()), "rows_right_only": len(r.keys() - l.keys()), "column_a": sum(l[k][0] != r[k][0] for k in both), "column_b": sum(l[k][1] != r[k][1] for k in both)}


def test_table_diff_joins_what_differs_alone(spark):
    rng = random.Random(8)
    left = [(k, rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for k in [*range(3000), None]]
    right = [(k, b if k in (5, 6) else a, "z" if k == 7 else b) if k != 5 else (k, 9, b) for k, a, b in left if k != 11 and k != 6] + [(6, None if left[6][1] else 1, left[6][2]), (9000, 1, "x")]
    schema = "k int, a int, b string"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {x.item: x.n for x in consistency.table_diff(l, r, ["k"]).collect()}
    assert got == plain_diff(left, right)
    some, other = consistency.differing(l, r, ["k"], ["a", "b"])
    assert some.count() < 60 and other.count() < 60
    same, again = consistency.differing(l, l.repartition(3), ["k"], ["a", "b"])
    assert same.count() == again.count() == 0


def test_digests_see_copies_and_moved_nulls(spark):
    schema = "k int, a string, b string"
    base = [(1, "x", None), (2, "p", "q")]
    l = spark.createDataFrame(base, schema)
    for other in ([(1, None, "x"), (2, "p", "q")], base + [base[1], base[1]], [*base, (3, None, None)], [(1, "x", ""), (2, "p", "q")]):
        a, b = consistency.differing(l, spark.createDataFrame(other, schema), ["k"], ["a", "b"])
        assert a.count() + b.count() > 0


def test_first_difference_of_long_values(spark):
    long = "ab" * 100_000
    rows = [(long + "x", long + "y"), ("same", "same"), ("abc", "abcd"), ("", "a"), (None, "a"), ("é€x", "é€y"), ("xbc", "abc")]
    began = time.time()
    got = consistency.mismatches(spark.createDataFrame(rows, "l string, r string"), F.col("l"), F.col("r")).collect()
    assert sorted((r.shared, r.left_rest if r.left_rest is None else r.left_rest[:3]) for r in got if r.left_value is not None) == [(0, ""), (0, "xbc"), (2, "é€x"), (3, ""), (200_000, "x")]
    assert time.time() - began < 20


def test_hops_and_their_least_match_rate(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, None)], "i int, x int")
    b = spark.createDataFrame([(1, 7), (2, 8), (2, 5), (None, 1)], "xb int, y int")
    c = spark.createDataFrame([(7,), (7,)], "yc int")
    tests = consistency.hop_tests(a, [Hop(b, (("x", "xb"),)), Hop(c, (("y", "yc"),))])
    assert [tuple(r) for r in tests.orderBy("hop").collect()] == [(0, 4, 2, 50.0, 1), (1, 3, 1, 100 / 3, 1)]
    assert tuple(consistency.hop_summary(tests).first()) == (33.3, 2)


def test_pending_and_discovery_by_hand(spark):
    cols = spark.createDataFrame([("t", c) for c in "abcdefg"], "target_table string, target_column string")
    bound = cols.where("target_column = 'a'")
    made = [("1", "b", "name"), ("2", "c", "name"), ("3", "d", "name"), ("4", "e", "uc_tag"), ("5", "f", "name"), ("6", "f", "name")]
    proposals = spark.createDataFrame([("t", c, i, m) for i, c, m in made], "target_table string, target_column string, proposal_id string, method string")
    reviews = spark.createDataFrame([("2", "rejected"), ("3", "rejected"), ("4", "rejected"), ("5", "rejected"), ("6", "approved")], "proposal_id string, decision string")
    tags = spark.createDataFrame([("t", c) for c in "defa"], "target_table string, target_column string")
    # b is open; c refused; d refused and tagged since; e refused by tag; f approved; g new
    assert [r.target_column for r in profiling.pending(cols, bound, proposals, reviews, tags).orderBy("target_column").collect()] == ["d", "g"]
    found = spark.createDataFrame([("a", "E1", None), ("b", "E1", None), ("c", "E1", None), ("d", None, "several patterns fit"), ("e", None, "near miss"), ("f", None, "several patterns fit"), ("g", None, None)], "column string, cde_id string, why string")
    truth = spark.createDataFrame([("a", "E1"), ("b", "E2"), ("d", "E1"), ("e", "E1"), ("g", "E3"), ("f", None)], "column string, cde_id string")
    assert dict(map(tuple, profiling.evaluate_discovery(found, truth).collect())) == {"correct": 1, "wrong element": 1, "spurious": 1, "undecided": 1, "missed": 2}


def test_slices_and_evidence_by_hand(spark):
    rows = [("t1", 1, "old", 1, None, None, None), ("t1", 2, "k > 1", 2, "proposed", "k > 2", "ann"), ("t2", 1, "z", 4, "approved", "z", "bob"), ("t3", 1, None, None, None, None, None)]
    monitored = spark.createDataFrame([(*r, "selected") for r in rows], "target_table string, table_version int, slice_filter string, slice_version int, slice_change string, slice_proposed_filter string, slice_proposed_by string, status string")
    assert pairs((r.target_table, r.slice_version or 0, r.slice_pending_by or "-") for r in registers.slice_state(monitored).collect()) == [("t1", 2, "ann"), ("t2", 4, "-"), ("t3", 0, "-")]
    got = {r.target_table: r for r in registers.carry_forward(monitored, "paused").collect()}
    assert (got["t1"].table_version, got["t1"].slice_filter, got["t1"].slice_change, got["t1"].slice_proposed_filter, got["t1"].status) == (3, "k > 1", None, "k > 2", "paused")
    assert (got["t2"].slice_version, got["t2"].slice_proposed_by) == (4, None)
    asked = spark.createDataFrame([("ann", "Bob", "approved", None), ("ann", "ANN", "approved", None), ("ann", "ann", "rejected", "no use"), ("ann", "bob", "rejected", " "), ("ann", "bob", "maybe", "x")], "p string, r string, d string, why string")
    fault = registers.slice_decision_fault(*[F.col(c) for c in ("p", "r", "d", "why")])
    assert [r.f for r in asked.select(fault.alias("f")).collect()] == [None, "second person needed", None, "no reason", "unknown decision"]
    rules = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 0.0), ("d", 5.0)], "rule_id string, fail_threshold_pct double")
    runs = spark.createDataFrame([("a", "r1", 1, 1, 10, 10.0), ("a", "r2", 2, 0, 10, 0.0), ("b", "r1", 1, 1, 10, 10.0), ("b", "r1", 2, 2, 10, 20.0), ("c", "r1", 1, 0, 10, 0.1)], "rule_id string, run_id string, run_ts int, violation_count long, rows_scanned long, violation_pct double").withColumn("result_id", F.col("run_ts").cast("string"))
    assert pairs((r.rule_id, r.runs_measured, str(r.would_breach)) for r in registers.shadow_evidence(rules, runs).collect()) == [("a", 2, "False"), ("b", 1, "True"), ("c", 1, "False"), ("d", 0, "None")]


def test_bounded_order_statistics(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 100, "small").otherwise("large").alias("g"), (F.col("id") * 7919 % 30_011).cast("double").alias("v")).repartition(4)
    got = {r.g: r for r in metrics.order_statistics(df, "g", "v", [0.1, 0.5, 0.9], most=1000).collect()}
    for g, row in got.items():
        values = sorted(r.v for r in df.where(F.col("g") == g).collect())
        assert (row.n, row.exact) == (len(values), g == "small")
        for share, value in zip((0.1, 0.5, 0.9), row.quantiles, strict=True):
            assert abs(sum(v <= value for v in values) / len(values) - share) <= (0.011 if row.exact else 0.008)
