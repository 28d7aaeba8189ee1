"""Scorecard figures over verdicts, problems and their events. Ratios are NULL where nothing was counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.scalar import local_day
from assaykit.operators.registers import SYDNEY, raised, rule_elements, score
from assaykit.sources.relations import checkpointed, latest


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b)


def percent(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") * 100.0 / b)


def _is(state: str) -> Column:
    return F.col("status") == state


def on_run(check_run: DataFrame, run: DataFrame) -> DataFrame:
    """The verdicts of the one run in ``run``."""
    return check_run.join(F.broadcast(run.select("run_id")), "run_id", "left_semi")


def _figures() -> dict[str, Column]:
    """What J1, J3 and J5 share. Shadow and error verdicts neither passed nor failed: they count as skipped, not in rates."""
    raised, breach = F.col("status").isin("pass", "breach"), _is("breach")
    return {
        "rules_raised": F.count_if(raised), "rules_breaching": F.count_if(breach), "rules_skipped": F.count_if(~raised), "pass_rate_pct": percent(F.count_if(_is("pass")), F.count_if(raised)),
        "violations": F.coalesce(F.sum(F.when(breach, F.col("violation_count"))), F.lit(0)), "p1_breaching": F.count_if(breach & (F.col("severity") == "P1_block")),
        "worst_rate_pct": F.coalesce(F.max("violation_pct"), F.lit(0.0)),
    }


def detection_summary(verdicts: DataFrame) -> DataFrame:
    """Headline figures of one run's verdicts. Violations are pairs of rule and row; rows_scanned is the largest scan of each table."""
    tables = verdicts.groupBy("target_table").agg(F.max("rows_scanned").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_scanned"))
    rest = {"rules_run": F.count("*"), "rules_passing": F.count_if(_is("pass")), "tables": F.countDistinct("target_table"), "columns": F.countDistinct("target_column")}
    one = verdicts.agg(*[c.alias(n) for n, c in (_figures() | rest).items()])
    return one.crossJoin(tables)  # one row each


def _held_samples(verdicts: DataFrame, samples: DataFrame) -> DataFrame:
    return samples.join(verdicts.where(_is("breach")).select("run_id", "rule_id"), ["run_id", "rule_id"], "left_semi")


def records_by_table(verdicts: DataFrame, samples: DataFrame) -> DataFrame:
    """target_table, floor: distinct sampled records of the breaches of ``verdicts``, of one run."""
    return _held_samples(verdicts, samples).groupBy("target_table").agg(F.countDistinct("row_key").alias("floor"))


def records_affected_floor(verdicts: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: floor (the sum over tables), checks, truncated (breaches with fewer sampled keys than violations) and exact (none is).

    Without any sample the floor is 0 of 0 checks and not exact; without a breach it is exact.
    """
    sampled = _held_samples(verdicts, samples).groupBy("rule_id").agg(F.countDistinct("row_key").alias("_n"))
    each = verdicts.where(_is("breach")).join(sampled, "rule_id", "left")
    short = F.coalesce(F.col("_n"), F.lit(0)) < F.col("violation_count")
    checks = each.agg(F.count("*").alias("checks"), F.array_sort(F.collect_set(F.when(short, F.col("rule_id")))).alias("truncated"))
    floor = records_by_table(verdicts, samples).agg(F.coalesce(F.sum("floor"), F.lit(0)).alias("floor"))
    some = samples.select(F.lit(True).alias("x")).limit(1).agg((F.count("*") > 0).alias("_some"))
    out = floor.crossJoin(checks).crossJoin(some)  # one row each
    none = F.array().cast("array<string>")
    return out.select("floor", F.when(F.col("_some"), F.col("checks")).otherwise(0).cast("long").alias("checks"), F.when(F.col("_some"), F.col("truncated")).otherwise(none).alias("truncated"), (F.col("_some") & (F.size("truncated") == 0)).alias("exact"))


def records_affected(sketches: DataFrame, by: list[str], lg: int, keys: DataFrame | None = None) -> DataFrame:
    """``by``, records (distinct keys under all rules' sketches together), exact, low and high.

    sketches: ``by`` and key_sketch, from ``checks.key_sketches`` with this ``lg``; keys of different tables must not meet, so ``by`` has the table, or the sum over tables is taken after.
    From 2**lg keys on a sketch only estimates, never less than 2**lg; low and high are three standard errors away. With ``keys`` (``by`` and row_key, from ``checks.violating_keys``
    over the same rows) those groups, and no others, are counted by their distinct keys instead.
    """
    made = sketches.groupBy(*by).agg(F.theta_sketch_estimate(F.theta_union_agg("key_sketch", lg)).alias("records"))
    exact = F.col("records") < (1 << lg)
    if keys is not None:
        large = keys.join(made.where(~exact).select(*by), by, "left_semi").select(*by, "row_key").distinct()
        made = made.join(large.groupBy(*by).agg(F.count("*").alias("_exact")), by, "left").withColumn("records", F.coalesce("_exact", "records"))
        exact = exact | F.col("_exact").isNotNull()
    error = F.when(F.col("exact"), 0.0).otherwise(3.0 / (1 << lg) ** 0.5)
    return made.withColumn("exact", exact).select(*by, "records", "exact", F.floor(F.col("records") * (1 - error)).alias("low"), F.ceil(F.col("records") * (1 + error)).alias("high"))


def quality_by(verdicts: DataFrame, by: str) -> DataFrame:
    """One run's figures per table or domain. The pass rate is over rules, not rows."""
    made = verdicts.groupBy(by).agg(*[c.alias(n) for n, c in _figures().items()]).drop("rules_skipped")
    return made.withColumns({"pass_rate_pct": F.round(F.coalesce("pass_rate_pct", F.lit(0.0)), 1), "worst_rate_pct": F.round("worst_rate_pct", 2)})


def worst_rules(verdicts: DataFrame, n: int = 10) -> DataFrame:
    """A top-n report."""
    return verdicts.where(_is("breach")).orderBy(F.desc("violation_count"), "rule_id").limit(n).select("rule_id", "target_table", "severity", "violation_count", "violation_pct")


def table_insights(verdicts: DataFrame) -> DataFrame:
    """One run's figures per table: its rows, columns checked and failing, and its worst rule (of equals the first by id) with that one's rate."""
    rest = {"rows": F.coalesce(F.max("rows_scanned"), F.lit(0)), "columns_checked": F.countDistinct("target_column"), "columns_failing": F.countDistinct(F.when(_is("breach"), F.col("target_column")))}
    top = verdicts.where(_is("breach")).groupBy("target_table").agg(F.max("violation_count").alias("violation_count"))
    named = verdicts.where(_is("breach")).join(top, ["target_table", "violation_count"]).groupBy("target_table").agg(F.min(F.struct("rule_id", "violation_pct")).alias("_w"))
    made = verdicts.groupBy("target_table").agg(*[c.alias(n) for n, c in (_figures() | rest).items()]).drop("worst_rate_pct")
    return made.join(named, "target_table", "left").select("*", F.col("_w.rule_id").alias("worst_rule"), F.coalesce(F.col("_w.violation_pct"), F.lit(0.0)).alias("worst_rate_pct")).drop("_w")


def failing_since(check_run: DataFrame) -> DataFrame:
    """rule_id, failing_since: the first breach after the last verdict that was none; rules that do not fail now are not there."""
    ok = check_run.where(~_is("breach")).groupBy("rule_id").agg(F.max("run_ts").alias("ok_ts"))
    rows = check_run.where(_is("breach")).join(ok, "rule_id", "left").where(F.col("ok_ts").isNull() | (F.col("run_ts") > F.col("ok_ts")))
    return rows.groupBy("rule_id").agg(F.min("run_ts").alias("failing_since"))


def newly_failing(check_run: DataFrame, days: int = 14) -> DataFrame:
    """Rules that breach now and did not before: rule_id, turned_ts (the first breach after the last verdict that was none), failing_rows (of the
    latest verdict), clean_before. Rules that turned more than ``days`` before their table's newest run are known gaps, no events."""
    newest = F.struct("run_ts", "result_id")
    rules = check_run.groupBy("target_table", "rule_id").agg(
        F.max(F.when(~_is("breach"), F.col("run_ts"))).alias("clean_before"), F.max_by("status", newest).alias("_last"), F.max_by("violation_count", newest).alias("failing_rows"), F.max("run_ts").alias("_top")
    )
    top = rules.groupBy("target_table").agg(F.max("_top").alias("_newest"))
    live = rules.where("_last = 'breach' and clean_before is not null").join(top, "target_table")
    rows = check_run.where(_is("breach")).select("target_table", "rule_id", "run_ts").join(live, ["target_table", "rule_id"]).where("run_ts > clean_before")
    turned = rows.groupBy("rule_id", "failing_rows", "clean_before", "_newest").agg(F.min("run_ts").alias("turned_ts"))
    return turned.where(F.col("turned_ts") >= F.col("_newest") - F.make_dt_interval(F.lit(days))).select("rule_id", "turned_ts", "failing_rows", "clean_before")


def run_index(check_run: DataFrame) -> DataFrame:
    """J8."""
    counted = F.col("status").isin("pass", "breach")
    return check_run.groupBy("run_id").agg(
        F.max("run_ts").alias("run_ts"), F.count_if(counted).alias("checks"), F.count_if(_is("breach")).alias("failing"), F.count_if(_is("breach") & (F.col("severity") == "P1_block")).alias("p1_failing"),
        score(F.sum(F.when(counted, F.col("rows_scanned"))), F.sum(F.when(counted, F.col("violation_count")))).alias("score_pct"),
    )


def compression(live: DataFrame, breaching: DataFrame) -> DataFrame:
    """Breaching rules for each live problem. live: rule_id, cohort_id."""
    return breaching.agg(F.countDistinct("rule_id").alias("breaches")).crossJoin(live.agg(F.countDistinct("cohort_id").alias("problems"))).withColumn("compression", ratio(F.col("breaches"), F.col("problems")))


def disposition_coverage(cohorts: DataFrame, disposition: DataFrame) -> DataFrame:
    """The share of problems with any event but the job's own recommendation."""
    decided = cohorts.join(disposition.where("event_type <> 'recommended'").select("cohort_id"), "cohort_id", "left_semi").agg(F.count("*").alias("decided"))
    out = cohorts.agg(F.count("*").alias("problems")).crossJoin(decided).withColumn("coverage_pct", percent(F.col("decided"), F.col("problems")))
    return out.withColumn("met", F.col("coverage_pct") >= 90.0)


def recommendation_acceptance(state: DataFrame) -> DataFrame:
    """Of problems where the action taken is known, those where it was the advised one."""
    known = F.col("recommendation_followed").isNotNull()
    out = state.agg(F.count_if(known).alias("executed"), F.count_if(F.col("recommendation_followed")).alias("followed"), percent(F.count_if(F.col("recommendation_followed")), F.count_if(known)).alias("acceptance_pct"))
    return out.withColumn("met", F.col("acceptance_pct") >= 50.0)


#: Days in which a problem should be verified fixed; other severities have no target.
FIX_DAYS = {"P1_block": 5.0, "P2_alert": 15.0}
#: States in which somebody still has to act.
OPEN = ("awaiting_review", "awaiting_approval", "approved_awaiting_execution", "awaiting_verification", "reopened", "awaiting_triage")


def outcome_metrics(state: DataFrame) -> DataFrame:
    """By severity, and for all together (severity 'all'): problems, fixed, closure rate, mean days to repair, recurrence, and whether their targets are met. Only a verified close counts.

    Days have targets for P1 and P2 alone, and none for all together.
    """
    closed = F.col("lifecycle_state") == "closed_verified"
    days = F.lit(None).cast("double")
    for name, n in FIX_DAYS.items():
        days = F.when(F.col("severity") == name, n).otherwise(days)
    both = state.select(F.explode(F.array(F.col("severity"), F.lit("all"))).alias("severity"), "lifecycle_state", "mttr_days", "is_recurrence")
    out = both.groupBy("severity").agg(
        F.count("*").alias("problems"), F.count_if(closed).alias("closed_verified"), percent(F.count_if(closed), F.count("*")).alias("closure_rate_pct"), F.count("mttr_days").alias("fixed"), F.avg("mttr_days").alias("mttr_days"),
        F.count_if("is_recurrence").alias("recurrences"), percent(F.count_if("is_recurrence"), F.count("*")).alias("recurrence_pct"),
    )
    return out.withColumns({"target_days": days, "mttr_met": F.col("mttr_days") < days, "closure_met": F.col("closure_rate_pct") >= 75.0, "recurrence_met": F.col("recurrence_pct") < 10.0})


def breakdown(state: DataFrame, by: str) -> DataFrame:
    """The same by domain or severity, with what is open."""
    closed = F.col("lifecycle_state") == "closed_verified"
    return state.groupBy(by).agg(
        F.count("*").alias("problems"), F.count_if(F.col("lifecycle_state").isin(*OPEN)).alias("open"), F.count_if(closed).alias("closed_verified"), F.round(F.coalesce(percent(F.count_if(closed), F.count("*")), F.lit(0.0)), 1).alias("closure_rate_pct"),
        F.round(F.avg("mttr_days"), 2).alias("mttr_days"), F.count_if("is_recurrence").alias("recurrences"), F.coalesce(F.sum("total_violation_rows"), F.lit(0)).alias("violation_rows"),
    )


def triage_funnel(state: DataFrame) -> DataFrame:
    """How many problems came at least so far; one approver is enough to count as approved."""
    stages = [
        ("01 recommended", F.lit(True)), ("02 reviewed", F.col("latest_decision").isNotNull()), ("03 approved", F.col("distinct_approvers") > 0), ("04 executed (claimed)", F.col("executed_ts").isNotNull()),
        ("05 verification attempted", F.col("verified_ts").isNotNull()), ("closed verified", F.col("lifecycle_state") == "closed_verified"),
    ]
    wide = state.agg(*[F.count_if(c).alias(f"n_{i}") for i, (_, c) in enumerate(stages)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"n_{i}").alias("problems")) for i, (n, _) in enumerate(stages)])))


def retired_rules(registry: DataFrame) -> DataFrame:
    return latest(registry, ["rule_id"], "rule_version").where("status = 'retired'").select("rule_id")


def history_cohorts(cohorts: DataFrame, registry: DataFrame) -> DataFrame:
    """Problems all of whose rules are retired."""
    gone = retired_rules(registry).withColumn("_gone", F.lit(True))
    each = cohorts.select("cohort_id", F.explode("member_rule_ids").alias("rule_id")).join(gone, "rule_id", "left")
    return each.groupBy("cohort_id").agg(F.bool_and(F.col("_gone").isNotNull()).alias("all")).where("all").select("cohort_id")


def last_per_day(rows: DataFrame, by: str, tz: str = SYDNEY) -> DataFrame:
    """The last row of each local day per ``by``."""
    day = rows.withColumn("run_day", local_day(F.col("run_ts"), tz))
    order = Window.partitionBy(by, "run_day").orderBy(F.desc("run_ts"), F.desc("result_id"))
    return day.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def element_scores(verdicts: DataFrame, cov: DataFrame) -> DataFrame:
    """One run's score per element."""
    rows = raised(verdicts, "pass", "breach").join(rule_elements(cov), "rule_id")
    return rows.groupBy("cde_id").agg(F.sum("rows_scanned").alias("rows_evaluated"), F.sum("violation_count").alias("rows_failed"), score(F.sum("rows_scanned"), F.sum("violation_count")).alias("score_pct"))


def mode_of(df: DataFrame, by: str, column: str) -> DataFrame:
    """The most frequent value per ``by``; the smallest of those that tie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(by).orderBy(F.desc("_n"), column)
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(by, column)


def checks_passing(df: DataFrame, *by: str) -> DataFrame:
    """The share of raised checks that pass, in percent."""
    return df.where(F.col("status").isin("pass", "breach")).groupBy(*by).agg(F.max("run_ts").alias("run_ts"), percent(F.count_if(_is("pass")), F.count("*")).alias("score_pct"))


def table_overview(check_run: DataFrame, run: DataFrame, days: int = 30) -> DataFrame:
    """Per table of the run (one row, run_id) with a raised check: health, figures, the domain and owner that most raised checks carry (the smallest of those that tie), and its history: (run_ts, score)
    of each run within ``days`` before its newest raised one, oldest first, with the last change."""
    on = on_run(check_run, run)
    rows = on.where(F.col("status").isin("pass", "breach"))
    breach = _is("breach")
    made = rows.groupBy("target_table").agg(
        F.count("*").alias("checks"), F.count_if(_is("pass")).alias("passing"), F.count_if(breach).alias("breaching"), F.count_if(breach & (F.col("severity") == "P1_block")).alias("p1"),
        F.coalesce(F.sum(F.when(breach, F.col("violation_count"))), F.lit(0)).alias("findings"), F.max("rows_scanned").alias("rows"),
    )
    status = F.when(F.col("p1") > 0, "Critical").when(F.col("breaching") > 0, "Needs attention").otherwise("Healthy")
    made = made.withColumns({"status": status, "score_pct": percent(F.col("passing"), F.col("checks"))})
    for column in ("owner_group", "business_domain"):
        made = made.join(mode_of(rows, "target_table", column), "target_table", "left")
    made = made.join(on.groupBy("target_table").agg(F.max("run_ts").alias("last_run")), "target_table")
    each = checks_passing(check_run, "target_table", "run_id")
    newest = each.groupBy("target_table").agg(F.max("run_ts").alias("_newest"))
    # a point for each run in the window
    points = each.join(newest, "target_table").where(F.col("run_ts") >= F.col("_newest") - F.make_dt_interval(F.lit(days)))
    history = points.groupBy("target_table").agg(F.array_sort(F.collect_list(F.struct("run_ts", "score_pct"))).alias("history"))
    out = made.join(history, "target_table", "left")
    change = F.when(F.size("history") > 1, F.element_at("history", -1)["score_pct"] - F.try_element_at("history", F.lit(-2))["score_pct"])
    words = F.when(F.col("change").isNull(), "No prior run").when(F.abs("change") < 0.05, "No change").otherwise(F.concat(F.when(F.col("change") > 0, "↑ ").otherwise("↓ "), F.format_string("%.1f pts", F.abs("change"))))
    return out.withColumn("change", change).withColumn("change_words", words)


def failing_first(c: Column) -> Column:
    """Breach, error, pass, skipped."""
    return F.when(c == "breach", 0).when(c == "error", 1).when(c == "pass", 2).otherwise(3)


def table_rules(rules: DataFrame, verdicts: DataFrame, table: str) -> DataFrame:
    """A table's rules with their verdicts, failing ones first (sorted by place)."""
    rows = rules.where(F.col("target_table") == table).join(verdicts.select("rule_id", F.col("status").alias("verdict"), "violation_count"), "rule_id", "left")
    return rows.select("rule_id", "rule_type", "severity", "verdict", "violation_count", failing_first(F.col("verdict")).alias("place")).orderBy("place", "rule_id")


def proposal_counts(proposals: DataFrame, state: str = "review_state") -> DataFrame:
    """J20."""
    return proposals.groupBy(state).agg(F.count("*").alias("proposals"))


STATES = ("Failing", "Not run", "Shadow", "Passing")


def cross_table_checks(rules: DataFrame, check_run: DataFrame) -> DataFrame:
    """Active and shadow rules over more than one table, with what they compare, the tables they read, their latest measurement and their state."""
    last = check_run.where("status <> 'error'").groupBy("rule_id").agg(F.max_by(F.struct("rows_scanned", "violation_count", "violation_pct", "run_ts", "run_id"), F.struct("run_ts", "result_id")).alias("_k"), F.count("*").alias("runs"))
    live = rules.where(F.col("status").isin("active", "shadow") & (F.trim("join_sql") != "")).join(last, "rule_id", "left")
    short = lambda c: F.regexp_extract(c, r"([^.]+)$", 1)
    tables = F.regexp_extract_all(F.regexp_replace("join_sql", "'[^']*'", "''"), F.lit(r"(?i)\b(?:from|join)\s+([\w.]+)"), F.lit(1))
    others = F.array_except(F.array_distinct(tables), F.array("target_table"))
    limit = F.coalesce("fail_threshold_pct", F.lit(0.0))
    state = F.when(F.col("status") == "shadow", "Shadow").when(F.col("_k").isNull(), "Not run").when(F.col("_k.violation_pct") > limit, "Failing").otherwise("Passing")
    kind = F.when(F.col("rule_type") == "referential", "Missing record").when(F.contains("join_sql", F.lit("__present")), "Same total").otherwise("Same value")
    out = live.withColumns({"others": others, "state": state, "kind": kind})
    named = F.array_join(F.concat(F.array(short(F.col("target_table"))), F.transform("others", short)), " → ")
    key = F.array_join(F.concat(F.array("target_table"), F.array_sort("others")), "|")
    return out.select("rule_id", "kind", "target_table", "others", named.alias("relationship"), key.alias("relationship_key"), "severity", "status", "state", F.coalesce("runs", F.lit(0)).alias("runs"), F.col("_k.rows_scanned").alias("checked"),
                      F.col("_k.violation_count").alias("failing_rows"), (F.lit(100.0) - F.col("_k.violation_pct")).alias("rate_pct"), F.col("_k.run_ts").alias("run_ts"), F.col("_k.run_id").alias("run_id"))


def relationships(checks: DataFrame) -> DataFrame:
    """The relationships that the checks read, with their checks counted by state. checks: from ``cross_table_checks``."""
    counts = [F.count_if(F.col("state") == s).alias(s.lower().replace(" ", "_")) for s in STATES]
    return checks.groupBy("relationship_key").agg(F.min("relationship").alias("relationship"), F.count("*").alias("checks"), *counts, F.array_sort(F.collect_set("kind")).alias("kinds"))


def element_history(tolerance: DataFrame) -> DataFrame:
    """Exact order statistics of an element's failing share over its runs, how many runs were not within tolerance (disputed ones too), and the last ten shares, oldest first."""
    fail = F.lit(100.0) - F.col("score_pct")
    rows = tolerance.where("score_pct is not null").withColumn("fail_pct", fail)
    order = Window.partitionBy("cde_id").orderBy(F.desc("run_ts"), F.desc("run_id"))
    tail = rows.withColumn("_n", F.row_number().over(order)).where("_n <= 10").groupBy("cde_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run_ts", "run_id", "fail_pct"))), lambda x: F.round(x["fail_pct"], 3)).alias("last_10"))
    made = rows.groupBy("cde_id").agg(
        F.count("*").alias("runs_observed"), F.count_if(~F.col("within_tolerance")).alias("runs_outside"), F.bool_or("scope_disputed").alias("scope_disputed"), F.min("fail_pct").alias("fail_pct_min"), F.median("fail_pct").alias("fail_pct_median"),
        F.percentile("fail_pct", 0.9).alias("fail_pct_p90"), F.max("fail_pct").alias("fail_pct_max"), F.max_by("fail_pct", F.struct("run_ts", "run_id")).alias("latest_fail_pct"),
    )
    return made.join(tail, "cde_id")


def element_checks(rules: DataFrame, check_run: DataFrame, escalation: DataFrame) -> DataFrame:
    """Active rules with their verdict on the latest run that raised any, and whether their breach was held back there."""
    run = check_run.where(F.col("status").isin("pass", "breach")).agg(F.max_by("run_id", F.struct("run_ts", "run_id")).alias("run_id"))
    now = on_run(check_run, run).select("rule_id", F.col("status").alias("latest_status"), F.col("violation_pct").alias("latest_violation_pct"))
    held = on_run(escalation, run).groupBy("rule_id").agg(F.bool_or(~F.col("escalates")).alias("held"))
    out = rules.where("status = 'active'").select("cde_id", "rule_id", "rule_type", "severity").join(now, "rule_id", "left").join(held, "rule_id", "left")
    return out.withColumn("held", F.coalesce("held", F.lit(False)))


def order_statistics(df: DataFrame, by: str, value: str, shares: list[float], most: int = 10_000, k: int = 800) -> DataFrame:
    """By, n, quantiles (one for each share), exact: from all values where a group has at most ``most``, from a KLL sketch beyond.

    A sketch is a few KB for a group of any size and merges over tasks, so no group is held in one task; with k = 800 its ranks are within 0.4 % of the group's size.
    """
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), k)
    sizes = checkpointed(df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), sketch.alias("_s")))
    small = df.join(sizes.where(F.col("n") <= most).select(by), by, "left_semi").groupBy(by).agg(F.percentile(F.col(value).cast("double"), F.array(*map(F.lit, shares))).alias("_exact"))
    guess = F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(float(s))) for s in shares])
    return sizes.join(small, by, "left").select(by, "n", F.coalesce("_exact", guess).alias("quantiles"), F.col("_exact").isNotNull().alias("exact"))


def unresolved_members(cohort_results: DataFrame, check_run: DataFrame) -> DataFrame:
    """Members (cohort_id, result_id) that are no verdict."""
    return cohort_results.join(check_run.select("result_id"), "result_id", "left_anti")


def duplicate_versions(registry: DataFrame) -> DataFrame:
    return registry.groupBy("rule_id", "rule_version").agg(F.count("*").alias("n")).where("n > 1")


def last_counts(check_run: DataFrame, n: int = 8) -> DataFrame:
    """Each rule's last ``n`` violation counts, oldest first."""
    order = Window.partitionBy("rule_id").orderBy(F.desc("run_ts"), F.desc("result_id"))
    rows = check_run.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    cells = F.array_sort(F.collect_list(F.struct("run_ts", "result_id", "violation_count")))
    return rows.groupBy("rule_id").agg(F.transform(cells, lambda c: c["violation_count"]).alias("counts"))
