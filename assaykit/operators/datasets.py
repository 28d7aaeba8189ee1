"""Reporting datasets, one query each, over the registers and their folds (``Model``)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.scalar import local_day
from assaykit.operators import grouping, metrics
from assaykit.operators import registers as reg
from assaykit.operators.registers import SYDNEY, score

#: Rule type -> dimension.
DIMENSIONS = {"not_null": "Completeness", "format": "Validity", "sentinel": "Validity", "variance": "Validity", "consistency": "Consistency", "referential": "Consistency", "uniqueness": "Uniqueness"}


def dimension(c: Column) -> Column:
    out = F.lit("Other")
    for kind, name in DIMENSIONS.items():
        out = F.when(c == kind, name).otherwise(out)
    return out


def flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


class Model:
    """The registers (by name) and what is folded from them, each made once."""

    def __init__(self, tables, tz: str = SYDNEY) -> None:
        self.tables, self.tz = tables, tz

    @cached_property
    def runs(self) -> DataFrame:
        return self.tables["check_run"]

    @cached_property
    def rules(self) -> DataFrame:
        return reg.current(self.tables["rule_registry"], "rule_id", "rule_version")

    @cached_property
    def elements(self) -> DataFrame:
        return reg.current(self.tables["cde_registry"], "cde_id", "cde_version")

    @cached_property
    def coverage(self) -> DataFrame:
        return reg.coverage(self.elements, self.rules, self.runs, self.tables["profile"])

    @cached_property
    def scheduled(self) -> DataFrame:
        return reg.scheduled_run(self.runs, self.tz)

    @cached_property
    def weekly(self) -> DataFrame:
        return reg.weekly_run(self.scheduled)

    @cached_property
    def latest(self) -> DataFrame:
        """The verdicts of the latest scheduled run."""
        return metrics.on_run(self.runs, self.scheduled.where("is_latest"))

    @cached_property
    def tolerance(self) -> DataFrame:
        return reg.element_tolerance(self.runs, self.coverage, self.elements)

    @cached_property
    def state(self) -> DataFrame:
        return reg.cohort_current(self.tables["cohorts"], self.tables["disposition"])

    @cached_property
    def escalation(self) -> DataFrame:
        return reg.check_escalation(self.runs, self.coverage, self.tolerance)

    def named(self) -> DataFrame:
        return self.elements.select("cde_id", "cde_name", F.col("business_domain").alias("element_domain"))


def quality_trend(m: Model) -> DataFrame:
    attached = reg.rule_elements(m.coverage).select("rule_id").distinct()
    scored = reg.raised(m.runs, "pass", "breach").join(attached, "rule_id", "left_semi").groupBy("run_id").agg(F.sum("rows_scanned").alias("rows_checked"), F.sum("violation_count").alias("rows_failed"))
    out = m.weekly.join(scored, "run_id").withColumn("score_pct", score(F.col("rows_checked"), F.col("rows_failed")))
    return out.withColumn("change_pts", F.col("score_pct") - F.lag("score_pct").over(Window.orderBy("run_ts"))).select("run_id", "run_ts", "run_day", "run_week", "is_latest", "rows_checked", "rows_failed", "score_pct", "change_pts")  # a row per week


def _ran(m: Model) -> DataFrame:
    rows = m.runs.where(F.col("status").isin("pass", "breach")).join(reg.rule_elements(m.coverage), "rule_id")
    return rows.groupBy("run_id", "cde_id").agg(F.countDistinct("rule_id").alias("rules_ran"), F.countDistinct(F.when(F.col("status") == "breach", F.col("rule_id"))).alias("rules_breaching"))


def element_scores(m: Model) -> DataFrame:
    table = m.coverage.groupBy("cde_id").agg(F.max("target_table").alias("target_table"))
    out = m.tolerance.join(m.weekly.select("run_id", "run_day", "run_week", "is_latest"), "run_id").join(m.elements.select("cde_id", "business_domain"), "cde_id").join(table, "cde_id", "left").join(_ran(m), ["run_id", "cde_id"], "left").fillna(0, ["rules_ran", "rules_breaching"])
    change = F.col("score_pct") - F.lag("score_pct").over(Window.partitionBy("cde_id").orderBy("run_ts"))
    status = F.when(F.col("scope_disputed"), "Scope disputed").when(F.col("rules_breaching") > 0, "Failing").otherwise("Passing")
    out = out.withColumns({"change_pts": change, "status": status, "is_failing": flag((F.col("rules_breaching") > 0) & ~F.col("scope_disputed"))})
    return out.select("run_id", "run_ts", "run_day", "run_week", "is_latest", "cde_id", "cde_name", "criticality", "business_domain", "target_table", "rows_evaluated", "rows_failed", "score_pct", "rules_ran", "rules_breaching", "scope_disputed", "change_pts", "status", "is_failing")


def coverage(m: Model) -> DataFrame:
    label = F.lit(None).cast("string")
    for gap, text in {"covered": "Covered", "unvalidated": "Not validated", "no_rule": "No active rule", "scope_mismatch": "Scope disputed"}.items():
        label = F.when(F.col("coverage_gap") == gap, text).otherwise(label)
    return m.coverage.select("cde_id", "cde_name", "criticality", "business_domain", "target_table", "target_column", "coverage_gap", label.alias("coverage"), "rule_count", "breaching_rule_count")


def check_latest(m: Model) -> DataFrame:
    since = metrics.failing_since(m.runs.join(m.scheduled.select("run_id"), "run_id", "left_semi"))
    k = m.latest.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy("result_id"))).where("_n = 1")
    k = k.select("run_id", "run_ts", "rule_id", "target_table", "severity", F.col("status").alias("verdict"), "rows_scanned", "violation_count", "violation_pct", "threshold_pct")
    r = m.rules.select("rule_id", "rule_name", "cde_id", "rule_type", F.col("status").alias("rule_status"))
    out = k.join(r, "rule_id").join(m.named(), "cde_id", "left").join(since, "rule_id", "left")
    v, day = F.col("verdict"), lambda c: local_day(F.col(c), m.tz)
    health = F.when(v == "breach", "Breach").when((v == "skipped") & (F.col("rule_status") == "shadow"), "Shadow").when(v == "skipped", "Skipped").when(v == "error", "Error").otherwise("Pass")
    return out.withColumns({
        "run_day": day("run_ts"), "dimension": dimension(F.col("rule_type")), "sev": F.substring("severity", 1, 2), "health": health, "pass_rate_pct": 100 - F.col("violation_pct"),
        "days_failing": F.datediff(day("run_ts"), day("failing_since")) + 1, "is_breach": flag(v == "breach"), "is_p1_breach": flag((v == "breach") & (F.col("severity") == "P1_block")),
        "is_active": flag(F.col("rule_status") == "active"), "is_scored": flag((F.col("rule_status") == "active") & v.isin("pass", "breach")),
    })


def exec_weekly(m: Model) -> DataFrame:
    runs = m.weekly.withColumn("prev_run_id", F.lag("run_id").over(Window.orderBy("run_ts")))  # a row per week
    mine = m.rules.join(m.elements.select("cde_id"), "cde_id", "left_semi").select("rule_id", "cde_id")
    k = m.runs.join(mine, "rule_id")
    breach, counted = F.col("status") == "breach", F.col("status").isin("pass", "breach")
    distinct = lambda when, c: F.countDistinct(F.when(when, F.col(c)))
    checks = k.groupBy("run_id").agg(distinct(breach, "rule_id").alias("breaching"), distinct(breach & (F.col("severity") == "P1_block"), "rule_id").alias("p1_failing"), distinct(counted, "rule_id").alias("active_checks"), distinct(counted, "target_table").alias("tables_monitored"), distinct(counted, "cde_id").alias("cdes_monitored"), distinct(breach, "cde_id").alias("cdes_failing"))
    failed = k.where(breach).select("run_id", "rule_id")
    before = m.runs.where(breach).select(F.col("run_id").alias("prev_run_id"), "rule_id")
    new = runs.where("prev_run_id is not null").select("run_id", "prev_run_id").join(failed, "run_id").join(before, ["prev_run_id", "rule_id"], "left_anti").groupBy("run_id").agg(F.countDistinct("rule_id").alias("new_failures"))
    registered = m.elements.agg(F.count("*").alias("cdes_registered"))
    zero = ["cdes_monitored", "tables_monitored", "active_checks", "cdes_failing", "breaching", "p1_failing", "new_failures"]
    out = runs.join(checks, "run_id", "left").join(new, "run_id", "left").fillna(0, zero).crossJoin(registered)  # one row
    return out.select("run_day", "run_week", "run_ts", "is_latest", "cdes_registered", *zero, (F.col("cdes_registered") - F.col("cdes_monitored")).alias("cdes_not_monitored"))


def domain_scores(m: Model) -> DataFrame:
    rows = m.tolerance.join(m.elements.select("cde_id", "business_domain"), "cde_id").join(_ran(m), ["run_id", "cde_id"], "left").fillna(0, ["rules_ran", "rules_breaching"])
    rows = rows.drop("run_ts").join(m.weekly.select("run_id", "run_day", "run_week", "run_ts", "is_latest"), "run_id")
    return rows.groupBy("run_day", "run_week", "run_ts", "is_latest", "business_domain").agg(F.count("*").alias("cdes_monitored"), F.count_if(F.col("rules_breaching") > 0).alias("cdes_failing"), F.sum("rules_ran").alias("active_rules"), F.sum("rules_breaching").alias("rules_breaching"), score(F.sum("rows_evaluated"), F.sum("rows_failed")).alias("score_pct"))


def table_latest(m: Model) -> DataFrame:
    bound = m.coverage.groupBy("target_table").agg(F.countDistinct("cde_id").alias("cdes_registered"), F.max("business_domain").alias("business_domain"))
    rows = m.latest.join(m.rules.select("rule_id", "cde_id"), "rule_id", "left")
    s = F.col("status")
    k = rows.groupBy("target_table").agg(
        F.max("run_ts").alias("run_ts"), F.countDistinct(F.when(s.isin("pass", "breach"), F.col("cde_id"))).alias("cdes_monitored"), F.count_if(s.isin("pass", "breach")).alias("active_rules"), F.count_if(s == "pass").alias("passing"),
        F.count_if(s == "breach").alias("breaching"), F.count_if((s == "breach") & (F.col("severity") == "P1_block")).alias("p1_breaching"), F.count_if(s == "error").alias("errors"), F.max("table_rows").alias("table_rows"), F.max("population_rows").alias("current_records"), F.max("slice_rows").alias("slice_rows"),
    )
    tables = reg.monitored_current(m.tables["monitored_table"]).where("status = 'selected'").select("target_table", "table_code", "owner_group", F.col("business_domain").alias("_own_domain"))
    out = tables.join(k, "target_table", "left").join(bound, "target_table", "left").fillna(0, ["cdes_registered", "cdes_monitored", "active_rules"]).withColumn("business_domain", F.coalesce("business_domain", "_own_domain")).drop("_own_domain")
    return out.withColumns({"table_name": F.regexp_extract("target_table", r"([^.]+)$", 1), "passing_pct": F.when(F.col("active_rules") > 0, F.col("passing") * 100.0 / F.col("active_rules")), "needs_attention": flag((F.col("breaching") > 0) | (F.col("errors") > 0))})


def check_history(m: Model) -> DataFrame:
    active = m.rules.where("status = 'active'").select("rule_id", "cde_id")
    rows = m.runs.where(F.col("status").isin("pass", "breach")).drop("business_domain").join(m.scheduled.select("run_id", "run_day"), "run_id").join(active, "rule_id").join(m.named(), "cde_id", "left")
    return rows.select("run_id", "run_ts", "run_day", "rule_id", "target_table", "cde_id", "cde_name", "severity", F.col("element_domain").alias("business_domain"), F.col("status").alias("verdict"), "rows_scanned", "violation_count", "violation_pct")


def rules(m: Model) -> DataFrame:
    own = Window.partitionBy("rule_id")
    last = own.orderBy(F.desc("run_ts"), "result_id")
    k = m.runs.where("status <> 'error'").select("rule_id", "run_ts", F.col("status").alias("verdict"), "rows_scanned", "violation_count", "violation_pct", F.lag("violation_pct").over(own.orderBy("run_ts")).alias("_before"), F.count("*").over(own).alias("runs_measured"), F.min("run_ts").over(own).alias("measured_since"), F.row_number().over(last).alias("_n"))
    k = k.where("_n = 1").withColumnRenamed("run_ts", "measured_ts").withColumn("change_pct", F.col("violation_pct") - F.col("_before")).drop("_n", "_before")
    out = m.rules.join(m.named(), "cde_id", "left").join(k, "rule_id", "left")
    would = (F.col("status") == "shadow") & (F.col("violation_pct") > F.col("fail_threshold_pct"))
    return out.select("rule_id", "rule_name", "rule_version", "cde_id", "cde_name", "target_table", "target_column", "rule_type", dimension(F.col("rule_type")).alias("dimension"), "severity", F.col("element_domain").alias("business_domain"), F.col("status").alias("rule_status"), "fail_threshold_pct", F.col("join_sql").isNotNull().alias("is_cross_table"), "promoted_by", "measured_ts", "verdict", "rows_scanned", "violation_count", "violation_pct", "change_pct", "runs_measured", "measured_since", flag(would).alias("would_breach"))


WAITING = {"awaiting_triage": "the triage job", "awaiting_review": "a steward", "awaiting_approval": "an approver", "awaiting_verification": "the next run"}


def problems(m: Model, as_of: Column) -> DataFrame:
    now = m.escalation.where("escalates").join(m.scheduled.where("is_latest").select("run_id"), "run_id", "left_semi").select("rule_id").distinct()
    live = grouping.live_problems(now, m.tables["cohorts"]).groupBy("cohort_id").agg(F.count("*").alias("live_checks"))
    each = m.tables["cohorts"].select("cohort_id", F.explode("member_rule_ids").alias("rule_id")).join(m.rules.select("rule_id", "cde_id"), "rule_id").join(m.named(), "cde_id")
    named = each.groupBy("cohort_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("cde_name")), 1, 2), " and ").alias("attributes"))
    out = m.state.join(live, "cohort_id", "left").join(named, "cohort_id", "left")
    where, state = F.col("defect_location"), F.col("lifecycle_state")
    kind = lambda *t: F.when(where == "data", t[0]).when(where == "rule", t[1]).when(where == "neither", t[2])
    waiting = F.lit("—")
    for s, who in WAITING.items():
        waiting = F.when(state == s, who).otherwise(waiting)
    waiting = F.when(state.isin("approved_awaiting_execution", "reopened"), F.col("owner_group")).otherwise(waiting)
    return out.select(
        "cohort_id", "raised_ts", local_day(F.col("raised_ts"), m.tz).alias("raised_day"), "severity", "business_domain", "owner_group",
        F.concat(F.coalesce("attributes", F.array_join("affected_tables", ", ")), F.lit(" — "), F.coalesce(kind("wrong data", "rule flags valid rows", "needs a business call"), F.lit("not yet advised"))).alias("problem"),
        F.regexp_extract("root_cause_hypothesis", "^[^.:]*", 0).alias("claim"), kind("Wrong data", "Rule flags valid rows", "Needs a business call").alias("verdict"), "member_count", "total_violation_rows", F.size("affected_tables").alias("tables"),
        "lifecycle_state", flag(state.startswith("closed")).alias("is_closed"), waiting.alias("waiting_on"), F.when(~state.startswith("closed"), F.datediff(as_of, F.to_date("raised_ts"))).alias("age_days"), F.col("live_checks").isNotNull().alias("is_live"), F.coalesce("live_checks", F.lit(0)).alias("live_checks"),
    )


def problem_flow(m: Model) -> DataFrame:
    week = lambda c: F.date_trunc("week", c).cast("date").alias("week")
    s = m.state
    opened = s.select(week(F.col("raised_ts")), F.lit("Raised").alias("flow"), "cohort_id", "severity", "business_domain")
    at = F.when(F.col("lifecycle_state") == "closed_verified", F.col("verified_ts")).otherwise(F.col("reviewed_ts"))
    return opened.unionByName(s.where(F.col("lifecycle_state").startswith("closed")).select(week(at), F.lit("Closed").alias("flow"), "cohort_id", "severity", "business_domain"))


def resolution(m: Model) -> DataFrame:
    gaps = reg.disposition_integrity(m.tables["cohorts"], m.tables["disposition"]).groupBy("cohort_id").agg(F.count("*").alias("integrity_gaps"))
    followed = F.col("recommendation_followed")
    return m.state.join(gaps, "cohort_id", "left").select("cohort_id", "raised_ts", "severity", "business_domain", flag(F.col("lifecycle_state").startswith("closed")).alias("is_closed"), "mttr_days", flag((F.col("lifecycle_state") != "awaiting_triage") & F.col("latest_decision").isNotNull()).alias("has_decision"), flag(F.col("is_recurrence")).alias("is_recurrence"), F.when(followed, 1).when(~followed, 0).alias("advice_followed"), F.coalesce("integrity_gaps", F.lit(0)).alias("integrity_gaps"))


def decisions(m: Model) -> DataFrame:
    about = m.tables["cohorts"].select("cohort_id", "severity", "business_domain", F.regexp_extract("root_cause_hypothesis", "^[^.:]*", 0).alias("claim"))
    return m.tables["disposition"].join(about, "cohort_id").select("event_ts", "cohort_id", "severity", "business_domain", "claim", "event_seq", "event_type", "decision", "actor_identity", "actor_source", "reason", "violations_before", "violations_after", "verification_passed")


def escalation(m: Model) -> DataFrame:
    rows = m.escalation.join(m.scheduled.where("is_latest").select("run_id"), "run_id", "left_semi").join(m.named(), "cde_id", "left")
    return rows.select("run_id", "rule_id", "severity", "violation_count", "rows_scanned", "cde_id", "cde_name", F.col("element_domain").alias("business_domain"), "element_score_pct", "element_target_pct", "escalates", flag(~F.col("escalates")).alias("is_held"))


def run_health(m: Model, as_of: Column, days: int = 90) -> DataFrame:
    spark = m.runs.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(as_of, days - 1), as_of)).alias("run_day"))
    s = F.col("status")
    runs = m.runs.drop("run_ts").join(m.scheduled, "run_id").groupBy("run_day", "run_id", "run_ts", "is_latest").agg(F.count("*").alias("checks"), *[F.count_if(s == x).alias(n) for x, n in (("pass", "passed"), ("breach", "breach"), ("skipped", "skipped"), ("error", "errors"))], (F.sum("duration_sec") / 60.0).alias("duration_min"))
    return spine.join(runs, "run_day", "left").withColumns({"is_latest": F.coalesce("is_latest", F.lit(False)), "no_run": flag(F.col("run_id").isNull())})


def run_errors(m: Model) -> DataFrame:
    return m.latest.where("status = 'error'").select("run_ts", "rule_id", "target_table", "severity", "business_domain", "message")


def register_changes(m: Model) -> DataFrame:
    was = lambda c, key, version: F.lag(c).over(Window.partitionBy(key).orderBy(version))
    r = m.tables["rule_registry"].withColumn("was", was("status", "rule_id", "rule_version"))
    promoted = F.coalesce((F.col("status") == "active") & (F.col("was") == "shadow"), F.lit(False))
    change = F.when(F.col("rule_version") == 1, "registered").when(promoted, "promoted").when((F.col("status") == "retired") & (F.col("was") != "retired"), "retired").otherwise("new version")
    r = r.select(F.col("effective_from").alias("changed_ts"), F.lit("Rule").alias("object"), F.col("rule_id").alias("id"), F.col("rule_version").alias("version"), "status", change.alias("change"), flag(promoted).alias("is_promotion"))
    e = m.tables["cde_registry"].withColumn("was", was("tolerance_pct", "cde_id", "cde_version"))
    change = F.when(F.col("cde_version") == 1, "registered").when(F.col("status") == "retired", "retired").when(~F.col("tolerance_pct").eqNullSafe(F.col("was")), "tolerance").otherwise("new version")
    e = e.select(F.col("effective_from").alias("changed_ts"), F.lit("Key attribute").alias("object"), F.col("cde_id").alias("id"), F.col("cde_version").alias("version"), "status", change.alias("change"), F.lit(0).alias("is_promotion"))
    t = m.tables["monitored_table"]
    t = t.select(F.lit(None).cast("timestamp_ntz").alias("changed_ts"), F.lit("Table").alias("object"), F.col("target_table").alias("id"), F.col("table_version").alias("version"), "status", F.when(F.col("table_version") == 1, "selected").otherwise(F.col("status")).alias("change"), F.lit(0).alias("is_promotion"))
    return r.unionByName(e).unionByName(t)


def tolerance(m: Model) -> DataFrame:
    now = reg.tolerance_proposal_current(m.tables["tolerance_proposal"], m.tables["tolerance_review"], m.elements)
    return now.join(m.named().drop("cde_name"), "cde_id", "left").select("cde_id", "cde_name", F.col("element_domain").alias("business_domain"), "proposed_ts", F.col("register_tolerance_pct").alias("tolerance_pct"), "advice", "proposed_tolerance_pct", "review_state")


def dimension_scores(m: Model) -> DataFrame:
    attached = reg.rule_elements(m.coverage).select("rule_id").distinct()
    k = reg.raised(m.runs, "pass", "breach").drop("run_ts").join(attached, "rule_id", "left_semi").join(m.rules.select("rule_id", dimension(F.col("rule_type")).alias("dimension")), "rule_id").join(m.scheduled, "run_id")
    return k.groupBy("run_day", "run_ts", "is_latest", "dimension").agg(F.count("*").alias("checks_run"), F.count_if(F.col("status") == "breach").alias("checks_breaching"), F.sum("rows_scanned").alias("rows_checked"), F.sum("violation_count").alias("rows_failed"), score(F.sum("rows_scanned"), F.sum("violation_count")).alias("score_pct"))
