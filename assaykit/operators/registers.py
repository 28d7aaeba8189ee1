"""Current state folded from append-only registers. A change is a new version; nothing is updated in place.

Inputs are the register tables by name; every function is DataFrame in, DataFrame out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.scalar import local_day
from assaykit.sources.relations import latest

SYDNEY = "Australia/Sydney"


def versions(register: DataFrame, key: str, version: str) -> DataFrame:
    """Every version with the time at which the next one took over."""
    order = Window.partitionBy(key).orderBy(version)
    return register.withColumn("effective_to", F.lead("effective_from").over(order))


def current(register: DataFrame, key: str, version: str) -> DataFrame:
    """H1, H2: the latest version of each key that is not retired."""
    return latest(register, [key], version).where("status <> 'retired'")


def approvals_needed(severity: Column) -> Column:
    return F.when(severity == "P1_block", 2).otherwise(1)


def cohort_current(cohorts: DataFrame, disposition: DataFrame) -> DataFrame:
    """H3: each problem with the state that its events add up to."""
    kind = F.col("event_type")
    at = lambda name: F.when(kind == name, F.col("event_seq"))
    last = lambda value, name: F.max_by(value, at(name)).alias
    events = disposition.groupBy("cohort_id").agg(
        F.max(F.when(kind == "reviewed", F.col("event_ts"))).alias("reviewed_ts"),
        F.max(F.when(kind == "executed", F.col("event_ts"))).alias("executed_ts"),
        F.max(F.when(kind == "verified", F.col("event_ts"))).alias("verified_ts"),
        F.countDistinct(F.when(kind == "approved", F.col("actor_identity"))).alias("distinct_approvers"),
        F.count_if(kind == "reopened").alias("reopen_count"),
        last("decision", "reviewed")("latest_decision"),
        last("reason", "reviewed")("latest_reason"),
        last("verification_passed", "verified")("last_verification_passed"),
        last("violations_before", "verified")("violations_before"),
        last("violations_after", "verified")("violations_after"),
        last("approach_type_taken", "executed")("approach_type_taken"),
        F.max_by("event_type", "event_seq").alias("last_event_type"),
        F.lit(True).alias("_any"),
    )
    passed, needed = F.col("last_verification_passed") == F.lit(True), approvals_needed(F.col("severity"))
    decided = F.col("latest_decision")
    state = (
        F.when(F.col("_any").isNull(), "awaiting_triage")
        .when(passed, "closed_verified")
        .when((F.col("reopen_count") > 0) & F.col("last_event_type").isin("reopened", "verified"), "reopened")
        .when(decided == "rejected", "closed_rejected")
        .when(decided == "no_action", "closed_no_action")
        .when(decided == "deferred", "deferred")
        .when(F.col("executed_ts").isNotNull(), "awaiting_verification")
        .when(F.col("distinct_approvers") >= needed, "approved_awaiting_execution")
        .when(decided == "accepted", "awaiting_approval")
        .otherwise("awaiting_review")
    )
    taken = F.col("approach_type_taken")
    seconds = F.expr("timestampdiff(SECOND, raised_ts, verified_ts)")
    return (
        cohorts.join(events, "cohort_id", "left")
        .withColumns({"lifecycle_state": state, "approvals_required": needed})
        .withColumn("recommendation_followed", F.when(taken.isNotNull(), taken == F.col("recommended_approach_type")))
        .withColumn("mttr_days", F.when(passed, seconds / 86400.0))
        .drop("_any", "last_event_type", "last_verification_passed")
    )


def disposition_integrity(cohorts: DataFrame, disposition: DataFrame) -> DataFrame:
    """H4: cohort_id, finding, detail for four control failures."""
    need = approvals_needed(F.col("severity"))
    approved = disposition.where("event_type = 'approved'")
    few = (
        cohorts.join(approved, "cohort_id").groupBy("cohort_id", "severity").agg(F.countDistinct("actor_identity").alias("n"), F.count("*").alias("rows"))
        .where(F.col("n") < need)
        .select("cohort_id", F.lit("insufficient_distinct_approvers").alias("finding"), F.format_string("%s needs %d approvers, has %d in %d approvals", "severity", need, "n", "rows").alias("detail"))
    )
    before = approved.select(F.col("cohort_id").alias("_c"), F.col("event_seq").alias("_s"))
    early = disposition.where("event_type = 'executed'").join(before, (F.col("cohort_id") == F.col("_c")) & (F.col("_s") < F.col("event_seq")), "left_anti")
    early = early.groupBy("cohort_id").agg(F.min("event_seq").alias("s")).select("cohort_id", F.lit("executed_without_approval").alias("finding"), F.format_string("executed at seq %d without an approval before", "s").alias("detail"))
    odd = disposition.where(F.col("event_type").isin("reviewed", "approved", "executed") & ((F.col("actor_source") != "obo_user") | F.col("actor_identity").isNull()))
    odd = odd.select("cohort_id", F.lit("identity_not_from_platform").alias("finding"), F.format_string("%s at seq %d comes from %s", "event_type", "event_seq", F.coalesce("actor_source", F.lit("NULL"))).alias("detail"))
    opened = disposition.where("event_type = 'recommended'").select("cohort_id")
    silent = cohorts.join(opened, "cohort_id", "left_anti").select("cohort_id", F.lit("missing_recommended_event").alias("finding"), F.lit("no recommended event opens the chain").alias("detail"))
    return few.unionByName(early).unionByName(odd).unionByName(silent)


def binding_current(elements: DataFrame) -> DataFrame:
    """A row per bound column of the registered elements (elements: current versions)."""
    return elements.where("status = 'registered'").select("cde_id", "cde_name", "criticality", "tolerance_pct", "business_domain", F.inline("bindings"))


VALIDATING = ("format", "uniqueness", "referential", "variance")


def coverage(elements: DataFrame, rules: DataFrame, check_run: DataFrame, profile: DataFrame) -> DataFrame:
    """H5: each bound column with its active rules, their last verdicts, the latest profile and the gap.

    elements and rules are current versions. The last verdicts are those of the latest run_ts of all.
    """
    bound = binding_current(elements).where("binding_status = 'bound'").drop("binding_status")
    active = rules.where("status = 'active'").select("rule_id", "rule_type", "scope_filter", F.col("cde_id").alias("_e"), F.col("target_table").alias("_t"), F.col("target_column").alias("_c"))
    newest = check_run.agg(F.max("run_ts").alias("run_ts"))
    verdicts = check_run.join(F.broadcast(newest), "run_ts").select(F.col("rule_id").alias("_r"), F.col("status").alias("latest_status"), "violation_count")
    fits = (F.col("_e") == F.col("cde_id")) & (F.col("_c").isNull() | ((F.col("_t") == F.col("target_table")) & (F.col("_c") == F.col("target_column"))))
    attached = bound.join(active, fits, "left").join(verdicts, F.col("rule_id") == F.col("_r"), "left")
    breach = F.col("latest_status") == "breach"
    keys = bound.columns
    rolled = attached.groupBy(*keys).agg(
        F.countDistinct("rule_id").alias("rule_count"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.array_sort(F.collect_set("rule_type")).alias("rule_types"),
        F.array_sort(F.collect_set(F.when(breach, F.col("rule_id")))).alias("breaching_rule_ids"),
        F.coalesce(F.sum(F.when(breach, F.col("violation_count"))), F.lit(0)).alias("latest_violation_rows"),
        F.array_sort(F.collect_set(F.when(F.col("expected_scope_filter").isNotNull() & F.col("rule_id").isNotNull() & F.col("scope_filter").isNull(), F.col("rule_id")))).alias("unscoped_rule_ids"),
    )
    place = ["cde_id", "target_table", "target_column"]
    order = Window.partitionBy(*place).orderBy(F.desc("profile_day"))
    profiled = profile.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*place, "profile_day", F.col("rows_scanned").alias("profiled_rows"), "distinct_count")
    gap = (
        F.when(F.col("rule_count") == 0, "no_rule")
        .when(F.size("unscoped_rule_ids") > 0, "scope_mismatch")
        .when(F.size(F.array_intersect("rule_types", F.array(*map(F.lit, VALIDATING)))) == 0, "unvalidated")
        .otherwise("covered")
    )
    return rolled.join(profiled, place, "left").withColumns({"breaching_rule_count": F.size("breaching_rule_ids"), "never_profiled": F.col("profile_day").isNull(), "coverage_gap": gap})


def coverage_summary(cov: DataFrame) -> DataFrame:
    """H6. Critical gaps are those of critical and of high elements."""
    gap = F.col("coverage_gap") != "covered"
    return cov.agg(
        F.count("*").alias("bindings"), F.countDistinct("cde_id").alias("elements"), F.count_if(~gap).alias("covered"), F.round(F.try_divide(F.count_if(~gap) * 100.0, F.count("*")), 1).alias("covered_pct"), F.count_if(gap).alias("gaps"),
        F.count_if(gap & F.col("criticality").isin("critical", "high")).alias("critical_gaps"), F.count_if("never_profiled").alias("unprofiled"), F.count_if(F.size("unscoped_rule_ids") > 0).alias("mismatches"),
    )


def rule_elements(cov: DataFrame) -> DataFrame:
    """H7: rule_id, cde_id pairs of the coverage."""
    return cov.select("cde_id", F.explode("rule_ids").alias("rule_id")).distinct()


def disputed_rules(cov: DataFrame) -> DataFrame:
    return cov.select(F.explode("unscoped_rule_ids").alias("rule_id")).distinct()


def raised(check_run: DataFrame, *states: str) -> DataFrame:
    """One verdict per run and rule among these states, the least result_id where a rule repeats."""
    order = Window.partitionBy("run_id", "rule_id").orderBy("result_id")
    return check_run.where(F.col("status").isin(*states)).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def score(evaluated: Column, failed: Column) -> Column:
    """The share of rows that passed, in percent; NULL when none was evaluated."""
    return F.when(evaluated > 0, (evaluated - failed).cast("double") * 100.0 / evaluated)


def element_tolerance(check_run: DataFrame, cov: DataFrame, elements: DataFrame) -> DataFrame:
    """H8: per run and element, whether the share of failing rows is within the element's tolerance."""
    disputed = cov.groupBy("cde_id").agg(F.bool_or(F.col("coverage_gap") == "scope_mismatch").alias("scope_disputed"))
    scored = (
        raised(check_run, "pass", "breach").join(rule_elements(cov), "rule_id").groupBy("run_id", "cde_id")
        .agg(F.max("run_ts").alias("run_ts"), F.count("*").alias("checks_raised"), F.sum("rows_scanned").alias("rows_evaluated"), F.sum("violation_count").alias("rows_failed"))
    )
    out = scored.join(elements.select("cde_id", "cde_name", "criticality", "tolerance_pct"), "cde_id").join(disputed, "cde_id", "left")
    out = out.withColumns({"score_pct": score(F.col("rows_evaluated"), F.col("rows_failed")), "target_pct": 100.0 - F.col("tolerance_pct"), "scope_disputed": F.coalesce("scope_disputed", F.lit(False))})
    inside = ~F.col("scope_disputed") & (F.col("score_pct") >= F.col("target_pct") - 1e-9)
    return out.withColumn("within_tolerance", F.coalesce(inside, F.lit(False)))


def check_escalation(check_run: DataFrame, cov: DataFrame, tolerance: DataFrame, gate: bool = False) -> DataFrame:
    """H9: each breach with its element's standing; all escalate unless ``gate`` holds back those within tolerance."""
    breaches = raised(check_run, "breach").select("run_id", "run_ts", "rule_id", "severity", "violation_count", "rows_scanned")
    standing = tolerance.select("run_id", "cde_id", F.col("score_pct").alias("element_score_pct"), F.col("target_pct").alias("element_target_pct"), F.col("within_tolerance").alias("element_within_tolerance"))
    out = breaches.join(rule_elements(cov), "rule_id", "left").join(standing, ["run_id", "cde_id"], "left").withColumn("element_within_tolerance", F.coalesce("element_within_tolerance", F.lit(False)))
    return out.withColumn("escalates", ~F.col("element_within_tolerance") if gate else F.lit(True))


def _newest(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(ts), tie)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def tolerance_proposal_current(proposals: DataFrame, reviews: DataFrame, elements: DataFrame) -> DataFrame:
    """H10."""
    last = _newest(reviews, "proposal_id", "event_ts", "review_id").select("proposal_id", F.col("decision").alias("latest_decision"))
    register = elements.select("cde_id", "cde_name", F.col("tolerance_pct").alias("register_tolerance_pct"))
    out = _newest(proposals, "cde_id", "proposed_ts", "proposal_id").join(last, "proposal_id", "left").join(register, "cde_id", "left")
    state = F.when(F.col("advice") == "keep", "no_change").when((F.col("advice") == "tighten") & (F.col("register_tolerance_pct") == F.col("proposed_tolerance_pct")), "in_force")
    for decision in ("rejected", "deferred", "accepted"):
        state = state.when(F.col("latest_decision") == decision, decision)
    return out.withColumn("review_state", state.otherwise("open"))


def threshold_proposal_current(proposals: DataFrame, reviews: DataFrame, rules: DataFrame) -> DataFrame:
    """A decision goes before what is in force."""
    last = _newest(reviews, "proposal_id", "event_ts", "review_id").select("proposal_id", F.col("decision").alias("latest_decision"))
    register = rules.select("rule_id", F.col("fail_threshold_pct").alias("registry_threshold_pct"))
    out = _newest(proposals, "rule_id", "proposed_ts", "proposal_id").join(last, "proposal_id", "left").join(register, "rule_id", "left")
    state = F.when(F.col("basis") == "unchanged", "no_change")
    for decision in ("adopted", "rejected", "deferred"):
        state = state.when(F.col("latest_decision") == decision, decision)
    return out.withColumn("review_state", state.when(F.col("registry_threshold_pct") == F.col("proposed_threshold_pct"), "in_force").otherwise("open"))


def monitored_current(monitored: DataFrame) -> DataFrame:
    return latest(monitored, ["target_table"], "table_version")


def binding_proposal_open(proposals: DataFrame, reviews: DataFrame, bound: DataFrame) -> DataFrame:
    """Proposals without a review, for columns that are not bound."""
    return proposals.join(reviews.select("proposal_id"), "proposal_id", "left_anti").join(bound.select("target_table", "target_column"), ["target_table", "target_column"], "left_anti")


def onboarding_status(monitored: DataFrame, open_proposals: DataFrame, bound: DataFrame, rules: DataFrame, check_run: DataFrame) -> DataFrame:
    """The stage that counts add up to, per selected table."""
    t = "target_table"
    counts = [
        open_proposals.groupBy(t).agg(F.count("*").alias("proposals_open")),
        bound.groupBy(t).agg(F.countDistinct("target_column").alias("columns_bound")),
        rules.groupBy(t).agg(F.count_if(F.col("status") == "shadow").alias("rules_shadow"), F.count_if(F.col("status") == "active").alias("rules_active")),
        check_run.groupBy(t).agg(F.countDistinct("run_id").alias("runs"), F.max("run_ts").alias("last_run_ts")),
    ]
    out = monitored_current(monitored).where("status = 'selected'").select(t, "table_code", "owner_group")
    for c in counts:
        out = out.join(c, t, "left")
    out = out.fillna(0, ["proposals_open", "columns_bound", "rules_shadow", "rules_active", "runs"])
    n = F.col
    stage = (
        F.when(n("proposals_open") > 0, "2 bindings awaiting review").when(n("columns_bound") == 0, "1 awaiting discovery").when(n("rules_shadow") + n("rules_active") == 0, "3 awaiting rule generation")
        .when((n("rules_active") == 0) & (n("runs") == 0), "4 shadow, not yet run").when(n("rules_active") == 0, "5 shadow, awaiting promotion").otherwise("6 active")
    )
    return out.withColumn("stage", stage)


def onboarding_summary(monitored: DataFrame, status: DataFrame) -> DataFrame:
    """Tables by stage, and what waits in them: waiting tables stand at a step that a person takes."""
    paused = monitored_current(monitored).agg(F.count_if(F.col("status") == "paused").alias("paused"))
    stage = F.substring("stage", 1, 1)
    waiting, shadow = stage.isin("2", "5"), stage.isin("4", "5")
    return status.agg(
        F.count("*").alias("selected"), F.count_if(waiting).alias("waiting"), F.coalesce(F.sum("proposals_open"), F.lit(0)).alias("waiting_bindings"), F.count_if(shadow).alias("shadow"),
        F.coalesce(F.sum(F.when(shadow, F.col("rules_shadow"))), F.lit(0)).alias("shadow_checks"), F.count_if(stage == "6").alias("active"),
    ).crossJoin(paused)  # one row each


def cde_proposal_current(proposals: DataFrame, reviews: DataFrame, registry: DataFrame) -> DataFrame:
    """Applied is read from a marker in the register's note."""
    marked = registry.withColumn("proposal_id", F.regexp_extract("note", r"^\[cde_proposal ([^\]]+)\]", 1)).where("proposal_id <> ''").groupBy("proposal_id").agg(F.min("cde_version").alias("applied_version"))
    state = F.when(F.col("decision").isNull(), "open").when(F.col("decision") == "rejected", "rejected").when(F.col("applied_version").isNotNull(), "applied").otherwise("approved")
    return proposals.join(reviews, "proposal_id", "left").join(marked, "proposal_id", "left").withColumn("state", state)


def consistency_proposal_current(proposals: DataFrame, reviews: DataFrame, registry: DataFrame) -> DataFrame:
    """H16."""
    marked = registry.select("rule_id", F.regexp_extract("note", r"^\[consistency_proposal ([^\]]+)\]", 1).alias("proposal_id"), F.lit(True).alias("_applied")).where("proposal_id <> ''").distinct()
    state = F.when(F.col("decision") == "rejected", "rejected").when((F.col("decision") == "approved") & F.col("_applied").isNotNull(), "applied").when(F.col("decision") == "approved", "approved").otherwise("open")
    return proposals.join(reviews, "proposal_id", "left").join(marked, ["proposal_id", "rule_id"], "left").withColumn("state", state).drop("_applied")


def scheduled_run(check_run: DataFrame, tz: str = SYDNEY) -> DataFrame:
    """The last run of each local day that measured something; is_latest marks one run, by run_id where times tie."""
    runs = check_run.groupBy("run_id").agg(F.max("run_ts").alias("run_ts"), F.count("*").alias("checks"), F.count_if(F.col("status") != "skipped").alias("_raised")).where("_raised > 0").drop("_raised")
    runs = runs.withColumn("run_day", local_day(F.col("run_ts"), tz))
    day = Window.partitionBy("run_day").orderBy(F.desc("run_ts"), "run_id")
    runs = runs.withColumn("_n", F.row_number().over(day)).where("_n = 1").drop("_n")
    newest = runs.agg(F.max_by("run_id", F.struct("run_ts", "run_id")).alias("_last"))
    return runs.crossJoin(F.broadcast(newest)).withColumn("is_latest", F.col("run_id") == F.col("_last")).drop("_last")  # one row


def weekly_run(runs: DataFrame) -> DataFrame:
    """The last scheduled run of each week."""
    weeks = runs.withColumn("run_week", F.date_trunc("week", "run_day").cast("date"))
    order = Window.partitionBy("run_week").orderBy(F.desc("run_ts"), "run_id")
    return weeks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def apply_bindings(elements: DataFrame, proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """A new version of each element with approved columns that it has not bound; one's own approval does not count."""
    approved = proposals.join(reviews.where("decision = 'approved'"), "proposal_id")
    if {"proposed_by", "reviewed_by"} <= set(approved.columns):
        approved = approved.where("proposed_by <> reviewed_by")
    bound = elements.select("cde_id", F.inline_outer("bindings")).select("cde_id", "target_table", "target_column")
    fresh = approved.select("cde_id", "target_table", "target_column").distinct().join(bound, ["cde_id", "target_table", "target_column"], "left_anti")
    cell = F.struct("target_table", "target_column", F.lit(None).cast("string").alias("expected_scope_filter"), F.lit("bound").alias("binding_status"))
    added = fresh.groupBy("cde_id").agg(F.array_sort(F.collect_list(cell)).alias("_new"))
    return elements.join(added, "cde_id").withColumns({"cde_version": F.col("cde_version") + 1, "bindings": F.concat(F.coalesce("bindings", F.array().cast(elements.schema["bindings"].dataType)), "_new")}).drop("_new")


def unbind(elements: DataFrame, drop: DataFrame) -> DataFrame:
    """A new version of each element without the columns in ``drop`` (target_table, target_column)."""
    hit = elements.select("cde_id", F.inline("bindings")).join(drop.select("target_table", "target_column").distinct(), ["target_table", "target_column"], "left_semi")
    places = hit.groupBy("cde_id").agg(F.collect_set(F.struct("target_table", "target_column")).alias("_gone"))
    kept = F.filter("bindings", lambda b: ~F.array_contains(F.col("_gone"), F.struct(b["target_table"].alias("target_table"), b["target_column"].alias("target_column"))))
    return elements.join(places, "cde_id").withColumns({"cde_version": F.col("cde_version") + 1, "bindings": kept}).drop("_gone")


def apply_element_changes(elements: DataFrame, changes: DataFrame) -> DataFrame:
    """cde_id, cde_version, tolerance_pct, status of the versions that changes (cde_id, kind, tolerance_pct) make: register, amend or retire."""
    known = elements.select("cde_id", "cde_version", F.col("tolerance_pct").alias("_was"))
    both = changes.join(known, "cde_id", "left").where((F.col("kind") == "register") == F.col("cde_version").isNull())
    return both.select("cde_id", (F.coalesce("cde_version", F.lit(0)) + 1).alias("cde_version"), F.when(F.col("kind") == "retire", F.col("_was")).otherwise(F.col("tolerance_pct")).alias("tolerance_pct"), F.when(F.col("kind") == "retire", "retired").otherwise("registered").alias("status"))


def retire_rules(rules: DataFrame, retired_elements: DataFrame) -> DataFrame:
    """A retired version of each current rule of these elements."""
    return rules.join(retired_elements.select("cde_id"), "cde_id", "left_semi").withColumns({"rule_version": F.col("rule_version") + 1, "status": F.lit("retired")})


def shadow_evidence(rules: DataFrame, check_run: DataFrame) -> DataFrame:
    """Each current rule with what its latest run measured, in how many runs it was, and whether it would breach its limit as it is now; NULL where nothing was measured."""
    newest = F.struct("run_ts", "result_id")
    measured = check_run.groupBy("rule_id").agg(F.max_by(F.struct("violation_count", "rows_scanned", "violation_pct"), newest).alias("_m"), F.countDistinct("run_id").alias("runs_measured"))
    out = rules.join(measured, "rule_id", "left").select(*rules.columns, F.coalesce("runs_measured", F.lit(0)).alias("runs_measured"), "_m.*")
    return out.withColumn("would_breach", F.when(F.col("violation_pct").isNotNull(), (F.col("violation_pct") > F.col("fail_threshold_pct")) & (F.coalesce("violation_count", F.lit(0)) > 0)))


def unmeasured_tables(monitored: DataFrame, rules: DataFrame, check_run: DataFrame) -> DataFrame:
    """Selected tables with a shadow rule whose version no run has measured."""
    waiting = rules.where("status = 'shadow'").join(check_run.select("rule_id", "rule_version"), ["rule_id", "rule_version"], "left_anti")
    return monitored_current(monitored).where("status = 'selected'").join(waiting.select("target_table"), "target_table", "left_semi").select("target_table")


def slice_breaks(check_run: DataFrame) -> DataFrame:
    """Per table, the runs at which the slice version changes."""
    runs = check_run.groupBy("target_table", "run_id").agg(F.max("run_ts").alias("run_ts"), F.max("slice_version").alias("slice_version"))
    order = Window.partitionBy("target_table").orderBy("run_ts", "run_id")
    was, n = F.lag("slice_version").over(order), F.row_number().over(order)
    return runs.withColumns({"was": was, "_n": n}).where((F.col("_n") > 1) & ~F.col("was").eqNullSafe(F.col("slice_version"))).drop("_n")


def run_population(check_run: DataFrame) -> DataFrame:
    """Per table, the rows and the slice of its latest run that recorded them; tables of which none did are left out."""
    known = check_run.where("table_rows is not null")
    return known.groupBy("target_table").agg(F.max_by(F.struct("table_rows", "slice_rows", "slice_version", "run_ts"), F.struct("run_ts", "result_id")).alias("_r")).select("target_table", "_r.*")


def retire_impact(elements: DataFrame, rules: DataFrame, cohorts: DataFrame) -> DataFrame:
    """What retiring each element would take with it: its bindings as table.column, its active and shadow rules, and the problems that hold any of them."""
    mine = rules.where("status <> 'retired' and cde_id is not null").select("cde_id", "rule_id", "status")
    by = mine.groupBy("cde_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("rule_id")))).alias(s) for s in ("active", "shadow")])
    held = cohorts.select("cohort_id", F.explode("member_rule_ids").alias("rule_id")).join(mine, "rule_id").groupBy("cde_id").agg(F.array_sort(F.collect_set("cohort_id")).alias("problems"))
    none = F.array().cast("array<string>")
    place = F.transform("bindings", lambda b: F.concat(F.regexp_extract(b["target_table"], r"([^.]+)$", 1), F.lit("."), b["target_column"]))
    out = elements.select("cde_id", F.coalesce(place, none).alias("bindings")).join(by, "cde_id", "left").join(held, "cde_id", "left")
    return out.select("cde_id", "bindings", *[F.coalesce(c, none).alias(c) for c in ("active", "shadow", "problems")])


def over_tolerance(rules: DataFrame, elements: DataFrame) -> DataFrame:
    """Rules that let more fail than their element tolerates."""
    return rules.join(elements.select("cde_id", "tolerance_pct"), "cde_id").where("fail_threshold_pct > tolerance_pct").select("rule_id", "cde_id", "fail_threshold_pct", "tolerance_pct")


def blended_target(tolerance: DataFrame) -> DataFrame:
    """Per run, the elements' targets weighted by rows; elements without a target don't count."""
    rows = F.when(F.col("target_pct").isNotNull(), F.col("rows_evaluated"))
    return tolerance.groupBy("run_id").agg((F.sum(rows * F.col("target_pct")) / F.sum(rows)).alias("target_pct"))


# Fixed value: how the reason of an exclusion begins.
EXCLUDED = "[excluded at promotion]"


def excluded_bindings(proposals: DataFrame, reviews: DataFrame, mark: str = EXCLUDED) -> DataFrame:
    """Columns and elements whose latest decision is a rejection that says so."""
    key = ["target_table", "target_column", "cde_id"]
    last = proposals.join(reviews, "proposal_id").groupBy(*key).agg(F.max_by(F.struct("decision", "reason"), F.struct("reviewed_seq", "proposal_id")).alias("_d"))
    return last.where((F.col("_d.decision") == "rejected") & F.col("_d.reason").startswith(mark)).select(*key)


#: The event that a person may author in a state. Verification is the check runner's alone, so a problem that awaits it offers none.
NEXT = {
    "awaiting_triage": "reviewed", "awaiting_review": "reviewed", "reopened": "reviewed", "deferred": "reviewed", "awaiting_approval": "approved", "approved_awaiting_execution": "executed",
}
AUTHORED = ("reviewed", "approved", "executed")


def next_events(state: DataFrame) -> DataFrame:
    """cohort_id, next_event, the approvals it has and needs, and whether they are enough."""
    event = F.lit(None).cast("string")
    for s, e in NEXT.items():
        event = F.when(F.col("lifecycle_state") == s, e).otherwise(event)
    have = F.coalesce("distinct_approvers", F.lit(0))
    return state.select("cohort_id", "lifecycle_state", event.alias("next_event"), have.alias("have"), F.col("approvals_required").alias("need"), (have >= F.col("approvals_required")).alias("gate_open"))


def validate_events(incoming: DataFrame, disposition: DataFrame) -> DataFrame:
    """cohort_id, event_seq, fault of incoming events that may not be appended: events that no person authors, rejections and deferrals
    without a reason, deferrals without a date, and second approvals by one identity, earlier or in this batch."""
    faults = F.array_compact(F.array(
        F.when(~F.col("event_type").isin(*AUTHORED), "wrong author"),
        F.when(F.col("decision").isin("rejected", "deferred") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "decision without a reason"),
        F.when((F.col("decision") == "deferred") & F.col("review_by_date").isNull(), "deferral without a date"),
        F.when((F.col("event_type") == "approved") & (F.col("_before") | (F.col("_nth") > 1)), "approved twice"),
    ))
    prior = disposition.where("event_type = 'approved'").select("cohort_id", "actor_identity", F.lit(True).alias("_before")).distinct()
    nth = F.row_number().over(Window.partitionBy("cohort_id", "actor_identity", "event_type").orderBy("event_seq"))
    rows = incoming.withColumn("_nth", nth).join(prior, ["cohort_id", "actor_identity"], "left").withColumn("_before", F.coalesce("_before", F.lit(False)))
    return rows.select("cohort_id", "event_seq", F.explode(faults).alias("fault"))


def next_sequence(incoming: DataFrame, disposition: DataFrame) -> DataFrame:
    """Incoming events (cohort_id, arrival) numbered on from what is there."""
    top = disposition.groupBy("cohort_id").agg(F.max("event_seq").alias("_top"))
    nth = F.row_number().over(Window.partitionBy("cohort_id").orderBy("arrival"))
    return incoming.join(top, "cohort_id", "left").withColumn("event_seq", F.coalesce("_top", F.lit(0)) + nth).drop("_top")


def promote(rules: DataFrame, excluded: DataFrame) -> DataFrame:
    """The next version of each shadow rule: active, or retired where its column is excluded."""
    out = excluded.select("target_table", "target_column", F.lit(True).alias("_out")).distinct()
    both = rules.where("status = 'shadow'").join(out, ["target_table", "target_column"], "left")
    return both.withColumns({"rule_version": F.col("rule_version") + 1, "status": F.when(F.col("_out"), "retired").otherwise("active")}).drop("_out").select(*rules.columns)


def decommission(rules: DataFrame, keep: DataFrame, table: str) -> DataFrame:
    """Retired versions of a table's rules, but for those to keep (rule_id)."""
    return rules.where(F.col("target_table") == table).join(keep.select("rule_id"), "rule_id", "left_anti").withColumns({"rule_version": F.col("rule_version") + 1, "status": F.lit("retired")})


_PROPOSED = ("slice_proposed_filter", "slice_proposed_by")


def slice_state(monitored: DataFrame) -> DataFrame:
    """Per table, the slice in force and the proposal that waits for a second person. A decided proposal stays on the version that decided it, but is pending no more."""
    now = monitored_current(monitored)
    waits = F.col("slice_proposed_by").isNotNull() & ~F.coalesce(F.col("slice_change").isin("approved", "rejected"), F.lit(False))
    return now.select("target_table", "table_version", "slice_filter", "slice_version", *[F.when(waits, F.col(c)).alias(c.replace("proposed", "pending")) for c in _PROPOSED])


def carry_forward(monitored: DataFrame, status: str) -> DataFrame:
    """The next version of each table, with another status and its slice as it is: what is in force always, a proposal while it is pending, what was done to the slice never."""
    held = slice_state(monitored).select("target_table", *[c.replace("proposed", "pending") for c in _PROPOSED])
    next_ = monitored_current(monitored).join(held, "target_table").withColumns({"table_version": F.col("table_version") + 1, "status": F.lit(status), "slice_change": F.lit(None).cast("string"), **{c: F.col(c.replace("proposed", "pending")) for c in _PROPOSED}})
    return next_.select(*monitored.columns)


def slice_decision_fault(proposed_by: Column, reviewer: Column, decision: Column, reason: Column, allow_self: bool = False) -> Column:
    """Why a decision on a slice is refused, NULL if it is not: one's own proposal may be withdrawn but not approved, and a rejection says why."""
    own = F.lower(F.coalesce(proposed_by, F.lit(""))) == F.lower(F.coalesce(reviewer, F.lit("")))
    known = F.coalesce(decision.isin("approved", "rejected"), F.lit(False))
    return F.when(~known, "unknown decision").when((decision == "approved") & own & F.lit(not allow_self), "second person needed").when((decision == "rejected") & (F.trim(F.coalesce(reason, F.lit(""))) == ""), "no reason")


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A projection without some columns."""
    return df.drop(*columns)
