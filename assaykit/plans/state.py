"""Queries of registers, problems, metrics and datasets over registers derived from the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import datasets, grouping, metrics, profiling
from assaykit.operators import checks as run
from assaykit.operators import registers as reg
from assaykit.plans.fixtures import Registers, with_clause
from assaykit.schemas import constraint_rules
from assaykit.sources import relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TZ = "CAST({} AT TIME ZONE 'UTC' AT TIME ZONE 'Australia/Sydney' AS DATE)"

#: What the oracle's queries share, written apart from the DataFrame code.
SHARED = {
    "rules_now": "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rule_id ORDER BY rule_version DESC) AS n FROM rule_registry) WHERE n = 1 AND status <> 'retired'",
    "elements_now": "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cde_id ORDER BY cde_version DESC) AS n FROM elements) WHERE n = 1 AND status <> 'retired'",
    "bound": "SELECT e.cde_id, e.cde_name, e.criticality, e.tolerance_pct, e.business_domain, b.target_table, b.target_column, b.expected_scope_filter, b.binding_status FROM elements_now e JOIN bindings b ON b.cde_id = e.cde_id AND b.cde_version = e.cde_version WHERE e.status = 'registered'",
    "verdicts_now": "SELECT * FROM check_run WHERE run_ts = (SELECT MAX(run_ts) FROM check_run)",
    "attached": "SELECT b.*, r.rule_id, r.rule_type, r.scope_filter, v.status AS latest_status, v.violation_count FROM bound b LEFT JOIN rules_now r ON r.status = 'active' AND r.cde_id = b.cde_id AND (r.target_column IS NULL OR (r.target_table = b.target_table AND r.target_column = b.target_column)) LEFT JOIN verdicts_now v ON v.rule_id = r.rule_id WHERE b.binding_status = 'bound'",
    "cov": """SELECT a.*, p.profile_day, p.profile_day IS NULL AS never_profiled,
                CASE WHEN rule_count = 0 THEN 'no_rule' WHEN unscoped > 0 THEN 'scope_mismatch' WHEN validating = 0 THEN 'unvalidated' ELSE 'covered' END AS coverage_gap
              FROM (SELECT cde_id, cde_name, criticality, tolerance_pct, business_domain, target_table, target_column, expected_scope_filter, COUNT(DISTINCT rule_id) AS rule_count,
                     COUNT(DISTINCT CASE WHEN latest_status = 'breach' THEN rule_id END) AS breaching_rule_count,
                     COALESCE(SUM(CASE WHEN latest_status = 'breach' THEN violation_count END), 0)::BIGINT AS latest_violation_rows,
                     COUNT(DISTINCT CASE WHEN expected_scope_filter IS NOT NULL AND scope_filter IS NULL THEN rule_id END) AS unscoped,
                     COUNT(*) FILTER (rule_type IN ('format', 'uniqueness', 'referential', 'variance')) AS validating
                    FROM attached GROUP BY ALL) a
              LEFT JOIN (SELECT cde_id, target_table, target_column, MAX(profile_day) AS profile_day FROM profile GROUP BY ALL) p USING (cde_id, target_table, target_column)""",
    "rule_element": "SELECT DISTINCT cde_id, rule_id FROM attached WHERE rule_id IS NOT NULL",
    "tol": """SELECT s.*, e.cde_name, e.criticality, e.tolerance_pct, CASE WHEN rows_evaluated > 0 THEN CAST(rows_evaluated - rows_failed AS DOUBLE) * 100.0E0 / rows_evaluated END AS score_pct,
                100.0E0 - e.tolerance_pct AS target_pct, COALESCE(d.scope_disputed, FALSE) AS scope_disputed,
                COALESCE(NOT COALESCE(d.scope_disputed, FALSE) AND CAST(rows_evaluated - rows_failed AS DOUBLE) * 100.0E0 / rows_evaluated >= 100.0E0 - e.tolerance_pct - 1e-9, FALSE) AS within_tolerance
              FROM (SELECT k.run_id, a.cde_id, MAX(k.run_ts) AS run_ts, COUNT(*) AS checks_raised, SUM(rows_scanned)::BIGINT AS rows_evaluated, SUM(violation_count)::BIGINT AS rows_failed FROM check_run k JOIN rule_element a ON a.rule_id = k.rule_id WHERE k.status IN ('pass', 'breach') GROUP BY 1, 2) s
              JOIN elements_now e ON e.cde_id = s.cde_id LEFT JOIN (SELECT cde_id, bool_or(coverage_gap = 'scope_mismatch') AS scope_disputed FROM cov GROUP BY 1) d ON d.cde_id = s.cde_id""",
    "ev": """SELECT cohort_id, MAX(CASE WHEN event_type = 'reviewed' THEN event_ts END) AS reviewed_ts, MAX(CASE WHEN event_type = 'executed' THEN event_ts END) AS executed_ts, MAX(CASE WHEN event_type = 'verified' THEN event_ts END) AS verified_ts,
                COUNT(DISTINCT CASE WHEN event_type = 'approved' THEN actor_identity END) AS distinct_approvers, COUNT(*) FILTER (event_type = 'reopened') AS reopen_count,
                arg_max_null(decision, CASE WHEN event_type = 'reviewed' THEN event_seq END) AS latest_decision, arg_max_null(verification_passed, CASE WHEN event_type = 'verified' THEN event_seq END) AS passed,
                arg_max_null(approach_type_taken, CASE WHEN event_type = 'executed' THEN event_seq END) AS taken, arg_max_null(event_type, event_seq) AS last_event
              FROM disposition GROUP BY 1""",
    "state": """SELECT c.*, ev.* EXCLUDE (cohort_id), CASE WHEN c.severity = 'P1_block' THEN 2 ELSE 1 END AS approvals_required,
                CASE WHEN ev.cohort_id IS NULL THEN 'awaiting_triage' WHEN passed THEN 'closed_verified' WHEN reopen_count > 0 AND last_event IN ('reopened', 'verified') THEN 'reopened' WHEN latest_decision = 'rejected' THEN 'closed_rejected'
                     WHEN latest_decision = 'no_action' THEN 'closed_no_action' WHEN latest_decision = 'deferred' THEN 'deferred' WHEN executed_ts IS NOT NULL THEN 'awaiting_verification'
                     WHEN distinct_approvers >= CASE WHEN c.severity = 'P1_block' THEN 2 ELSE 1 END THEN 'approved_awaiting_execution' WHEN latest_decision = 'accepted' THEN 'awaiting_approval' ELSE 'awaiting_review' END AS lifecycle_state,
                CASE WHEN taken IS NOT NULL THEN taken = recommended_approach_type END AS recommendation_followed,
                CASE WHEN passed THEN CAST(floor(epoch(verified_ts - raised_ts)) AS BIGINT) / 86400.0E0 END AS mttr_days
              FROM cohort c LEFT JOIN ev ON ev.cohort_id = c.cohort_id""",
    "members": "SELECT DISTINCT cohort_id, rule_id FROM (SELECT cohort_id, rule_a AS rule_id FROM cohort UNION ALL SELECT cohort_id, rule_b FROM cohort)",
    "integrity": """SELECT cohort_id, 'insufficient_distinct_approvers' AS finding FROM cohort JOIN disposition d USING (cohort_id) WHERE d.event_type = 'approved' GROUP BY cohort_id, severity HAVING COUNT(DISTINCT actor_identity) < CASE WHEN severity = 'P1_block' THEN 2 ELSE 1 END
              UNION ALL SELECT DISTINCT cohort_id, 'executed_without_approval' FROM disposition d WHERE event_type = 'executed' AND NOT EXISTS (SELECT 1 FROM disposition a WHERE a.cohort_id = d.cohort_id AND a.event_type = 'approved' AND a.event_seq < d.event_seq)
              UNION ALL SELECT cohort_id, 'identity_not_from_platform' FROM disposition WHERE event_type IN ('reviewed', 'approved', 'executed') AND (actor_source <> 'obo_user' OR actor_identity IS NULL)
              UNION ALL SELECT cohort_id, 'missing_recommended_event' FROM cohort WHERE cohort_id NOT IN (SELECT cohort_id FROM disposition WHERE event_type = 'recommended')""",
    "sched": f"SELECT run_id, run_ts, run_day, checks, run_ts = MAX(run_ts) OVER () AS is_latest FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_day ORDER BY run_ts DESC, run_id) AS n FROM (SELECT run_id, MAX(run_ts) AS run_ts, COUNT(*) AS checks, {TZ.format('MAX(run_ts)')} AS run_day FROM check_run GROUP BY 1 HAVING COUNT(*) FILTER (status <> 'skipped') > 0)) WHERE n = 1",
    "weekly": "SELECT * EXCLUDE (n) FROM (SELECT *, CAST(date_trunc('week', run_day) AS DATE) AS run_week, ROW_NUMBER() OVER (PARTITION BY date_trunc('week', run_day) ORDER BY run_ts DESC, run_id) AS n FROM sched) WHERE n = 1",
    "last_run": "SELECT k.* FROM check_run k JOIN sched s ON s.run_id = k.run_id AND s.is_latest",
    "failing_now": "SELECT * FROM check_run WHERE status = 'breach' AND run_id = (SELECT run_id FROM check_run WHERE status <> 'skipped' ORDER BY run_ts DESC, run_id DESC LIMIT 1)",
    "hist": "SELECT k.rule_id, f.first_breach, COUNT(*) FILTER (k.status = 'pass' AND k.run_ts < f.first_breach) AS passes_before, COUNT(*) AS runs FROM check_run k JOIN (SELECT rule_id, MIN(run_ts) AS first_breach FROM check_run WHERE status = 'breach' GROUP BY 1) f ON f.rule_id = k.rule_id WHERE k.rule_id IN (SELECT rule_id FROM failing_now) GROUP BY 1, 2",
    "on_key": "SELECT DISTINCT k.rule_id FROM check_run k JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY table_version DESC) AS n FROM monitored_table) WHERE n = 1) m ON m.target_table = k.target_table AND list_contains(string_split(m.key_columns, '|'), k.target_column) WHERE k.run_id IN (SELECT run_id FROM failing_now)",
    "usable": "SELECT rule_id, target_table, row_key, CASE WHEN rule_id IN (SELECT rule_id FROM on_key) THEN 'rule on the key column' WHEN coalesce(row_key, '') = '' OR regexp_matches(row_key, '(^[|])|([|]$)|([|][|])') THEN 'blank key' ELSE 'kept' END AS outcome FROM violation_sample WHERE run_id IN (SELECT run_id FROM failing_now)",
    "skey": "SELECT DISTINCT rule_id, target_table, row_key FROM usable WHERE outcome = 'kept'",
    "sized": "SELECT rule_id, COUNT(*) AS n FROM skey GROUP BY 1",
    "overlap": "SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, COUNT(*) AS shared, COUNT(*) / least(na.n, nb.n)::DOUBLE AS ratio FROM skey a JOIN skey b ON a.target_table = b.target_table AND a.row_key = b.row_key AND a.rule_id < b.rule_id JOIN sized na ON na.rule_id = a.rule_id JOIN sized nb ON nb.rule_id = b.rule_id GROUP BY 1, 2, na.n, nb.n HAVING COUNT(*) / least(na.n, nb.n)::DOUBLE >= 0.2",
}


def sql(text: str, more: str = "") -> str:
    """The whole query: registers, shared parts, ``more`` parts of its own, then ``text``."""
    return with_clause("WITH " + ", ".join(f"{k} AS ({v})" for k, v in SHARED.items()) + more + " " + text)


def query(name: str, text: str | None = None, more: str = ""):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(datasets.Model(Registers(spark, sf_dir)))
        if text:
            ORACLE[name] = sql(text, more)
        return function

    return register


def joined(*columns: str):
    """Arrays as text, so that both engines' values compare."""
    return [F.array_join(c, ",").alias(c) for c in columns]


# H


@query("h1_rule_registry_current", "SELECT rule_id, rule_version, status, fail_threshold_pct FROM rules_now")
def h1(m):
    return m.rules.select("rule_id", "rule_version", "status", "fail_threshold_pct")


@query("h2_cde_registry_current", "SELECT e.cde_id, e.cde_version, e.status, (SELECT COUNT(*) FROM bindings b WHERE b.cde_id = e.cde_id AND b.cde_version = e.cde_version)::INT AS n_bindings FROM elements_now e")
def h2(m):
    return m.elements.select("cde_id", "cde_version", "status", F.size("bindings").alias("n_bindings"))


@query("h3_cohort_current", "SELECT cohort_id, lifecycle_state, distinct_approvers, approvals_required, latest_decision, recommendation_followed, mttr_days FROM state")
def h3(m):
    return m.state.select("cohort_id", "lifecycle_state", "distinct_approvers", "approvals_required", "latest_decision", "recommendation_followed", "mttr_days")


@query("h4_disposition_integrity", "SELECT cohort_id, finding FROM integrity")
def h4(m):
    return reg.disposition_integrity(m.tables["cohorts"], m.tables["disposition"]).select("cohort_id", "finding")


@query("h5_cde_coverage", "SELECT cde_id, target_table, target_column, rule_count, breaching_rule_count, latest_violation_rows, never_profiled, coverage_gap FROM cov")
def h5(m):
    return m.coverage.select("cde_id", "target_table", "target_column", "rule_count", F.col("breaching_rule_count").cast("long"), "latest_violation_rows", "never_profiled", "coverage_gap")


@query("h6_coverage_summary", "SELECT COUNT(*) AS bindings, COUNT(DISTINCT cde_id) AS elements, COUNT(*) FILTER (coverage_gap = 'covered') AS covered, ROUND(CAST(COUNT(*) FILTER (coverage_gap = 'covered') AS DOUBLE) * 100.0E0 / COUNT(*), 1) AS covered_pct, COUNT(*) FILTER (coverage_gap <> 'covered') AS gaps, COUNT(*) FILTER (coverage_gap <> 'covered' AND criticality IN ('critical', 'high')) AS critical_gaps, COUNT(*) FILTER (never_profiled) AS unprofiled, COUNT(*) FILTER (unscoped > 0) AS mismatches FROM cov")
def h6(m):
    return reg.coverage_summary(m.coverage)


@query("h7_rule_elements", "SELECT cde_id, rule_id FROM rule_element")
def h7(m):
    return reg.rule_elements(m.coverage)


@query("h7_disputed_rules", "SELECT DISTINCT rule_id FROM attached WHERE expected_scope_filter IS NOT NULL AND rule_id IS NOT NULL AND scope_filter IS NULL")
def h7_disputed(m):
    return reg.disputed_rules(m.coverage)


@query("h8_element_tolerance", "SELECT run_id, cde_id, checks_raised, rows_evaluated, rows_failed, score_pct, target_pct, scope_disputed, within_tolerance FROM tol")
def h8(m):
    return m.tolerance.select("run_id", "cde_id", "checks_raised", "rows_evaluated", "rows_failed", "score_pct", "target_pct", "scope_disputed", "within_tolerance")


@query("h9_check_escalation", "SELECT b.run_id, b.rule_id, e.cde_id, t.score_pct AS element_score_pct, COALESCE(t.within_tolerance, FALSE) AS element_within_tolerance, TRUE AS escalates FROM check_run b LEFT JOIN rule_element e ON e.rule_id = b.rule_id LEFT JOIN tol t ON t.run_id = b.run_id AND t.cde_id = e.cde_id WHERE b.status = 'breach'")
def h9(m):
    return m.escalation.select("run_id", "rule_id", "cde_id", "element_score_pct", "element_within_tolerance", "escalates")


_TOLERANCE = """SELECT p.cde_id, p.proposal_id, CASE WHEN p.advice = 'keep' THEN 'no_change' WHEN p.advice = 'tighten' AND e.tolerance_pct = p.proposed_tolerance_pct THEN 'in_force' WHEN r.decision IN ('rejected', 'deferred', 'accepted') THEN r.decision ELSE 'open' END AS review_state
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cde_id ORDER BY proposed_ts DESC, proposal_id) AS n FROM tolerance_proposal) p LEFT JOIN tolerance_review r USING (proposal_id) LEFT JOIN elements_now e ON e.cde_id = p.cde_id WHERE p.n = 1"""


@query("h10_tolerance_proposal_current", _TOLERANCE)
def h10(m):
    return reg.tolerance_proposal_current(m.tables["tolerance_proposal"], m.tables["tolerance_review"], m.elements).select("cde_id", "proposal_id", "review_state")


_THRESHOLD = """SELECT p.rule_id, p.proposal_id, CASE WHEN p.basis = 'unchanged' THEN 'no_change' WHEN r.decision IN ('adopted', 'rejected', 'deferred') THEN r.decision WHEN e.fail_threshold_pct = p.proposed_threshold_pct THEN 'in_force' ELSE 'open' END AS review_state
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rule_id ORDER BY proposed_ts DESC, proposal_id) AS n FROM threshold_proposal) p LEFT JOIN threshold_review r USING (proposal_id) LEFT JOIN rules_now e ON e.rule_id = p.rule_id WHERE p.n = 1"""


@query("h11_threshold_proposal_current", _THRESHOLD)
def h11(m):
    return reg.threshold_proposal_current(m.tables["threshold_proposal"], m.tables["threshold_review"], m.rules).select("rule_id", "proposal_id", "review_state")


_MON = "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY table_version DESC) AS n FROM monitored_table) WHERE n = 1"
_OPEN = "SELECT * FROM binding_proposal p WHERE NOT EXISTS (SELECT 1 FROM binding_review r WHERE r.proposal_id = p.proposal_id) AND NOT EXISTS (SELECT 1 FROM bound b WHERE b.target_table = p.target_table AND b.target_column = p.target_column)"


def _open(m):
    return reg.binding_proposal_open(m.tables["binding_proposal"], m.tables["binding_review"], reg.binding_current(m.elements))


@query("h12_monitored_and_open", f"SELECT p.proposal_id, p.target_table, m.table_version FROM ({_OPEN}) p JOIN ({_MON}) m USING (target_table)")
def h12(m):
    return _open(m).join(reg.monitored_current(m.tables["monitored_table"]).select("target_table", "table_version"), "target_table").select("proposal_id", "target_table", "table_version")


_STATUS = f"""SELECT m.target_table, COALESCE(p.n, 0) AS proposals_open, COALESCE(b.n, 0) AS columns_bound, COALESCE(r.s, 0) AS rules_shadow, COALESCE(r.a, 0) AS rules_active, COALESCE(k.n, 0) AS runs,
    CASE WHEN COALESCE(p.n, 0) > 0 THEN '2 bindings awaiting review' WHEN COALESCE(b.n, 0) = 0 THEN '1 awaiting discovery' WHEN COALESCE(r.s, 0) + COALESCE(r.a, 0) = 0 THEN '3 awaiting rule generation' WHEN COALESCE(r.a, 0) = 0 AND COALESCE(k.n, 0) = 0 THEN '4 shadow, not yet run' WHEN COALESCE(r.a, 0) = 0 THEN '5 shadow, awaiting promotion' ELSE '6 active' END AS stage
    FROM ({_MON}) m LEFT JOIN (SELECT target_table, COUNT(*) AS n FROM ({_OPEN}) GROUP BY 1) p USING (target_table) LEFT JOIN (SELECT target_table, COUNT(DISTINCT target_column) AS n FROM bound GROUP BY 1) b USING (target_table)
    LEFT JOIN (SELECT target_table, COUNT(*) FILTER (status = 'shadow') AS s, COUNT(*) FILTER (status = 'active') AS a FROM rules_now GROUP BY 1) r USING (target_table) LEFT JOIN (SELECT target_table, COUNT(DISTINCT run_id) AS n FROM check_run GROUP BY 1) k USING (target_table) WHERE m.status = 'selected'"""


def _status(m):
    return reg.onboarding_status(m.tables["monitored_table"], _open(m), reg.binding_current(m.elements), m.rules, m.runs)


@query("h13_onboarding_status", _STATUS)
def h13(m):
    return _status(m).select("target_table", "proposals_open", "columns_bound", "rules_shadow", "rules_active", "runs", "stage")


@query("h14_onboarding_summary", f"SELECT COUNT(*) AS selected, COUNT(*) FILTER (stage IN ('2 bindings awaiting review', '5 shadow, awaiting promotion')) AS waiting, SUM(proposals_open)::BIGINT AS waiting_bindings, COUNT(*) FILTER (stage LIKE '%shadow%') AS shadow, COALESCE(SUM(rules_shadow) FILTER (stage LIKE '%shadow%'), 0)::BIGINT AS shadow_checks, COUNT(*) FILTER (stage = '6 active') AS active, (SELECT COUNT(*) FROM ({_MON}) WHERE status = 'paused') AS paused FROM ({_STATUS})")
def h14(m):
    return reg.onboarding_summary(m.tables["monitored_table"], _status(m))


@query("h15_cde_proposal_current", "SELECT p.proposal_id, CASE WHEN r.decision IS NULL THEN 'open' WHEN r.decision = 'rejected' THEN 'rejected' WHEN a.v IS NOT NULL THEN 'applied' ELSE 'approved' END AS state FROM cde_proposal p LEFT JOIN cde_review r USING (proposal_id) LEFT JOIN (SELECT regexp_extract(note, '^\\[cde_proposal ([^\\]]+)\\]', 1) AS proposal_id, MIN(cde_version) AS v FROM elements GROUP BY 1) a USING (proposal_id)")
def h15(m):
    return reg.cde_proposal_current(m.tables["cde_proposal"], m.tables["cde_review"], m.tables["elements"]).select("proposal_id", "state")


@query("h16_consistency_proposal_current", "SELECT p.proposal_id, CASE WHEN r.decision = 'rejected' THEN 'rejected' WHEN r.decision = 'approved' AND EXISTS (SELECT 1 FROM rule_registry x WHERE x.rule_id = p.rule_id AND x.note LIKE '[consistency_proposal ' || p.proposal_id || ']%') THEN 'applied' WHEN r.decision = 'approved' THEN 'approved' ELSE 'open' END AS state FROM consistency_proposal p LEFT JOIN consistency_review r USING (proposal_id)")
def h16(m):
    return reg.consistency_proposal_current(m.tables["consistency_proposal"], m.tables["consistency_review"], m.tables["rule_registry"]).select("proposal_id", "state")


@query("h17_scheduled_run", "SELECT run_id, run_day, checks, is_latest FROM sched")
def h17(m):
    return m.scheduled.select("run_id", "run_day", "checks", "is_latest")


@query("h18_cohort_for_bi", "SELECT cohort_id, severity, member_count FROM cohort")
def h18(m):
    return reg.drop_columns(m.tables["cohorts"], ["root_cause_hypothesis"]).select("cohort_id", "severity", "member_count")


_APPROVED = "SELECT DISTINCT p.cde_id, p.target_table, p.target_column FROM binding_proposal p JOIN binding_review r USING (proposal_id) WHERE r.decision = 'approved'"
_PROPOSED = "SELECT 'EL_' || CASE CAST(length(target_column) + length(target_table) + ascii(right(target_column, 1)) AS INT) % 2 WHEN 0 THEN 'click' ELSE 'error' END AS cde_id, target_table, target_column FROM (SELECT DISTINCT p.target_table, p.target_column FROM binding_proposal p JOIN binding_review r USING (proposal_id) WHERE r.decision = 'approved')"


@query("h19_apply_bindings", f"SELECT x.cde_id, e.cde_version + 1 AS cde_version, (COUNT(*) + (SELECT COUNT(*) FROM bindings b WHERE b.cde_id = x.cde_id AND b.cde_version = e.cde_version))::INT AS n_bindings FROM ({_PROPOSED}) x JOIN elements_now e ON e.cde_id = x.cde_id WHERE NOT EXISTS (SELECT 1 FROM bindings b WHERE b.cde_id = x.cde_id AND b.cde_version = e.cde_version AND b.target_table = x.target_table AND b.target_column = x.target_column) GROUP BY x.cde_id, e.cde_version")
def h19(m):
    n = F.length("target_column") + F.length("target_table") + F.ascii(F.right("target_column", F.lit(1)))
    proposals = m.tables["binding_proposal"].withColumn("cde_id", F.concat(F.lit("EL_"), F.when(n % 2 == 0, "click").otherwise("error")))
    return reg.apply_bindings(m.elements, proposals, m.tables["binding_review"]).select("cde_id", "cde_version", F.size("bindings").alias("n_bindings"))


@query("h20_unbind", "SELECT e.cde_id, e.cde_version + 1 AS cde_version, COUNT(*) FILTER (b.target_table <> 't1')::INT AS n_bindings FROM elements_now e JOIN bindings b ON b.cde_id = e.cde_id AND b.cde_version = e.cde_version GROUP BY 1, 2 HAVING COUNT(*) FILTER (b.target_table = 't1') > 0")
def h20(m):
    gone = m.runs.where("target_table = 't1'").select("target_table", F.lit("value").alias("target_column")).distinct()
    return reg.unbind(m.elements, gone).select("cde_id", "cde_version", F.size("bindings").alias("n_bindings"))


@query("h21_apply_element_changes", "SELECT 'EL_click' AS cde_id, (SELECT cde_version + 1 FROM elements_now WHERE cde_id = 'EL_click') AS cde_version, 2.5E0 AS tolerance_pct, 'registered' AS status UNION ALL SELECT 'EL_error', (SELECT cde_version + 1 FROM elements_now WHERE cde_id = 'EL_error'), (SELECT tolerance_pct FROM elements_now WHERE cde_id = 'EL_error'), 'retired' UNION ALL SELECT 'EL_new', 1, 1.0E0, 'registered'")
def h21(m):
    changes = m.rules.sparkSession.createDataFrame([("EL_click", "amend", 2.5), ("EL_error", "retire", None), ("EL_new", "register", 1.0), ("EL_view", "register", 1.0), ("EL_gone", "amend", 1.0)], "cde_id string, kind string, tolerance_pct double")
    return reg.apply_element_changes(m.elements, changes)


@query("h22_retire_rules", "SELECT rule_id, rule_version + 1 AS rule_version, 'retired' AS status FROM rules_now WHERE cde_id IN (SELECT cde_id FROM elements_now WHERE criticality = 'critical')")
def h22(m):
    return reg.retire_rules(m.rules, m.elements.where("criticality = 'critical'")).select("rule_id", "rule_version", "status")


@query("h23_shadow_evidence", "SELECT r.rule_id, COALESCE(k.n, 0) AS runs_measured, k.violations AS violation_count, k.pct AS violation_pct, CASE WHEN k.pct IS NOT NULL THEN k.pct > r.fail_threshold_pct AND COALESCE(k.violations, 0) > 0 END AS would_breach FROM rules_now r LEFT JOIN (SELECT rule_id, COUNT(DISTINCT run_id) AS n, arg_max(violation_pct, run_ts) AS pct, arg_max(violation_count, run_ts) AS violations FROM check_run WHERE rule_id NOT LIKE 'view%' GROUP BY 1) k USING (rule_id)")
def h23(m):
    """Views' rules are taken as never measured."""
    return reg.shadow_evidence(m.rules, m.runs.where("rule_id not like 'view%'")).select("rule_id", "runs_measured", "violation_count", "violation_pct", "would_breach")


@query("h24_unmeasured_tables", f"SELECT DISTINCT m.target_table FROM ({_MON}) m JOIN rules_now r ON r.target_table = m.target_table AND r.status = 'active' WHERE m.status = 'selected' AND NOT EXISTS (SELECT 1 FROM check_run k WHERE k.rule_id = r.rule_id AND k.rule_version = r.rule_version AND k.violation_count > 1000)")
def h24(m):
    waiting = m.rules.where("status = 'active'").withColumn("status", F.lit("shadow"))
    return reg.unmeasured_tables(m.tables["monitored_table"], waiting, m.runs.where("violation_count > 1000"))


@query("h25_slice_breaks", "SELECT target_table, run_id, was, slice_version FROM (SELECT *, LAG(slice_version) OVER (PARTITION BY target_table ORDER BY run_ts, run_id) AS was, ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY run_ts, run_id) AS n FROM (SELECT target_table, run_id, MAX(run_ts) AS run_ts, MAX(slice_version) AS slice_version FROM check_run GROUP BY 1, 2)) WHERE n > 1 AND was IS DISTINCT FROM slice_version")
def h25(m):
    return reg.slice_breaks(m.runs).select("target_table", "run_id", "was", "slice_version")


@query("h25_run_population", "SELECT target_table, table_rows, slice_rows, slice_version FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY run_ts DESC, result_id DESC) AS n FROM check_run WHERE violation_count % 3 <> 0) WHERE n = 1")
def h25_population(m):
    """Runs whose violations divide by three are taken to have recorded nothing."""
    known = m.runs.withColumn("table_rows", F.when(F.col("violation_count") % 3 != 0, F.col("table_rows")))
    return reg.run_population(known).drop("run_ts")


@query("h26_retire_impact", "SELECT e.cde_id, COALESCE(b.bindings, '') AS bindings, COALESCE(r.active, '') AS active, COALESCE(r.shadow, '') AS shadow, COALESCE(p.problems, '') AS problems FROM elements_now e LEFT JOIN (SELECT cde_id, cde_version, string_agg(target_table || '.' || target_column, ',' ORDER BY target_table) AS bindings FROM bindings GROUP BY 1, 2) b ON b.cde_id = e.cde_id AND b.cde_version = e.cde_version LEFT JOIN (SELECT cde_id, string_agg(rule_id, ',' ORDER BY rule_id) FILTER (status = 'active') AS active, string_agg(rule_id, ',' ORDER BY rule_id) FILTER (status = 'shadow') AS shadow FROM rules_now GROUP BY 1) r ON r.cde_id = e.cde_id LEFT JOIN (SELECT cde_id, string_agg(cohort_id, ',' ORDER BY cohort_id) AS problems FROM (SELECT DISTINCT n.cde_id, m.cohort_id FROM members m JOIN rules_now n USING (rule_id)) GROUP BY 1) p ON p.cde_id = e.cde_id")
def h26_impact(m):
    return reg.retire_impact(m.elements, m.rules, m.tables["cohorts"]).select("cde_id", *joined("bindings", "active", "shadow", "problems"))


@query("h26_over_tolerance", "SELECT r.rule_id, r.cde_id, r.fail_threshold_pct, e.tolerance_pct FROM rules_now r JOIN elements_now e USING (cde_id) WHERE r.fail_threshold_pct > e.tolerance_pct")
def h26(m):
    return reg.over_tolerance(m.rules, m.elements)


@query("h27_blended_target", "SELECT run_id, ROUND(SUM(CASE WHEN target_pct IS NOT NULL THEN rows_evaluated END * target_pct) / SUM(CASE WHEN target_pct IS NOT NULL THEN rows_evaluated END), 6) AS target_pct FROM tol GROUP BY 1")
def h27(m):
    return reg.blended_target(m.tolerance).withColumn("target_pct", F.round("target_pct", 6))


@query("h28_excluded_bindings", "SELECT target_table, target_column, cde_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_table, target_column, cde_id ORDER BY reviewed_seq DESC) AS n FROM binding_proposal JOIN binding_review USING (proposal_id)) WHERE n = 1 AND decision = 'rejected' AND starts_with(reason, '[excluded at promotion]')")
def h28(m):
    return reg.excluded_bindings(m.tables["binding_proposal"], m.tables["binding_review"])


@query("h29_next_events", "SELECT cohort_id, CASE WHEN lifecycle_state IN ('awaiting_review', 'awaiting_triage', 'reopened', 'deferred') THEN 'reviewed' WHEN lifecycle_state = 'awaiting_approval' THEN 'approved' WHEN lifecycle_state = 'approved_awaiting_execution' THEN 'executed' END AS next_event, COALESCE(distinct_approvers, 0) AS have, approvals_required AS need, COALESCE(distinct_approvers, 0) >= approvals_required AS gate_open FROM state")
def h29(m):
    return reg.next_events(m.state).drop("lifecycle_state")


_INCOMING = "SELECT cohort_id, event_seq, event_type, decision, actor_identity, CASE WHEN event_seq % 2 = 0 THEN reason END AS reason, CASE WHEN length(cohort_id) % 2 = 0 THEN CAST(event_ts AS DATE) END AS review_by_date FROM disposition WHERE event_seq <> 2 OR decision IN ('rejected', 'deferred', 'no_action')"


@query(
    "h30_validate_events",
    "SELECT cohort_id, event_seq, 'wrong author' AS fault FROM numbered WHERE event_type NOT IN ('reviewed', 'approved', 'executed') UNION ALL SELECT cohort_id, event_seq, 'decision without a reason' FROM numbered WHERE decision IN ('deferred', 'rejected') AND trim(COALESCE(reason, '')) = '' UNION ALL SELECT cohort_id, event_seq, 'deferral without a date' FROM numbered WHERE decision = 'deferred' AND review_by_date IS NULL UNION ALL SELECT cohort_id, event_seq, 'approved twice' FROM numbered WHERE event_type = 'approved' AND (before OR nth > 1)",
    f", prior AS (SELECT DISTINCT cohort_id, actor_identity FROM disposition WHERE event_seq < 4 AND event_type = 'approved'), numbered AS (SELECT i.*, p.cohort_id IS NOT NULL AS before, ROW_NUMBER() OVER (PARTITION BY i.cohort_id, i.actor_identity, i.event_type ORDER BY event_seq) AS nth FROM ({_INCOMING}) i LEFT JOIN prior p ON p.cohort_id = i.cohort_id AND p.actor_identity = i.actor_identity)",
)
def h30(m):
    d = m.tables["disposition"]
    incoming = d.where("event_seq <> 2 or decision in ('rejected', 'deferred', 'no_action')").select(
        "cohort_id", "event_seq", "event_type", "decision", "actor_identity", F.when(F.col("event_seq") % 2 == 0, F.col("reason")).alias("reason"), F.when(F.length("cohort_id") % 2 == 0, F.to_date("event_ts")).alias("review_by_date")
    )
    return reg.validate_events(incoming, d.where("event_seq < 4"))


@query("h31_next_sequence", "SELECT c.cohort_id, e.event_id AS arrival, COALESCE(t.top, 0) + ROW_NUMBER() OVER (PARTITION BY c.cohort_id ORDER BY e.event_id) AS event_seq FROM events e JOIN cohort c ON c.cohort_id = 'C' || CAST(e.user_id AS STRING) LEFT JOIN (SELECT cohort_id, MAX(event_seq) AS top FROM disposition GROUP BY 1) t ON t.cohort_id = c.cohort_id")
def h31(m):
    incoming = m.tables["events"].select(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("cohort_id"), F.col("event_id").alias("arrival")).join(m.tables["cohorts"].select("cohort_id"), "cohort_id", "left_semi")
    return reg.next_sequence(incoming, m.tables["disposition"]).select("cohort_id", "arrival", F.col("event_seq").cast("long"))


@query("h32_promote", "SELECT rule_id, rule_version + 1 AS rule_version, CASE WHEN target_table = 't2' AND target_column = 'value' THEN 'retired' ELSE 'active' END AS status FROM rules_now WHERE status = 'shadow'")
def h32(m):
    out = m.runs.where("target_table = 't2'").select("target_table", F.lit("value").alias("target_column")).distinct()
    return reg.promote(m.rules, out).select("rule_id", "rule_version", "status")


@query("h33_decommission", "SELECT rule_id, rule_version + 1 AS rule_version, 'retired' AS status FROM rules_now WHERE target_table = 't0' AND rule_id NOT IN (SELECT rule_id FROM failing_now)")
def h33(m):
    return reg.decommission(m.rules, grouping.failing(m.runs), "t0").select("rule_id", "rule_version", "status")


_PENDING = "slice_proposed_by IS NOT NULL AND COALESCE(slice_change, '') NOT IN ('approved', 'rejected')"


@query("h34_slice_state", f"SELECT target_table, table_version, slice_filter, slice_version, CASE WHEN {_PENDING} THEN slice_proposed_filter END AS slice_pending_filter, CASE WHEN {_PENDING} THEN slice_proposed_by END AS slice_pending_by FROM ({_MON})")
def h34(m):
    return reg.slice_state(m.tables["monitored_table"])


@query("h34_carry_forward", f"SELECT target_table, table_version + 1 AS table_version, 'paused' AS status, slice_filter, slice_version, CAST(NULL AS STRING) AS slice_change, CASE WHEN {_PENDING} THEN slice_proposed_by END AS slice_proposed_by FROM ({_MON})")
def h34_carry(m):
    return reg.carry_forward(m.tables["monitored_table"], "paused").select("target_table", "table_version", "status", "slice_filter", "slice_version", "slice_change", "slice_proposed_by")


# G


@query("g1_latest_active_run", "SELECT run_id FROM check_run WHERE status <> 'skipped' ORDER BY run_ts DESC, run_id DESC LIMIT 1")
def g1(m):
    return grouping.latest_active_run(m.runs)


@query("g2_failing", "SELECT rule_id, violation_count FROM failing_now")
def g2(m):
    return grouping.failing(m.runs).select("rule_id", "violation_count")


@query("g3_breach_history", "SELECT rule_id, first_breach, passes_before, runs, CASE WHEN passes_before > 0 THEN 'regression' ELSE 'chronic' END AS kind FROM hist")
def g3(m):
    return grouping.breach_history(m.runs)


def _usable(m):
    verdicts = metrics.on_run(m.runs, grouping.latest_active_run(m.runs))
    return grouping.usable_samples(m.tables["violation_sample"], verdicts, m.tables["row_keys"])


@query("g4_shared_rows", "SELECT rule_a, rule_b, shared, ratio FROM overlap")
def g4(m):
    """At a fifth of the smaller sample, so that a small run has pairs."""
    return grouping.shared_rows(_usable(m), 0.2)


@query("g5_dropped_samples", "SELECT outcome, COUNT(*) AS rows, COUNT(DISTINCT (rule_id, row_key)) AS records, COUNT(DISTINCT rule_id) AS rules FROM usable GROUP BY 1")
def g5(m):
    return grouping.dropped_samples(_usable(m))


def _history_edges(m):
    history = grouping.breach_history(m.runs)
    return history, grouping.problem_edges(history, grouping.shared_rows(_usable(m), 0.2))


_GROUPS = """, days AS (SELECT day, MIN(rule_id) AS first, COUNT(*) AS n FROM (SELECT rule_id, CAST(first_breach AS DATE) AS day FROM hist WHERE passes_before > 0) GROUP BY 1 HAVING COUNT(*) > 1),
    edge AS (SELECT d.first AS a, h.rule_id AS b, 'co-movement: all ' || CAST(d.n AS STRING) || ' were clean and first breached on ' || CAST(d.day AS STRING) AS reason FROM hist h JOIN days d ON d.day = CAST(h.first_breach AS DATE) WHERE h.passes_before > 0 AND h.rule_id <> d.first
        UNION ALL SELECT rule_a, rule_b, 'shared rows: ' || rule_a || ' and ' || rule_b || ' fail on ' || CAST(shared AS STRING) || ' of the same records (' || CAST(CAST(floor(ratio * 100) AS BIGINT) AS STRING) || '% of the smaller sample)' FROM overlap WHERE rule_a IN (SELECT rule_id FROM hist) AND rule_b IN (SELECT rule_id FROM hist)),
    both_ways AS (SELECT a AS x, b AS y FROM edge UNION SELECT b, a FROM edge), reach(x, y) AS (SELECT rule_id, rule_id FROM hist UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y),
    grp AS (SELECT x AS rule_id, MIN(y) AS problem FROM reach GROUP BY 1), size AS (SELECT problem, COUNT(*) AS n, COUNT(DISTINCT CAST(first_breach AS DATE)) AS days, MIN(CAST(first_breach AS DATE)) AS day FROM grp JOIN hist USING (rule_id) GROUP BY 1),
    why AS (SELECT problem, string_agg(reason, '; ' ORDER BY reason) AS why FROM (SELECT DISTINCT g.problem, e.reason FROM edge e JOIN grp g ON g.rule_id = e.a) GROUP BY 1)"""


@query("g6_form_groups", """SELECT g.rule_id, g.problem, CASE WHEN s.n > 1 AND s.days = 1 THEN CAST(s.day AS STRING) ELSE g.problem END AS group_key,
    CASE WHEN s.n > 1 THEN w.why WHEN h.passes_before = 0 THEN 'not grouped - this check stands alone. It has never passed in ' || CAST(h.runs AS STRING) || ' runs' ELSE 'not grouped - this check first breached on ' || CAST(CAST(h.first_breach AS DATE) AS STRING) || ' and no other check broke on that date' END AS basis
    FROM grp g JOIN hist h USING (rule_id) JOIN size s USING (problem) LEFT JOIN why w USING (problem)""", _GROUPS)
def g6(m):
    return grouping.form_groups(*_history_edges(m))


@query("g6_extended", "SELECT rule_id AS node, problem AS component FROM grp WHERE rule_id IN (SELECT x FROM both_ways)", _GROUPS)
def g6_extended(m):
    """The same components from a state that the edges went into in two batches: first those of days, then those of records."""
    _, edges = _history_edges(m)
    first = edges.where("reason like 'co-movement%'")
    return grouping.extended(grouping.connected(first), edges.where("reason not like 'co-movement%'"))


@query("g7_prior_problems", "SELECT s.cohort_id, s.lifecycle_state, m.rule_id FROM state s JOIN members m USING (cohort_id) WHERE m.rule_id IN (SELECT rule_id FROM failing_now)")
def g7(m):
    return grouping.prior_problems(grouping.failing(m.runs), m.state).select("cohort_id", "lifecycle_state", "rule_id")


_LABEL = "event_type || CASE WHEN trim(coalesce(decision, '')) <> '' THEN ' (' || decision || ')' ELSE '' END || CASE WHEN event_type = 'verified' THEN CASE WHEN verification_passed THEN ' PASSED' ELSE ' FAILED' END ELSE '' END"


@query("g8_event_chain", f"SELECT cohort_id, string_agg({_LABEL}, ' > ' ORDER BY event_seq) AS chain FROM disposition GROUP BY 1")
def g8(m):
    return grouping.event_chain(m.tables["disposition"])


@query("g8_steward_notes", f"SELECT cohort_id, event_seq, CAST(event_ts AS DATE) AS day, {_LABEL} AS event, actor_identity AS who, reason FROM disposition WHERE trim(coalesce(reason, '')) <> ''")
def g8_notes(m):
    return grouping.steward_notes(m.tables["disposition"])


@query("g9_is_recurrence", "SELECT f.rule_id, COALESCE(bool_or(date_diff('day', s.verified_ts, f.run_ts) BETWEEN 0 AND 30), FALSE) AS is_recurrence FROM failing_now f LEFT JOIN (members m JOIN state s ON s.cohort_id = m.cohort_id AND s.lifecycle_state = 'closed_verified') ON m.rule_id = f.rule_id GROUP BY 1")
def g9(m):
    return grouping.recurrences(grouping.failing(m.runs), m.state)


_PROBLEM = "SELECT target_table AS problem, rule_id FROM failing_now"


def _problems(m):
    failing = grouping.failing(m.runs)
    return grouping.problem_rollup(failing.select("rule_id", F.col("target_table").alias("problem")), failing)


@query("g10_problem_rollup", "SELECT target_table AS problem, CASE WHEN COUNT(DISTINCT business_domain) = 1 THEN MIN(business_domain) ELSE 'mixed: ' || array_to_string(list_sort(list(DISTINCT business_domain)), ', ') END AS business_domain, COUNT(*) AS member_count, SUM(violation_count)::BIGINT AS total_violation_rows, MIN(severity) AS severity, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS member_rule_ids FROM failing_now GROUP BY 1")
def g10(m):
    return _problems(m).select("problem", "business_domain", "member_count", "total_violation_rows", "severity", *joined("member_rule_ids"))


@query("g11_playbook_candidates", "SELECT r.rule_id, p.playbook_id, CASE WHEN p.rule_id = r.rule_id THEN 'rule' ELSE 'type' END AS by FROM rules_now r JOIN playbook p ON p.rule_id = r.rule_id OR (p.rule_id IS NULL AND p.rule_type = r.rule_type)")
def g11(m):
    return grouping.playbook_candidates(m.rules, m.tables["playbook"])


@query("g12_element_context", "SELECT DISTINCT f.target_table AS problem, a.cde_id, a.target_table, a.target_column, c.coverage_gap FROM failing_now f JOIN attached a ON a.rule_id = f.rule_id JOIN cov c ON c.cde_id = a.cde_id AND c.target_table = a.target_table AND c.target_column = a.target_column")
def g12(m):
    return grouping.element_context(_problems(m), m.coverage)


_RADIUS = "SELECT f.problem, list_sort(list(DISTINCT l.target_table)) AS fed FROM (SELECT DISTINCT target_table AS problem FROM failing_now) f JOIN lineage l ON l.source_table = f.problem WHERE l.seen_day BETWEEN DATE '2024-01-30' - 90 AND DATE '2024-01-30' GROUP BY 1"


def _day():
    return F.lit("2024-01-30").cast("date")


@query("g14_blast_radius", f"SELECT problem, array_to_string(fed, ',') AS blast_radius FROM ({_RADIUS})")
def g14(m):
    return grouping.blast_radius(_problems(m), m.tables["lineage"], _day()).select("problem", *joined("blast_radius"))


@query("g13_rank_score", f"SELECT f.target_table AS problem, (CASE MIN(severity) WHEN 'P1_block' THEN 100 WHEN 'P2_alert' THEN 50 ELSE 20 END + 3 * COUNT(*) + 5 * COALESCE(MAX(len(r.fed)), 0))::BIGINT AS rank_score FROM failing_now f LEFT JOIN ({_RADIUS}) r ON r.problem = f.target_table GROUP BY 1")
def g13(m):
    p = _problems(m)
    return grouping.rank_score(p, grouping.blast_radius(p, m.tables["lineage"], _day())).select("problem", "rank_score")


@query("g15_problem_id", "SELECT DISTINCT target_table AS problem, sha256(target_table || '|' || target_table) AS problem_id FROM failing_now")
def g15(m):
    return grouping.problem_id(_problems(m)).select("problem", "problem_id")


@query("g16_live_problems", "SELECT f.rule_id, arg_max(c.cohort_id, c.raised_ts) AS cohort_id FROM failing_now f JOIN members m ON m.rule_id = f.rule_id JOIN cohort c ON c.cohort_id = m.cohort_id GROUP BY 1")
def g16(m):
    return grouping.live_problems(grouping.failing(m.runs), m.tables["cohorts"])


@query("g17_playbook_usage", "SELECT p.playbook_id, COUNT(d.cohort_id) AS use_count, MAX(d.event_ts) AS last_used FROM playbook p LEFT JOIN disposition d ON d.playbook_id = p.playbook_id AND d.event_type = 'executed' GROUP BY 1")
def g17(m):
    return grouping.playbook_usage(m.tables["playbook"], m.tables["disposition"]).select("playbook_id", "use_count", "last_used")


_GAP = "CASE {} WHEN 'no_rule' THEN 1 WHEN 'scope_mismatch' THEN 2 WHEN 'unvalidated' THEN 3 ELSE 4 END"


@query("g18_problem_elements", f"SELECT f.target_table AS problem, a.cde_id, arg_min(c.coverage_gap, {_GAP.format('c.coverage_gap')}) AS worst_gap FROM failing_now f JOIN attached a ON a.rule_id = f.rule_id JOIN cov c ON c.cde_id = a.cde_id AND c.target_table = a.target_table AND c.target_column = a.target_column GROUP BY 1, 2")
def g18(m):
    return grouping.problem_elements(_problems(m), m.coverage)


# J


_FIGURES = """COUNT(*) FILTER (status IN ('pass', 'breach')) AS rules_raised, COUNT(*) FILTER (status = 'breach') AS rules_breaching, COUNT(*) FILTER (status NOT IN ('pass', 'breach')) AS rules_skipped, 100.0E0 * COUNT(*) FILTER (status = 'pass') / NULLIF(COUNT(*) FILTER (status IN ('pass', 'breach')), 0) AS pass_rate_pct, COALESCE(SUM(violation_count) FILTER (status = 'breach'), 0)::BIGINT AS violations, COUNT(*) FILTER (status = 'breach' AND severity = 'P1_block') AS p1_breaching"""


@query("j1_detection_summary", f"SELECT {_FIGURES}, MAX(violation_pct) AS worst_rate_pct, COUNT(*) AS rules_run, COUNT(*) FILTER (status = 'pass') AS rules_passing, COUNT(DISTINCT target_table) AS tables, COUNT(DISTINCT target_column) AS columns, (SELECT SUM(n)::BIGINT FROM (SELECT MAX(rows_scanned) AS n FROM last_run GROUP BY target_table)) AS rows_scanned FROM last_run")
def j1(m):
    return metrics.detection_summary(m.latest)


_HELD = "SELECT s.* FROM violation_sample s WHERE (s.run_id, s.rule_id) IN (SELECT (run_id, rule_id) FROM last_run WHERE status = 'breach')"


@query("j2_records_affected", f"SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT target_table, row_key FROM ({_HELD}))) AS floor, COUNT(*) AS checks, COALESCE(string_agg(b.rule_id, ',' ORDER BY b.rule_id) FILTER (COALESCE(k.n, 0) < b.violation_count), '') AS truncated, COUNT(*) FILTER (COALESCE(k.n, 0) < b.violation_count) = 0 AS exact FROM last_run b LEFT JOIN (SELECT rule_id, COUNT(DISTINCT row_key) AS n FROM ({_HELD}) GROUP BY 1) k ON k.rule_id = b.rule_id WHERE b.status = 'breach'")
def j2(m):
    return metrics.records_affected_floor(m.latest, m.tables["violation_sample"]).select("floor", "checks", *joined("truncated"), "exact")


@query("j2_records_by_table", f"SELECT target_table, COUNT(DISTINCT row_key) AS floor FROM ({_HELD}) GROUP BY 1")
def j2_by_table(m):
    return metrics.records_by_table(m.latest, m.tables["violation_sample"])


@query("j3_quality_by", f"SELECT target_table, rules_raised, rules_breaching, ROUND(COALESCE(pass_rate_pct, 0), 1) AS pass_rate_pct, violations, p1_breaching, ROUND(worst, 2) AS worst_rate_pct FROM (SELECT target_table, {_FIGURES}, MAX(violation_pct) AS worst FROM last_run GROUP BY 1)")
def j3(m):
    return metrics.quality_by(m.latest, "target_table")


@query("j4_worst_rules", "SELECT rule_id, violation_count FROM last_run WHERE status = 'breach' ORDER BY violation_count DESC, rule_id LIMIT 10")
def j4(m):
    return metrics.worst_rules(m.latest).select("rule_id", "violation_count")


@query("j5_table_insights", f"SELECT a.*, w.rule_id AS worst_rule, COALESCE(w.violation_pct, 0) AS worst_rate_pct FROM (SELECT target_table, {_FIGURES}, MAX(rows_scanned) AS rows, COUNT(DISTINCT target_column) AS columns_checked, COUNT(DISTINCT target_column) FILTER (status = 'breach') AS columns_failing FROM last_run GROUP BY 1) a LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY violation_count DESC, rule_id) AS n FROM last_run WHERE status = 'breach') w ON w.target_table = a.target_table AND w.n = 1")
def j5(m):
    return metrics.table_insights(m.latest)


@query("j6_newly_failing", "SELECT k.rule_id, MIN(k.run_ts) AS turned_ts, MAX(c.failing) AS failing_rows, MAX(c.clean) AS clean_before FROM k JOIN c ON c.rule_id = k.rule_id AND c.target_table = k.target_table WHERE c.last = 'breach' AND k.status = 'breach' AND k.run_ts > c.clean GROUP BY k.rule_id HAVING MIN(k.run_ts) >= MAX(k.newest) - INTERVAL 14 DAY", ", k AS (SELECT *, MAX(run_ts) OVER (PARTITION BY target_table) AS newest FROM check_run), c AS (SELECT target_table, rule_id, MAX(run_ts) FILTER (status <> 'breach') AS clean, arg_max(status, run_ts) AS last, arg_max(violation_count, run_ts) AS failing FROM k GROUP BY 1, 2)")
def j6(m):
    return metrics.newly_failing(m.runs)


_SINCE = "SELECT k.rule_id, MIN(k.run_ts) AS failing_since FROM check_run k LEFT JOIN (SELECT rule_id, MAX(run_ts) AS ok FROM check_run WHERE status <> 'breach' GROUP BY 1) c USING (rule_id) WHERE k.status = 'breach' AND (c.ok IS NULL OR k.run_ts > c.ok) GROUP BY 1"


@query("j7_failing_since", _SINCE)
def j7(m):
    return metrics.failing_since(m.runs)


@query("j8_run_index", "SELECT run_id, COUNT(*) FILTER (status IN ('pass', 'breach')) AS checks, COUNT(*) FILTER (status = 'breach') AS failing, COUNT(*) FILTER (status = 'breach' AND severity = 'P1_block') AS p1_failing, CAST(SUM(rows_scanned - violation_count) FILTER (status IN ('pass', 'breach')) AS DOUBLE) * 100.0E0 / SUM(rows_scanned) FILTER (status IN ('pass', 'breach')) AS score_pct FROM check_run GROUP BY 1")
def j8(m):
    return metrics.run_index(m.runs).drop("run_ts")


@query("j9_compression", "SELECT COUNT(DISTINCT f.rule_id) AS breaches, COUNT(DISTINCT g.cohort_id) AS problems, CAST(COUNT(DISTINCT f.rule_id) AS DOUBLE) / NULLIF(COUNT(DISTINCT g.cohort_id), 0) AS compression FROM failing_now f LEFT JOIN (SELECT m.rule_id, arg_max(c.cohort_id, c.raised_ts) AS cohort_id FROM members m JOIN cohort c USING (cohort_id) GROUP BY 1) g ON g.rule_id = f.rule_id")
def j9(m):
    f = grouping.failing(m.runs)
    return metrics.compression(grouping.live_problems(f, m.tables["cohorts"]), f)


@query("j10_disposition_coverage", "SELECT COUNT(*) AS problems, COUNT(*) FILTER (human) AS decided, 100.0E0 * COUNT(*) FILTER (human) / NULLIF(COUNT(*), 0) AS coverage_pct, 100.0E0 * COUNT(*) FILTER (human) / NULLIF(COUNT(*), 0) >= 90 AS met FROM (SELECT cohort_id IN (SELECT cohort_id FROM disposition WHERE event_type <> 'recommended') AS human FROM cohort)")
def j10(m):
    return metrics.disposition_coverage(m.tables["cohorts"], m.tables["disposition"])


@query("j11_recommendation_acceptance", "SELECT executed, followed, 100.0E0 * followed / NULLIF(executed, 0) AS acceptance_pct, 100.0E0 * followed / NULLIF(executed, 0) >= 50 AS met FROM (SELECT COUNT(recommendation_followed) AS executed, COUNT(*) FILTER (recommendation_followed) AS followed FROM state)")
def j11(m):
    return metrics.recommendation_acceptance(m.state)


@query("j12_outcomes", "SELECT *, mttr_days < target_days AS mttr_met, closure_rate_pct >= 75 AS closure_met, recurrence_pct < 10 AS recurrence_met FROM (SELECT severity, COUNT(*) AS problems, COUNT(*) FILTER (lifecycle_state = 'closed_verified') AS closed_verified, 100.0E0 * COUNT(*) FILTER (lifecycle_state = 'closed_verified') / COUNT(*) AS closure_rate_pct, COUNT(mttr_days) AS fixed, ROUND(AVG(mttr_days), 6) AS mttr_days, COUNT(*) FILTER (is_recurrence) AS recurrences, 100.0E0 * COUNT(*) FILTER (is_recurrence) / COUNT(*) AS recurrence_pct, CASE severity WHEN 'P1_block' THEN 5.0E0 WHEN 'P2_alert' THEN 15.0E0 END AS target_days FROM (SELECT * FROM state UNION ALL SELECT * REPLACE ('all' AS severity) FROM state) GROUP BY 1)")
def j12(m):
    return metrics.outcome_metrics(m.state).withColumn("mttr_days", F.round("mttr_days", 6))


@query("j13_breakdown", "SELECT business_domain, COUNT(*) AS problems, COUNT(*) FILTER (lifecycle_state IN ('awaiting_review', 'awaiting_approval', 'approved_awaiting_execution', 'awaiting_verification', 'reopened', 'awaiting_triage')) AS open, COUNT(*) FILTER (lifecycle_state = 'closed_verified') AS closed_verified, ROUND(100.0E0 * COUNT(*) FILTER (lifecycle_state = 'closed_verified') / COUNT(*), 1) AS closure_rate_pct, ROUND(AVG(mttr_days), 2) AS mttr_days, COUNT(*) FILTER (is_recurrence) AS recurrences, SUM(total_violation_rows)::BIGINT AS violation_rows FROM state GROUP BY 1")
def j13(m):
    return metrics.breakdown(m.state, "business_domain")


@query("j14_triage_funnel", "SELECT 0::INT AS step, '01 recommended' AS stage, COUNT(*) AS problems FROM state UNION ALL SELECT 1::INT, '02 reviewed', COUNT(latest_decision) FROM state UNION ALL SELECT 2::INT, '03 approved', COUNT(*) FILTER (distinct_approvers > 0) FROM state UNION ALL SELECT 3::INT, '04 executed (claimed)', COUNT(executed_ts) FROM state UNION ALL SELECT 4::INT, '05 verification attempted', COUNT(verified_ts) FROM state UNION ALL SELECT 5::INT, 'closed verified', COUNT(*) FILTER (lifecycle_state = 'closed_verified') FROM state")
def j14(m):
    return metrics.triage_funnel(m.state)


@query("j15_history_cohorts", "SELECT cohort_id FROM (SELECT DISTINCT cohort_id, rule_id FROM (SELECT cohort_id, rule_a AS rule_id FROM cohort UNION ALL SELECT cohort_id, rule_b FROM cohort)) LEFT JOIN r USING (rule_id) GROUP BY 1 HAVING COUNT(*) = COUNT(*) FILTER (rule_id IN (SELECT rule_id FROM r))", ", r AS (SELECT rule_id FROM (SELECT rule_id, status, rule_version FROM rule_registry UNION ALL SELECT DISTINCT rule_id, 'retired', 3 FROM rule_registry WHERE rule_id LIKE 'view%' OR rule_id LIKE 'click_%') GROUP BY 1 HAVING arg_max(status, rule_version) = 'retired')")
def j15(m):
    now = m.tables["rule_registry"]
    gone = now.where("rule_id like 'view%' or rule_id like 'click_%'").where("rule_version = 2").withColumns({"rule_version": F.lit(3), "status": F.lit("retired")})
    return metrics.history_cohorts(m.tables["cohorts"], now.unionByName(gone))


@query("j16_last_per_day", f"SELECT rule_id, result_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rule_id, {TZ.format('run_ts')} ORDER BY run_ts DESC, result_id DESC) AS n FROM check_run) WHERE n = 1")
def j16(m):
    return metrics.last_per_day(m.runs, "rule_id").select("rule_id", "result_id")


@query("j17_element_scores", "SELECT e.cde_id, SUM(rows_scanned)::BIGINT AS rows_evaluated, SUM(violation_count)::BIGINT AS rows_failed, CAST(SUM(rows_scanned) - SUM(violation_count) AS DOUBLE) * 100.0E0 / NULLIF(SUM(rows_scanned), 0) AS score_pct FROM last_run k JOIN rule_element e USING (rule_id) WHERE status IN ('pass', 'breach') GROUP BY 1")
def j17(m):
    return metrics.element_scores(m.latest, m.coverage)


@query("j18_table_overview", """SELECT t.*, o.owner_group, h.points, h.change_words FROM (SELECT target_table, COUNT(*) AS checks, COUNT(*) FILTER (status = 'pass') AS passing, CASE WHEN COUNT(*) FILTER (status = 'breach' AND severity = 'P1_block') > 0 THEN 'Critical' WHEN COUNT(*) FILTER (status = 'breach') > 0 THEN 'Needs attention' ELSE 'Healthy' END AS status,
        COALESCE(SUM(violation_count) FILTER (status = 'breach'), 0)::BIGINT AS findings, MAX(rows_scanned) AS rows FROM last_run WHERE status IN ('pass', 'breach') GROUP BY 1) t
    LEFT JOIN (SELECT target_table, owner_group FROM (SELECT target_table, owner_group, ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY COUNT(*) DESC, owner_group) AS n FROM last_run WHERE status IN ('pass', 'breach') GROUP BY 1, 2) WHERE n = 1) o USING (target_table)
    LEFT JOIN (SELECT target_table, COUNT(*) AS points, CASE WHEN COUNT(*) < 2 THEN 'No prior run' WHEN abs(MAX(s) FILTER (n = 1) - MAX(s) FILTER (n = 2)) < 0.05 THEN 'No change' ELSE CASE WHEN MAX(s) FILTER (n = 1) > MAX(s) FILTER (n = 2) THEN '↑ ' ELSE '↓ ' END || printf('%.1f pts', abs(MAX(s) FILTER (n = 1) - MAX(s) FILTER (n = 2))) END AS change_words
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY ts DESC) AS n, MAX(ts) OVER (PARTITION BY target_table) AS top FROM (SELECT target_table, run_id, MAX(run_ts) AS ts, 100.0E0 * COUNT(*) FILTER (status = 'pass') / COUNT(*) AS s FROM check_run WHERE status IN ('pass', 'breach') GROUP BY 1, 2)) WHERE ts >= top - INTERVAL 30 DAY GROUP BY 1) h USING (target_table)""")
def j18(m):
    made = metrics.table_overview(m.runs, m.scheduled.where("is_latest"))
    return made.select("target_table", "checks", "passing", "status", "findings", "rows", "owner_group", F.size("history").cast("long").alias("points"), "change_words")


@query("j19_table_rules", "SELECT r.rule_id, k.status AS verdict, CASE k.status WHEN 'breach' THEN 0 WHEN 'error' THEN 1 WHEN 'pass' THEN 2 ELSE 3 END AS place FROM rules_now r LEFT JOIN last_run k USING (rule_id) WHERE r.target_table = 't1'")
def j19(m):
    return metrics.table_rules(m.rules, m.latest, "t1").select("rule_id", "verdict", "place")


@query("j20_proposal_counts", f"SELECT review_state, COUNT(*) AS proposals FROM ({_THRESHOLD}) GROUP BY 1")
def j20(m):
    return metrics.proposal_counts(reg.threshold_proposal_current(m.tables["threshold_proposal"], m.tables["threshold_review"], m.rules))


_CROSS = "SELECT r.rule_id, r.target_table || '|users' AS relationship_key, r.target_table || ' → users' AS relationship, COALESCE(k.runs, 0) AS runs, CASE WHEN r.status = 'shadow' THEN 'Shadow' WHEN k.rule_id IS NULL THEN 'Not run' WHEN k.pct > r.fail_threshold_pct THEN 'Failing' ELSE 'Passing' END AS state, 100 - k.pct AS rate_pct FROM rules_now r LEFT JOIN (SELECT rule_id, arg_max(violation_pct, run_ts) AS pct, COUNT(*) AS runs FROM check_run WHERE status <> 'error' GROUP BY 1) k USING (rule_id) WHERE r.status IN ('active', 'shadow') AND r.join_sql IS NOT NULL"


@query("j21_cross_table_checks", f"SELECT rule_id, relationship, runs, state, ROUND(rate_pct, 6) AS rate_pct FROM ({_CROSS})")
def j21(m):
    return metrics.cross_table_checks(m.rules, m.runs).select("rule_id", "relationship", "runs", "state", F.round("rate_pct", 6).alias("rate_pct"))


@query("j21_relationships", f"SELECT relationship_key, MIN(relationship) AS relationship, COUNT(*) AS checks, COUNT(*) FILTER (state = 'Failing') AS failing, COUNT(*) FILTER (state = 'Not run') AS not_run, COUNT(*) FILTER (state = 'Shadow') AS shadow, COUNT(*) FILTER (state = 'Passing') AS passing, 'Same value' AS kinds FROM ({_CROSS}) GROUP BY 1")
def j21_relationships(m):
    return metrics.relationships(metrics.cross_table_checks(m.rules, m.runs)).withColumn("kinds", F.array_join("kinds", ","))


@query("j22_element_history", "SELECT a.*, l.last_10 FROM (SELECT cde_id, COUNT(*) AS runs_observed, COUNT(*) FILTER (NOT within_tolerance) AS runs_outside, bool_or(scope_disputed) AS scope_disputed, ROUND(MIN(100 - score_pct), 6) AS fail_pct_min, ROUND(median(100 - score_pct), 6) AS fail_pct_median, ROUND(quantile_cont(100 - score_pct, 0.9), 6) AS fail_pct_p90, ROUND(MAX(100 - score_pct), 6) AS fail_pct_max, ROUND(arg_max(100 - score_pct, run_ts), 6) AS latest_fail_pct FROM tol WHERE score_pct IS NOT NULL GROUP BY 1) a JOIN (SELECT cde_id, string_agg(CAST(CAST(ROUND(1000 * ROUND(100 - score_pct, 3)) AS BIGINT) AS STRING), ',' ORDER BY run_ts) AS last_10 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cde_id ORDER BY run_ts DESC) AS n FROM tol WHERE score_pct IS NOT NULL) WHERE n <= 10 GROUP BY 1) l USING (cde_id)")
def j22(m):
    names = ["fail_pct_min", "fail_pct_median", "fail_pct_p90", "fail_pct_max", "latest_fail_pct"]
    last = F.array_join(F.transform("last_10", lambda x: F.round(1000 * x).cast("long").cast("string")), ",").alias("last_10")
    return metrics.element_history(m.tolerance).select("cde_id", "runs_observed", "runs_outside", "scope_disputed", *[F.round(c, 6).alias(c) for c in names], last)


@query("j22_element_checks", "SELECT r.cde_id, r.rule_id, k.status AS latest_status, k.violation_pct AS latest_violation_pct, COALESCE(k.status = 'breach' AND h.held, FALSE) AS held FROM rules_now r LEFT JOIN (SELECT * FROM check_run WHERE run_id = (SELECT run_id FROM check_run WHERE status IN ('pass', 'breach') ORDER BY run_ts DESC, run_id DESC LIMIT 1)) k USING (rule_id) LEFT JOIN (SELECT e.rule_id, t.run_id, bool_or(t.within_tolerance) AS held FROM rule_element e JOIN tol t USING (cde_id) GROUP BY 1, 2) h ON h.rule_id = r.rule_id AND h.run_id = k.run_id WHERE r.status = 'active'")
def j22_checks(m):
    """With the gate that holds back breaches of elements within tolerance."""
    gated = reg.check_escalation(m.runs, m.coverage, m.tolerance, gate=True)
    return metrics.element_checks(m.rules, m.runs, gated).select("cde_id", "rule_id", "latest_status", "latest_violation_pct", "held")


@query("j24_self_checks", "SELECT s.result_id FROM (SELECT DISTINCT result_id FROM violation_sample) s WHERE s.result_id NOT IN (SELECT result_id FROM check_run WHERE status = 'breach')")
def j24(m):
    return metrics.unresolved_members(m.tables["violation_sample"].select("result_id").distinct(), m.runs.where("status = 'breach'"))


@query("j24_duplicate_versions", "SELECT rule_id, rule_version, COUNT(*) AS n FROM (SELECT rule_id, rule_version FROM rule_registry UNION ALL SELECT rule_id, rule_version FROM rule_registry WHERE target_table = 't1') GROUP BY 1, 2 HAVING COUNT(*) > 1")
def j24_versions(m):
    now = m.tables["rule_registry"]
    return metrics.duplicate_versions(now.unionByName(now.where("target_table = 't1'")))


@query("d6_last_counts", "SELECT rule_id, string_agg(CAST(violation_count AS STRING), ',' ORDER BY run_ts) AS counts FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rule_id ORDER BY run_ts DESC) AS n FROM check_run) WHERE n <= 8 GROUP BY 1")
def d6(m):
    return metrics.last_counts(m.runs).select("rule_id", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


@query("b2_worklist", "SELECT rule_id FROM rules_now WHERE status IN ('active', 'shadow') AND cde_id IN (SELECT cde_id FROM elements_now WHERE status = 'registered')")
def b2(m):
    return run.worklist(m.rules, m.elements).select("rule_id")


@query("a8_select_tables", f"SELECT rule_id FROM rules_now WHERE target_table IN (SELECT target_table FROM ({_MON}) WHERE status = 'selected')")
def a8(m):
    return relations.select_tables(m.rules, m.tables["monitored_table"]).select("rule_id")


#: Constraints of the registers' columns that the given tables can fill.
_CHECKED = [
    ("rule_registry", "severity_enum", "severity IN ('P1_block', 'P2_alert', 'P3_monitor')"),
    ("rule_registry", "status_enum", "status IN ('shadow', 'active', 'retired')"),
    ("rule_registry", "rule_version_range", "rule_version >= 1"),
    ("check_run", "status_enum", "status IN ('pass', 'breach', 'error', 'skipped')"),
    ("check_run", "severity_enum", "severity IN ('P1_block', 'P2_alert', 'P3_monitor')"),
    ("cohort", "severity_enum", "severity IN ('P1_block', 'P2_alert', 'P3_monitor')"),
    ("cohort", "defect_location_enum", "defect_location IN ('data', 'rule', 'neither')"),
    ("cohort", "member_count_range", "member_count >= 1"),
    ("disposition", "event_type_enum", "event_type IN ('recommended', 'reviewed', 'approved', 'executed', 'verified', 'reopened')"),
    ("disposition", "actor_source_enum", "actor_source IN ('obo_user', 'service_principal', 'triage_job', 'check_runner')"),
    ("disposition", "event_seq_range", "event_seq >= 1"),
    ("disposition", "decision_enum", "decision IS NULL OR decision IN ('accepted', 'deferred', 'rejected', 'no_action')"),
    ("disposition", "reason_required", "decision IS NULL OR decision NOT IN ('deferred', 'rejected') OR (reason IS NOT NULL AND length(trim(reason)) > 0)"),
    ("disposition", "human_events_have_identity", "event_type NOT IN ('reviewed', 'approved', 'executed') OR (actor_identity IS NOT NULL AND actor_source = 'obo_user')"),
    ("threshold_proposal", "basis_enum", "basis IN ('element_tolerance', 'run_history', 'both', 'unchanged')"),
    ("threshold_proposal", "proposed_threshold_pct_range", "proposed_threshold_pct BETWEEN 0 AND 100"),
    ("threshold_proposal", "unchanged_means_unchanged", "(basis = 'unchanged') = (proposed_threshold_pct = current_threshold_pct)"),
    ("threshold_review", "decision_enum", "decision IN ('adopted', 'rejected', 'deferred')"),
    ("tolerance_proposal", "advice_enum", "advice IN ('keep', 'tighten', 'review')"),
    ("tolerance_proposal", "proposed_tolerance_pct_range", "proposed_tolerance_pct IS NULL OR proposed_tolerance_pct BETWEEN 0 AND 100"),
    ("tolerance_review", "decision_enum", "decision IN ('accepted', 'rejected', 'deferred')"),
    ("monitored_table", "status_enum", "status IN ('selected', 'paused', 'retired')"),
    ("monitored_table", "table_version_range", "table_version >= 1"),
    ("binding_review", "decision_enum", "decision IN ('approved', 'rejected')"),
    ("binding_review", "rejection_has_reason", "decision = 'approved' OR (reason IS NOT NULL AND trim(reason) <> '')"),
    ("cde_review", "decision_enum", "decision IN ('approved', 'rejected')"),
    ("consistency_review", "decision_enum", "decision IN ('approved', 'rejected')"),
    ("consistency_proposal", "rule_id_shape", "regexp_matches(rule_id, '^CS_[0-9A-F]{8}$')"),
    ("playbook", "has_target", "rule_id IS NOT NULL OR rule_type IS NOT NULL"),
]


@query("b13_register_constraints", " UNION ALL ".join(f"SELECT '{t}' AS register, '{n}' AS rule_id, COUNT(*) AS rows_scanned, COUNT(*) FILTER (NOT ({c})) AS violation_count FROM {t}" for t, n, c in _CHECKED))
def b13(m):
    """One aggregate per register."""
    parts = []
    for table in dict.fromkeys(t for t, _, _ in _CHECKED):
        wanted = {n for t, n, _ in _CHECKED if t == table}
        parts.append(run.row_level_batch(m.tables[table], [r for r in constraint_rules(table) if r.rule_id in wanted]).withColumn("register", F.lit(table)))
    return reduce(DataFrame.unionByName, parts)


@query("i6_pending_columns", """SELECT c.target_table, c.target_column FROM (SELECT DISTINCT target_table, 'c' || CAST(k AS STRING) AS target_column FROM monitored_table, range(0, 400) r(k)) c WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.target_table = c.target_table AND b.target_column = c.target_column)
    AND NOT EXISTS (SELECT 1 FROM (SELECT p.target_table, p.target_column, bool_and(COALESCE(r.decision, '') = 'rejected') AS rejected, bool_or(p.method = 'uc_tag') AS by_tag FROM binding_proposal p LEFT JOIN binding_review r USING (proposal_id) GROUP BY 1, 2) p
        WHERE p.target_table = c.target_table AND p.target_column = c.target_column AND NOT (p.rejected AND NOT p.by_tag AND EXISTS (SELECT 1 FROM column_tag t WHERE t.target_table = c.target_table AND t.target_column = c.target_column)))""")
def i6(m):
    columns = m.tables["monitored_table"].select("target_table").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(399)))).select("target_table", F.concat(F.lit("c"), F.col("k").cast("string")).alias("target_column"))
    return profiling.pending(columns, reg.binding_current(m.elements), m.tables["binding_proposal"], m.tables["binding_review"], m.tables["column_tag"])


@query("i7_evaluate_discovery", "SELECT outcome, COUNT(*) AS n FROM (SELECT CASE WHEN f.cde_id = t.cde_id THEN 'correct' WHEN f.cde_id IS NOT NULL AND t.cde_id IS NOT NULL THEN 'wrong element' WHEN f.cde_id IS NOT NULL THEN 'spurious' WHEN t.cde_id IS NOT NULL AND (f.why LIKE '%patterns%' OR f.why LIKE '%several%') THEN 'undecided' WHEN t.cde_id IS NOT NULL THEN 'missed' END AS outcome FROM discovered f LEFT JOIN (SELECT rule_id, 'EL_' || event_type AS cde_id FROM rule_base WHERE quarter <> 1 AND event_type <> 'view') t USING (rule_id)) WHERE outcome IS NOT NULL GROUP BY 1")
def i7(m):
    found = m.tables["discovered"].withColumnRenamed("rule_id", "column")
    truth = m.tables["rule_base"].where("quarter <> 1 and event_type <> 'view'").select(F.col("rule_id").alias("column"), F.concat(F.lit("EL_"), "event_type").alias("cde_id"))
    return profiling.evaluate_discovery(found, truth)


# K

_SCORED = "SELECT k.run_id, SUM(rows_scanned)::BIGINT AS rows_checked, SUM(violation_count)::BIGINT AS rows_failed FROM check_run k WHERE k.status IN ('pass', 'breach') AND k.rule_id IN (SELECT rule_id FROM rule_element) GROUP BY 1"
_RAN = "SELECT k.run_id, e.cde_id, COUNT(DISTINCT k.rule_id) AS rules_ran, COUNT(DISTINCT CASE WHEN k.status = 'breach' THEN k.rule_id END) AS rules_breaching FROM check_run k JOIN rule_element e USING (rule_id) WHERE k.status IN ('pass', 'breach') GROUP BY 1, 2"
_DIM = "CASE {} WHEN 'not_null' THEN 'Completeness' WHEN 'format' THEN 'Validity' WHEN 'consistency' THEN 'Consistency' WHEN 'uniqueness' THEN 'Uniqueness' ELSE 'Other' END"


@query("k1_quality_trend", f"SELECT w.run_id, w.run_week, s.rows_checked, s.rows_failed, ROUND(CAST(rows_checked - rows_failed AS DOUBLE) * 100.0E0 / rows_checked - LAG(CAST(rows_checked - rows_failed AS DOUBLE) * 100.0E0 / rows_checked) OVER (ORDER BY w.run_ts), 6) AS change_pts FROM weekly w JOIN ({_SCORED}) s USING (run_id)")
def k1(m):
    return datasets.quality_trend(m).select("run_id", "run_week", "rows_checked", "rows_failed", F.round("change_pts", 6).alias("change_pts"))


@query("k2_element_scores", f"SELECT t.run_id, t.cde_id, t.score_pct, COALESCE(r.rules_ran, 0) AS rules_ran, COALESCE(r.rules_breaching, 0) AS rules_breaching, CASE WHEN t.scope_disputed THEN 'Scope disputed' WHEN r.rules_breaching > 0 THEN 'Failing' ELSE 'Passing' END AS status FROM tol t JOIN weekly w USING (run_id) LEFT JOIN ({_RAN}) r ON r.run_id = t.run_id AND r.cde_id = t.cde_id")
def k2(m):
    return datasets.element_scores(m).select("run_id", "cde_id", "score_pct", "rules_ran", "rules_breaching", "status")


@query("k3_coverage", "SELECT cde_id, target_table, CASE coverage_gap WHEN 'covered' THEN 'Covered' WHEN 'unvalidated' THEN 'Not validated' WHEN 'no_rule' THEN 'No active rule' ELSE 'Scope disputed' END AS coverage FROM cov")
def k3(m):
    return datasets.coverage(m).select("cde_id", "target_table", "coverage")


@query("k4_check_latest", f"SELECT k.rule_id, {_DIM.format('r.rule_type')} AS dimension, CASE WHEN k.status = 'breach' THEN 'Breach' WHEN k.status = 'skipped' AND r.status = 'shadow' THEN 'Shadow' WHEN k.status = 'skipped' THEN 'Skipped' WHEN k.status = 'error' THEN 'Error' ELSE 'Pass' END AS health, date_diff('day', {TZ.format('f.failing_since')}, {TZ.format('k.run_ts')})::INT + 1 AS days_failing FROM last_run k JOIN rules_now r USING (rule_id) LEFT JOIN (SELECT k.rule_id, MIN(k.run_ts) AS failing_since FROM check_run k JOIN sched USING (run_id) LEFT JOIN (SELECT rule_id, MAX(k.run_ts) AS ok FROM check_run k JOIN sched USING (run_id) WHERE status <> 'breach' GROUP BY 1) c ON c.rule_id = k.rule_id WHERE k.status = 'breach' AND (c.ok IS NULL OR k.run_ts > c.ok) GROUP BY 1) f ON f.rule_id = k.rule_id")
def k4(m):
    return datasets.check_latest(m).select("rule_id", "dimension", "health", "days_failing")


@query("k5_exec_weekly", "SELECT w.run_week, COALESCE(k.breaching, 0) AS breaching, COALESCE(k.cdes_monitored, 0) AS cdes_monitored, COALESCE(n.n, 0) AS new_failures FROM (SELECT *, LAG(run_id) OVER (ORDER BY run_ts) AS prev FROM weekly) w LEFT JOIN (SELECT run_id, COUNT(DISTINCT CASE WHEN k.status = 'breach' THEN rule_id END) AS breaching, COUNT(DISTINCT CASE WHEN k.status IN ('pass', 'breach') THEN r.cde_id END) AS cdes_monitored FROM check_run k JOIN rules_now r USING (rule_id) WHERE r.cde_id IN (SELECT cde_id FROM elements_now) GROUP BY 1) k USING (run_id) LEFT JOIN (SELECT w2.run_id, COUNT(DISTINCT k.rule_id) AS n FROM (SELECT *, LAG(run_id) OVER (ORDER BY run_ts) AS prev FROM weekly) w2 JOIN check_run k ON k.run_id = w2.run_id AND k.status = 'breach' JOIN rules_now r ON r.rule_id = k.rule_id AND r.cde_id IN (SELECT cde_id FROM elements_now) WHERE w2.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM check_run p WHERE p.run_id = w2.prev AND p.rule_id = k.rule_id AND p.status = 'breach') GROUP BY 1) n ON n.run_id = w.run_id")
def k5(m):
    return datasets.exec_weekly(m).select("run_week", "breaching", "cdes_monitored", "new_failures")


@query("k6_domain_scores", f"SELECT w.run_week, e.business_domain, COUNT(*) AS cdes_monitored, COUNT(*) FILTER (r.rules_breaching > 0) AS cdes_failing, SUM(COALESCE(r.rules_ran, 0))::BIGINT AS active_rules FROM tol t JOIN weekly w USING (run_id) JOIN elements_now e ON e.cde_id = t.cde_id LEFT JOIN ({_RAN}) r ON r.run_id = t.run_id AND r.cde_id = t.cde_id GROUP BY 1, 2")
def k6(m):
    return datasets.domain_scores(m).select("run_week", "business_domain", "cdes_monitored", "cdes_failing", "active_rules")


@query("k7_table_latest", f"SELECT m.target_table, COALESCE(c.d, m.business_domain) AS business_domain, COALESCE(k.active_rules, 0) AS active_rules, k.passing, k.breaching, CASE WHEN k.breaching > 0 OR k.errors > 0 THEN 1 ELSE 0 END AS needs_attention FROM ({_MON}) m LEFT JOIN (SELECT target_table, COUNT(*) FILTER (status IN ('pass', 'breach')) AS active_rules, COUNT(*) FILTER (status = 'pass') AS passing, COUNT(*) FILTER (status = 'breach') AS breaching, COUNT(*) FILTER (status = 'error') AS errors FROM last_run GROUP BY 1) k USING (target_table) LEFT JOIN (SELECT target_table, MAX(business_domain) AS d FROM cov GROUP BY 1) c USING (target_table) WHERE m.status = 'selected'")
def k7(m):
    return datasets.table_latest(m).select("target_table", "business_domain", "active_rules", "passing", "breaching", "needs_attention")


@query("k8_check_history", "SELECT k.run_id, k.rule_id, k.status AS verdict, e.cde_name FROM check_run k JOIN sched s USING (run_id) JOIN rules_now r ON r.rule_id = k.rule_id AND r.status = 'active' LEFT JOIN elements_now e ON e.cde_id = r.cde_id WHERE k.status IN ('pass', 'breach')")
def k8(m):
    return datasets.check_history(m).select("run_id", "rule_id", "verdict", "cde_name")


@query("k9_rules", f"SELECT r.rule_id, {_DIM.format('r.rule_type')} AS dimension, k.n AS runs_measured, k.status AS verdict, ROUND(k.pct - k.was, 6) AS change_pct, CASE WHEN r.status = 'shadow' AND k.pct > r.fail_threshold_pct THEN 1 ELSE 0 END AS would_breach FROM rules_now r LEFT JOIN (SELECT * FROM (SELECT rule_id, status, violation_pct AS pct, LAG(violation_pct) OVER (PARTITION BY rule_id ORDER BY run_ts) AS was, COUNT(*) OVER (PARTITION BY rule_id) AS n, ROW_NUMBER() OVER (PARTITION BY rule_id ORDER BY run_ts DESC) AS i FROM check_run WHERE status <> 'error') WHERE i = 1) k USING (rule_id)")
def k9(m):
    return datasets.rules(m).select("rule_id", "dimension", "runs_measured", "verdict", F.round("change_pct", 6).alias("change_pct"), "would_breach")


@query("k10_problems", "SELECT s.cohort_id, CASE WHEN lifecycle_state LIKE 'closed%' THEN 1 ELSE 0 END AS is_closed, regexp_extract(root_cause_hypothesis, '^[^.:]*') AS claim, CASE WHEN lifecycle_state NOT LIKE 'closed%' THEN date_diff('day', CAST(raised_ts AS DATE), DATE '2024-01-30')::INT END AS age_days, CASE WHEN lifecycle_state IN ('approved_awaiting_execution', 'reopened') THEN owner_group ELSE CASE lifecycle_state WHEN 'awaiting_triage' THEN 'the triage job' WHEN 'awaiting_review' THEN 'a steward' WHEN 'awaiting_approval' THEN 'an approver' WHEN 'awaiting_verification' THEN 'the next run' ELSE '—' END END AS waiting_on FROM state s")
def k10(m):
    return datasets.problems(m, _day()).select("cohort_id", "is_closed", "claim", "age_days", "waiting_on")


@query("k11_problem_flow", "SELECT CAST(date_trunc('week', raised_ts) AS DATE) AS week, 'Raised' AS flow, cohort_id FROM state UNION ALL SELECT CAST(date_trunc('week', CASE WHEN lifecycle_state = 'closed_verified' THEN verified_ts ELSE reviewed_ts END) AS DATE), 'Closed', cohort_id FROM state WHERE lifecycle_state LIKE 'closed%'")
def k11(m):
    return datasets.problem_flow(m).select("week", "flow", "cohort_id")


@query("k12_resolution", "SELECT s.cohort_id, CASE WHEN lifecycle_state LIKE 'closed%' THEN 1 ELSE 0 END AS is_closed, CASE WHEN recommendation_followed THEN 1 WHEN recommendation_followed = FALSE THEN 0 END AS advice_followed, COALESCE(g.n, 0) AS integrity_gaps FROM state s LEFT JOIN (SELECT cohort_id, COUNT(*) AS n FROM integrity GROUP BY 1) g USING (cohort_id)")
def k12(m):
    return datasets.resolution(m).select("cohort_id", "is_closed", "advice_followed", "integrity_gaps")


@query("k13_decisions", "SELECT d.cohort_id, d.event_seq, d.event_type, c.severity FROM disposition d JOIN cohort c USING (cohort_id)")
def k13(m):
    return datasets.decisions(m).select("cohort_id", "event_seq", "event_type", "severity")


@query("k14_escalation", "SELECT k.rule_id, e.cde_id, 0 AS is_held FROM last_run k LEFT JOIN rule_element e USING (rule_id) WHERE k.status = 'breach'")
def k14(m):
    return datasets.escalation(m).select("rule_id", "cde_id", "is_held")


@query("k15_run_health", "SELECT CAST(d AS DATE) AS run_day, CASE WHEN s.run_id IS NULL THEN 1 ELSE 0 END AS no_run, k.n AS checks FROM range(DATE '2024-01-30' - 89, DATE '2024-01-31', INTERVAL 1 DAY) r(d) LEFT JOIN sched s ON s.run_day = CAST(d AS DATE) LEFT JOIN (SELECT run_id, COUNT(*) AS n FROM check_run GROUP BY 1) k ON k.run_id = s.run_id")
def k15(m):
    return datasets.run_health(m, _day()).select("run_day", "no_run", "checks")


@query("k16_run_errors", "SELECT rule_id, message FROM last_run WHERE status = 'error'")
def k16(m):
    return datasets.run_errors(m).select("rule_id", "message")


@query("k17_register_changes", "SELECT 'Rule' AS object, rule_id AS id, rule_version AS version, CASE WHEN rule_version = 1 THEN 'registered' WHEN status = 'active' AND was = 'shadow' THEN 'promoted' WHEN status = 'retired' AND was <> 'retired' THEN 'retired' ELSE 'new version' END AS change FROM (SELECT *, LAG(status) OVER (PARTITION BY rule_id ORDER BY rule_version) AS was FROM rule_registry) UNION ALL SELECT 'Key attribute', cde_id, cde_version, CASE WHEN cde_version = 1 THEN 'registered' WHEN status = 'retired' THEN 'retired' WHEN tolerance_pct IS DISTINCT FROM was THEN 'tolerance' ELSE 'new version' END FROM (SELECT *, LAG(tolerance_pct) OVER (PARTITION BY cde_id ORDER BY cde_version) AS was FROM elements) UNION ALL SELECT 'Table', target_table, table_version, CASE WHEN table_version = 1 THEN 'selected' ELSE status END FROM monitored_table")
def k17(m):
    return datasets.register_changes(m).select("object", "id", "version", "change")


@query("k18_tolerance", f"SELECT cde_id, review_state FROM ({_TOLERANCE})")
def k18(m):
    return datasets.tolerance(m).select("cde_id", "review_state")


@query("k19_dimension_scores", f"SELECT s.run_day, {_DIM.format('r.rule_type')} AS dimension, COUNT(*) AS checks_run, COUNT(*) FILTER (k.status = 'breach') AS checks_breaching, SUM(k.rows_scanned)::BIGINT AS rows_checked FROM check_run k JOIN sched s USING (run_id) JOIN rules_now r ON r.rule_id = k.rule_id WHERE k.status IN ('pass', 'breach') AND k.rule_id IN (SELECT rule_id FROM rule_element) GROUP BY 1, 2")
def k19(m):
    return datasets.dimension_scores(m).select("run_day", "dimension", "checks_run", "checks_breaching", "rows_checked")
