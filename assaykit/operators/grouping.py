"""Breaches grouped into problems: by the day they began and by the records they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.sources.relations import checkpointed, latest


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that edges lead to. Labels spread to neighbours and then jump to their own label's label."""
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = checkpointed(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpointed(both.groupBy("x").agg(F.min(F.least("x", "y")).alias("label")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy(F.col("x").alias("n")).agg(F.min("label").alias("around"))
        spread = labels.join(near, F.col("node") == F.col("n")).select("node", F.least("label", "around").alias("label"), F.col("label").alias("was"))
        hop = spread.select(F.col("node").alias("h"), F.col("label").alias("next"))
        after = checkpointed(spread.join(hop, F.col("label") == F.col("h"), "left").select("node", F.least("label", "next").alias("label"), "was"))
        if after.where("label <> was").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")


def latest_active_run(check_run: DataFrame) -> DataFrame:
    """G1: the run_id of the latest run that measured something, one row."""
    runs = check_run.groupBy("run_id").agg(F.max("run_ts").alias("run_ts"), F.count_if(F.col("status") != "skipped").alias("n")).where("n > 0")
    return runs.agg(F.max_by("run_id", F.struct("run_ts", "run_id")).alias("run_id"))


def failing(check_run: DataFrame) -> DataFrame:
    """The breaches of that run."""
    return check_run.join(F.broadcast(latest_active_run(check_run)), "run_id").where("status = 'breach'")


def breach_history(check_run: DataFrame) -> DataFrame:
    """Per failing rule its first breach, how often it passed before, and whether it regressed or always failed."""
    first = F.min(F.when(F.col("status") == "breach", F.col("run_ts"))).over(Window.partitionBy("rule_id"))
    rows = check_run.withColumn("first_breach", first).join(failing(check_run).select("rule_id"), "rule_id", "left_semi")
    out = rows.groupBy("rule_id").agg(F.min("first_breach").alias("first_breach"), F.count_if((F.col("status") == "pass") & (F.col("run_ts") < F.col("first_breach"))).alias("passes_before"), F.count("*").alias("runs"))
    return out.withColumn("kind", F.when(F.col("passes_before") > 0, "regression").otherwise("chronic"))


def extended(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) after more edges: what ``connected`` gives for all edges at once, from the stored labels (node, component) and the new edges alone.

    An end that has a label stands for it, so the rounds run on a graph of labels that the new edges tie, however large the components are.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    for side in ("x", "y"):
        known = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        ends = ends.join(known, F.col(side) == F.col("_n"), "left").withColumn(side, F.coalesce("_c", side)).drop("_n", "_c")
    tied = checkpointed(connected(ends, "x", "y"))
    fresh = edges.select(F.explode(F.array(a, b)).alias("node")).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(fresh.withColumn("component", F.col("node")))
    return every.join(tied.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))


def usable_samples(samples: DataFrame, verdicts: DataFrame, monitored: DataFrame) -> DataFrame:
    """One run's samples with their outcome: 'rule on the key column', 'blank key' or 'kept'. verdicts: of that run. monitored: target_table, table_version, row_key (its columns)."""
    keys = latest(monitored, ["target_table"], "table_version").select("target_table", "row_key")
    on_key = verdicts.join(keys, "target_table").where(F.array_contains("row_key", F.col("target_column"))).select("rule_id", F.lit(True).alias("_on_key")).distinct()
    blank = (F.coalesce("row_key", F.lit("")) == "") | F.col("row_key").rlike(r"(^[|])|([|]$)|([|][|])")
    held = samples.join(verdicts.select("run_id").distinct(), "run_id", "left_semi").join(on_key, "rule_id", "left")
    return held.withColumn("outcome", F.when(F.col("_on_key"), "rule on the key column").when(blank, "blank key").otherwise("kept")).drop("_on_key")


#: Rules of one mask.
MASK = 62


def shared_rows(usable: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Pairs of rules of which the smaller one's records are, by this share, records of the other too. usable: from ``usable_samples``.

    A record's rules are bits of masks, which tasks join before anything is shuffled; records that break the same rules are then counted together, so pairs are made
    for each different set of rules, not for each record. The rule ids, one row per rule, come to the driver.
    """
    used = usable.where("outcome = 'kept' and rule_id is not null")
    names = sorted(r.rule_id for r in used.select("rule_id").distinct().collect())
    masks = [f"mask_{i}" for i in range(-(-len(names) // MASK) or 1)]
    bits = [(name, *[1 << i % MASK if i // MASK == k else 0 for k in range(len(masks))]) for i, name in enumerate(names)]
    numbered = usable.sparkSession.createDataFrame(bits, "rule_id string, " + ", ".join(f"{m} long" for m in masks))
    records = used.select("target_table", "row_key", "rule_id").join(F.broadcast(numbered), "rule_id").groupBy("target_table", "row_key").agg(*[F.bit_or(m).alias(m) for m in masks])
    held = F.array_compact(F.array(*[F.when(F.col(masks[i // MASK]).bitwiseAND(F.lit(1 << i % MASK)) != 0, F.lit(name)) for i, name in enumerate(names)])) if names else F.array().cast("array<string>")
    sets = records.groupBy(*masks).agg(F.count("*").alias("n")).select(held.alias("rules"), "n")
    sizes = sets.select(F.explode("rules").alias("rule_id"), "n").groupBy("rule_id").agg(F.sum("n").alias("n"))
    with_later = F.flatten(F.transform("rules", lambda a, i: F.transform(F.slice("rules", i + 2, F.size("rules")), lambda b: F.struct(a.alias("rule_a"), b.alias("rule_b")))))
    pairs = sets.select(F.inline(with_later), "n").groupBy("rule_a", "rule_b").agg(F.sum("n").alias("shared"))
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("rule_id").alias(f"rule_{side}"), F.col("n").alias(f"n_{side}")), f"rule_{side}")
    return pairs.withColumn("ratio", F.col("shared").cast("double") / F.least("n_a", "n_b")).where(F.col("ratio") >= ratio).select("rule_a", "rule_b", "shared", "ratio")


def dropped_samples(usable: DataFrame) -> DataFrame:
    """Per outcome its rows, records (a rule's) and rules. usable: from ``usable_samples``."""
    return usable.groupBy("outcome").agg(F.count("*").alias("rows"), F.countDistinct("rule_id", "row_key").alias("records"), F.countDistinct("rule_id").alias("rules"))


def problem_edges(history: DataFrame, shared: DataFrame) -> DataFrame:
    """a, b, reason: regressions that began on one day, two at least, and rules that share records. Each day's rules hang on its first one."""
    days = history.where("kind = 'regression'").withColumn("day", F.to_date("first_breach"))
    first = days.groupBy("day").agg(F.min("rule_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    together = F.concat(F.lit("co-movement: all "), F.col("n").cast("string"), F.lit(" were clean and first breached on "), F.col("day").cast("string"))
    moved = days.join(first, "day").where("rule_id <> a").select("a", F.col("rule_id").alias("b"), together.alias("reason"))
    known = history.select("rule_id")
    rows = shared.join(known.withColumnRenamed("rule_id", "rule_a"), "rule_a", "left_semi").join(known.withColumnRenamed("rule_id", "rule_b"), "rule_b", "left_semi")
    both = F.concat(F.lit("shared rows: "), "rule_a", F.lit(" and "), "rule_b", F.lit(" fail on "), F.col("shared").cast("string"), F.lit(" of the same records ("), F.floor(F.col("ratio") * 100).cast("string"), F.lit("% of the smaller sample)"))
    return moved.unionByName(rows.select(F.col("rule_a").alias("a"), F.col("rule_b").alias("b"), both.alias("reason")))


def form_groups(history: DataFrame, edges: DataFrame, group: DataFrame | None = None) -> DataFrame:
    """rule_id, problem (its smallest rule), group_key (the day that all began on, else the smallest rule) and basis. A rule without an edge is a problem of its own.

    group: the components of the edges, where they are kept (``extended``).
    """
    group = connected(edges) if group is None else group
    out = history.join(group, F.col("rule_id") == F.col("node"), "left").withColumn("problem", F.coalesce("component", "rule_id"))
    why = edges.join(group, F.col("a") == F.col("node")).groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("why"))
    day = F.to_date("first_breach").cast("string")
    sizes = out.groupBy("problem").agg(F.count("*").alias("_n"), F.min(day).alias("_day"), F.countDistinct(day).alias("_days"))
    alone = F.when(F.col("kind") == "chronic", F.concat(F.lit("not grouped - this check stands alone. It has never passed in "), F.col("runs").cast("string"), F.lit(" runs"))).otherwise(
        F.concat(F.lit("not grouped - this check first breached on "), day, F.lit(" and no other check broke on that date")))
    made = out.join(sizes, "problem").join(why.withColumnRenamed("component", "problem"), "problem", "left")
    key = F.when((F.col("_n") > 1) & (F.col("_days") == 1), F.col("_day")).otherwise(F.col("problem"))
    return made.select("rule_id", "problem", key.alias("group_key"), F.when(F.col("_n") == 1, alone).otherwise(F.coalesce("why", F.lit(""))).alias("basis"))


def prior_problems(failing_rules: DataFrame, state: DataFrame) -> DataFrame:
    """Earlier problems that hold a failing rule."""
    each = state.select("cohort_id", "lifecycle_state", F.explode("member_rule_ids").alias("rule_id"))
    return each.join(failing_rules.select("rule_id"), "rule_id", "left_semi")


def _event_label() -> Column:
    said = F.when(F.trim("decision") != "", F.concat(F.lit(" ("), "decision", F.lit(")"))).otherwise("")
    ended = F.when(F.col("event_type") == "verified", F.when(F.col("verification_passed"), " PASSED").otherwise(" FAILED")).otherwise("")
    return F.concat("event_type", F.coalesce(said, F.lit("")), ended)


def event_chain(disposition: DataFrame) -> DataFrame:
    """Each problem's events in order, as text: with the decision, and how a verification ended."""
    cells = F.array_sort(F.collect_list(F.struct("event_seq", _event_label().alias("label"))))
    return disposition.groupBy("cohort_id").agg(F.array_join(F.transform(cells, lambda c: c["label"]), " > ").alias("chain"))


def steward_notes(disposition: DataFrame, who: str = "actor_identity") -> DataFrame:
    """cohort_id, event_seq, day, event, who, reason of the events that give one."""
    said = disposition.where(F.trim("reason") != "")
    return said.select("cohort_id", "event_seq", F.to_date("event_ts").alias("day"), _event_label().alias("event"), F.col(who).alias("who"), F.trim("reason").alias("reason"))


def recurrences(failing_rules: DataFrame, state: DataFrame, days: int = 30) -> DataFrame:
    """Per failing rule, whether a problem with it was verified closed within ``days`` before (failing_rules has run_ts)."""
    each = state.where("lifecycle_state = 'closed_verified'").select("verified_ts", F.explode("member_rule_ids").alias("rule_id"))
    gap = F.datediff("run_ts", "verified_ts")
    return failing_rules.join(each, "rule_id", "left").groupBy("rule_id").agg(F.coalesce(F.max((gap >= 0) & (gap <= days)), F.lit(False)).alias("is_recurrence"))


RANK = {"P1_block": 100, "P2_alert": 50, "P3_monitor": 20}


def severity_rank(c):
    out = F.lit(0)
    for name, points in RANK.items():
        out = F.when(c == name, points).otherwise(out)
    return out


def problem_rollup(groups: DataFrame, breaches: DataFrame) -> DataFrame:
    """G10, G13 without lineage: one row per problem."""
    rows = groups.join(breaches, "rule_id")
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1)).otherwise(F.concat(F.lit("mixed: "), F.array_join(c, ", ")))
    out = rows.groupBy("problem").agg(
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.array_sort(F.collect_set("business_domain")).alias("domains"), F.array_sort(F.collect_set("owner_group")).alias("owners"),
        F.count("*").alias("member_count"), F.sum("violation_count").alias("total_violation_rows"), F.array_sort(F.collect_set("target_table")).alias("affected_tables"), F.array_sort(F.collect_set("rule_id")).alias("member_rule_ids"),
    )
    return out.withColumns({"business_domain": one(F.col("domains")), "owner_group": one(F.col("owners"))}).drop("domains", "owners")


def playbook_candidates(rules: DataFrame, playbooks: DataFrame) -> DataFrame:
    """A rule's own playbooks, and those of its type that name no rule: two equi-joins instead of one OR."""
    blank = F.trim(F.coalesce("rule_id", F.lit(""))) == ""
    own = rules.join(playbooks.select("playbook_id", "rule_id"), "rule_id").select("rule_id", "playbook_id", F.lit("rule").alias("by"))
    kind = rules.join(playbooks.where(blank).select("playbook_id", "rule_type"), "rule_type").select("rule_id", "playbook_id", F.lit("type").alias("by"))
    return own.unionByName(kind)


def element_context(problems: DataFrame, coverage: DataFrame) -> DataFrame:
    """The elements that a problem's rules watch, with what their coverage lacks."""
    cells = coverage.select("cde_id", "target_table", "target_column", "coverage_gap", F.explode("rule_ids").alias("rule_id"))
    each = problems.select("problem", F.explode("member_rule_ids").alias("rule_id"))
    return each.join(cells, "rule_id").select("problem", "cde_id", "target_table", "target_column", "coverage_gap").distinct()


def blast_radius(problems: DataFrame, lineage: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Tables that were fed from a problem's tables in the last ``days``, without its own."""
    edges = lineage.where((F.col("seen_day") <= as_of) & (F.col("seen_day") >= F.date_sub(as_of, days))).select("source_table", F.col("target_table").alias("fed")).distinct()
    each = problems.select("problem", "affected_tables", F.explode("affected_tables").alias("source_table")).join(edges, "source_table")
    return each.groupBy("problem", "affected_tables").agg(F.collect_set("fed").alias("fed")).select("problem", F.array_sort(F.array_except("fed", "affected_tables")).alias("blast_radius"))


def rank_score(problems: DataFrame, radius: DataFrame) -> DataFrame:
    """100, 50 or 20 by severity, 3 for each member, 5 for each table in the blast radius."""
    out = problems.join(radius, "problem", "left")
    return out.withColumn("rank_score", severity_rank(F.col("severity")) + 3 * F.col("member_count") + 5 * F.size(F.coalesce("blast_radius", F.array().cast("array<string>"))))


def problem_id(problems: DataFrame) -> DataFrame:
    """The same for the same key and tables, whoever is a member."""
    return problems.withColumn("problem_id", F.sha2(F.concat_ws("|", "problem", F.array_join("affected_tables", "|")), 256))


def live_problems(breaching: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Each breaching rule with the newest problem that holds it."""
    owner = cohorts.select("cohort_id", "raised_ts", F.explode("member_rule_ids").alias("rule_id")).groupBy("rule_id").agg(F.max_by("cohort_id", F.struct("raised_ts", "cohort_id")).alias("cohort_id"))
    return breaching.select("rule_id").distinct().join(owner, "rule_id")


def playbook_usage(playbooks: DataFrame, disposition: DataFrame) -> DataFrame:
    """G17."""
    used = disposition.where("event_type = 'executed' and playbook_id is not null").groupBy("playbook_id").agg(F.count("*").alias("use_count"), F.max("event_ts").alias("last_used"))
    return playbooks.join(used, "playbook_id", "left").fillna(0, ["use_count"])


GAPS = ("no_rule", "scope_mismatch", "unvalidated", "covered")


def problem_elements(problems: DataFrame, coverage: DataFrame) -> DataFrame:
    """Each problem's elements with their worst gap."""
    worst = F.array_position(F.array(*map(F.lit, GAPS)), F.col("coverage_gap"))
    return element_context(problems, coverage).groupBy("problem", "cde_id").agg(F.element_at(F.array(*map(F.lit, GAPS)), F.min(worst).cast("int")).alias("worst_gap"))


def unattached_rules(problems: DataFrame, coverage: DataFrame) -> DataFrame:
    each = problems.select("problem", F.explode("member_rule_ids").alias("rule_id"))
    return each.join(coverage.select(F.explode("rule_ids").alias("rule_id")), "rule_id", "left_anti")


