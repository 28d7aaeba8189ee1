"""The check run: many rules in one aggregate per relation, verdicts, and samples of violating rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.rules import JoinRule, RowRule, Rule, UniqueRule, VarianceRule

MEASURED = T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("rows_scanned", T.LongType()), T.StructField("violation_count", T.LongType()), T.StructField("error", T.StringType())])


#: Counts of one aggregate; Spark generates whole-stage code for up to 100 fields.
MOST = 60


def rule_shape(rule: Rule) -> str:
    return rule.kind


def _rows(counts: DataFrame, scanned: Mapping[str, str]) -> DataFrame:
    """One wide row of counts -> a row per rule. Rule ids are identifiers, so they can stand in the expression."""
    cells = ", ".join(f"struct('{rule}' AS rule_id, `{scope}` AS rows_scanned, coalesce(`v_{rule}`, 0L) AS violation_count)" for rule, scope in scanned.items())
    return counts.selectExpr(f"inline(array({cells}))")


def _equal(a: Column, b: Column) -> bool:
    """The same expression, types of literals included."""
    return a is b or a._jc.equals(b._jc)


def row_level_batch(df: DataFrame, rules: Sequence[RowRule | JoinRule], most: int | None = MOST) -> DataFrame:
    """All rules of one relation in one aggregate. count_if(scope) is what WHERE scope would count, once for all rules that share the scope; a NULL
    predicate is not counted.

    An aggregate of more than ``most`` counts leaves whole-stage code, and each count then costs over twice as much; so more rules are split over
    several aggregates, each with a scan of the columns that its rules read. For a relation that is dearer to read than to check, such as a join, None keeps one.
    """
    parts: list[DataFrame] = []
    scopes: list[Column] = []
    scanned, counts = {}, []
    for r in rules:
        if most and len(counts) + 2 > most:
            parts.append(_rows(df.agg(*counts), scanned))
            scopes, scanned, counts = [], {}, []
        place = next((i for i, c in enumerate(scopes) if _equal(c, r.within)), len(scopes))
        if place == len(scopes):
            scopes.append(r.within)
            counts.append(F.count_if(r.within).alias(f"s_{place}"))
        scanned[r.rule_id] = f"s_{place}"
        counts.append(F.count_if((r.within & r.violates) if r.scope is not None else r.violates).alias(f"v_{r.rule_id}"))
    return reduce(DataFrame.unionByName, [*parts, _rows(df.agg(*counts), scanned)])


def one_by_one(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """The same verdicts with a scan for each rule; the batch must equal it."""
    each = [df.where(r.within).agg(F.lit(r.rule_id).alias("rule_id"), F.count("*").alias("rows_scanned"), F.count_if(r.violates).alias("violation_count")) for r in rules]
    return reduce(DataFrame.unionByName, each)


def uniqueness_check(df: DataFrame, rule: UniqueRule) -> DataFrame:
    """Rows of keys that too many rows in scope share; rows with NULL keys are one group. Counts by key first, so no window is needed."""
    groups = df.where(rule.within).groupBy(*rule.keys).agg(F.count("*").alias("n"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_scanned"), F.coalesce(F.sum(F.when(F.col("n") > rule.most, F.col("n"))), F.lit(0)).alias("violation_count"))
    return total.select(F.lit(rule.rule_id).alias("rule_id"), "rows_scanned", "violation_count")


def variance_check(df: DataFrame, rule: VarianceRule) -> DataFrame:
    seen = df.agg(F.count_if(rule.within).alias("rows_scanned"), F.min(rule.values).alias("lo"), F.max(rule.values).alias("hi"))
    constant = F.col("lo").eqNullSafe(F.col("hi"))  # one distinct value, or none
    return seen.select(F.lit(rule.rule_id).alias("rule_id"), "rows_scanned", F.when(constant, F.col("rows_scanned")).otherwise(0).cast("long").alias("violation_count"))


def plan(rules: Sequence[Rule]) -> dict[tuple[str, str], list[Rule]]:
    """Rules that share a scan: row rules by table, join rules by join, the others alone."""
    out: dict[tuple[str, str], list[Rule]] = {}
    for r in rules:
        key = ("table", r.table) if isinstance(r, RowRule) else ("join", r.join) if isinstance(r, JoinRule) else ("alone", r.rule_id)
        out.setdefault(key, []).append(r)
    return out


class MissingRelation(ValueError):
    """A rule over a relation that the run was not given."""


def _measure(group: Sequence[Rule], tables: Mapping[str, DataFrame], joins: Mapping[str, DataFrame]) -> DataFrame:
    first = group[0]
    held, name = (joins, first.join) if isinstance(first, JoinRule) else (tables, first.table)
    if name not in held:
        raise MissingRelation(f"no relation {name}")
    if isinstance(first, UniqueRule):
        return uniqueness_check(tables[first.table], first)
    if isinstance(first, VarianceRule):
        return variance_check(tables[first.table], first)
    return row_level_batch(joins[first.join], group, None) if isinstance(first, JoinRule) else row_level_batch(tables[first.table], group)


def measure(spark: SparkSession, rules: Sequence[Rule], tables: Mapping[str, DataFrame], joins: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(rule_id, rows_scanned, violation_count, error). All groups are one job; if it fails, each is measured by itself, and a group that fails
    rule by rule, so only the rules at fault are errors.

    One row per rule comes to the driver; the number of rules bounds it.
    """
    joins = joins or {}

    def collect(group: Sequence[Rule]) -> list[tuple]:
        try:
            return [(r.rule_id, r.rows_scanned, r.violation_count, None) for r in _measure(group, tables, joins).collect()]
        except (PySparkException, MissingRelation) as fault:
            if len(group) > 1:
                return [row for r in group for row in collect([r])]
            return [(group[0].rule_id, None, None, f"{type(fault).__name__}: {str(fault).splitlines()[0][:200]}")]

    groups = list(plan(rules).values())
    try:
        whole = reduce(DataFrame.unionByName, [_measure(group, tables, joins) for group in groups]) if groups else None
        rows = [(r.rule_id, r.rows_scanned, r.violation_count, None) for r in whole.collect()] if groups else []
    except (PySparkException, MissingRelation):
        rows = [row for group in groups for row in collect(group)]
    return spark.createDataFrame(rows, MEASURED)


def rule_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.rule_id, r.kind, r.table, r.column, r.rule_type, r.severity, float(r.threshold_pct), r.status) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, kind string, target_table string, target_column string, rule_type string, severity string, threshold_pct double, rule_status string")


def verdict(measured: DataFrame) -> DataFrame:
    """Adds violation_pct, status and message to rows with rows_scanned, violation_count, threshold_pct, rule_status and, if any, error."""
    scanned, bad = F.col("rows_scanned"), F.col("violation_count")
    pct = F.when(scanned > 0, F.round(bad.cast("double") * 100.0 / scanned, 4))
    broken = scanned.isNull() if "error" not in measured.columns else scanned.isNull() | F.col("error").isNotNull()
    status = (
        F.when(broken, "error").when(F.col("rule_status") == "shadow", "skipped").when(scanned == 0, "skipped").when(bad == 0, "pass").when(pct > F.col("threshold_pct"), "breach").otherwise("pass")
    )
    message = F.when(broken, "not measured").when(scanned == 0, "no rows in scope").otherwise(F.format_string("%d of %d rows fail", bad, scanned))
    return measured.withColumn("violation_pct", pct).withColumn("status", status).withColumn("message", message)


def check_run(spark: SparkSession, rules: Sequence[Rule], tables: Mapping[str, DataFrame], joins: Mapping[str, DataFrame] | None = None, shadow_only: bool = False) -> DataFrame:
    rules = [r for r in rules if r.status == "shadow" or (r.status == "active" and not shadow_only)]
    return verdict(rule_frame(spark, rules).join(measure(spark, rules, tables, joins), "rule_id"))


def worklist(rules: DataFrame, elements: DataFrame) -> DataFrame:
    """Current rules, active or shadow, on a registered element."""
    return rules.where("status in ('active', 'shadow')").join(elements.where("status = 'registered'").select("cde_id"), "cde_id", "left_semi")


def row_key(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def sample_keep(df: DataFrame, keys: Sequence[str], reads: Sequence[str]) -> list[str]:
    """The key columns and those that a rule reads, in the table's order."""
    wanted = {c.lower() for c in (*keys, *reads)}
    return [c for c in df.columns if c.lower() in wanted]


def violation_samples(df: DataFrame, rules: Sequence[RowRule], keys: Sequence[str], reads: Mapping[str, Sequence[str]], cap: int = 100) -> DataFrame:
    """Up to ``cap`` violating rows of each rule, from one scan: (rule_id, row_key, sample_row as JSON), least keys first.

    Each task keeps the ``cap`` least rows of each rule, so no more are shuffled (for a ``cap`` up to Spark's window group limit, 1000); what 64th parts of the tasks kept is
    ranked before the last ranking, so that one task never sorts what all others sent. JSON is made of the rows that stay alone.
    """
    hits = F.array_compact(F.array(*[F.when(r.within & r.violates, F.lit(r.rule_id)) for r in rules]))
    wanted = sample_keep(df, keys, [c for r in rules for c in reads[r.rule_id]])
    rows = df.select(F.explode(hits).alias("_rule"), row_key(keys).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in wanted]).alias("_row"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("_part"))
    rows = rows.withColumn("_tie", F.xxhash64("_row"))
    for by in (["_rule", "_part"], ["_rule"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_key", "_tie"))).where(F.col("_n") <= cap).drop("_n")
    sampled = F.coalesce(*[F.when(F.col("_rule") == r.rule_id, F.to_json(F.struct(*[F.col("_row")[c].alias(c) for c in sample_keep(df, keys, reads[r.rule_id])]))) for r in rules])
    return rows.select(F.col("_rule").alias("rule_id"), F.col("_key").alias("row_key"), sampled.alias("sample_row"))


#: Keys below which a sketch is exact, as a power of two.
SKETCH = 14


def key_sketches(df: DataFrame, rules: Sequence[RowRule], keys: Sequence[str], lg: int = SKETCH) -> DataFrame:
    """(rule_id, key_sketch): the keys of each rule's violating rows, as a theta sketch, from one scan; to be kept beside the verdict.

    Below 2**lg keys it is the set itself, from there on its count is off by some 1 / sqrt(2**lg); sketches of rules, runs and tables can be joined (``metrics.records_affected``,
    which counts the keys themselves where it has them).
    """
    wide = df.agg(*[F.theta_sketch_agg(F.when(r.within & r.violates, row_key(keys)), lg).alias(f"k_{r.rule_id}") for r in rules])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"k_{r.rule_id}").alias("key_sketch")) for r in rules])))


def violating_keys(df: DataFrame, rules: Sequence[RowRule], keys: Sequence[str]) -> DataFrame:
    """(rule_id, row_key): the key of every row that breaks a rule, once for each such row."""
    hits = F.array_compact(F.array(*[F.when(r.within & r.violates, F.lit(r.rule_id)) for r in rules]))
    return df.select(F.explode(hits).alias("rule_id"), row_key(keys).alias("row_key"))


def uniqueness_samples(df: DataFrame, rule: UniqueRule, keys: Sequence[str], cap: int = 100) -> DataFrame:
    """Rows in scope of shared keys."""
    rows = df.where(rule.within)
    shared = rows.groupBy(*rule.keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rule.most)
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(shared[k]) for k in rule.keys])
    found = rows.join(shared, on, "left_semi")
    return found.select(F.lit(rule.rule_id).alias("rule_id"), row_key(keys).alias("row_key")).orderBy("row_key").limit(cap)
