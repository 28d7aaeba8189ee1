"""Profiles of columns, discovery of what they hold, templates that become rules, and pseudonyms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import scalar as f
from assaykit.operators.rules import RowRule, Rule
from assaykit.sources.relations import checkpointed


def _melt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value: every cell of the columns, in one pass."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))


#: Distinct values up to which a column's are counted by a sketch, as a power of two; tasks whose sketches meet first.
SKETCH, FAN_IN = 14, 256


#: How parts of a figure meet.
MERGE = {"sum": "coalesce(sum(`{c}`), 0L)", "min": "min(`{c}`)", "max": "max(`{c}`)"}


def count_columns(df: DataFrame, figures: Mapping[str, tuple[str, str]], cells: Mapping[str, Mapping[str, Column]], lg: int = SKETCH) -> DataFrame:
    """column, its figures, and distinct_count of its cell ``v`` where that is not NULL, exact.

    cells: column -> name -> what is taken of each row. figures: name -> SQL aggregate over {cell}, and how parts of it meet (``MERGE``).

    One pass, in which no cell leaves its task: a theta sketch of less than 2**lg keys is the set of their hashes, so its count is exact; beyond, its estimate is never below 2**lg. Only
    columns that reach that are read again, and the distinct 128-bit hashes of their values are shuffled. A task sends at most 8 * 2**lg bytes for each column; sketches meet in
    ``FAN_IN`` groups of tasks before they meet in one. One row of counts comes to the driver.
    """
    names = list(cells)
    hashed = lambda c: F.when(cells[c]["v"].isNotNull(), F.xxhash64(cells[c]["v"]))
    rows = df.select((F.spark_partition_id() % FAN_IN).alias("_g"), *[x.alias(f"c{i}_{k}") for i, c in enumerate(names) for k, x in cells[c].items()], *[hashed(c).alias(f"h{i}") for i, c in enumerate(names)])
    first = [f"{sql.format_map({k: f'`c{i}_{k}`' for k in cells[c]})} AS `{i}_{n}`" for i, c in enumerate(names) for n, (sql, _) in figures.items()] + [f"theta_sketch_agg(h{i}, {lg}) AS s{i}" for i in range(len(names))]
    then = [f"{MERGE[how].format(c=f'{i}_{n}')} AS `{i}_{n}`" for i in range(len(names)) for n, (_, how) in figures.items()] + [f"coalesce(theta_sketch_estimate(theta_union_agg(s{i}, {lg})), 0L) AS s{i}" for i in range(len(names))]
    wide = rows.groupBy("_g").agg(*map(F.expr, first)).agg(*map(F.expr, then))
    row = wide.collect()[0]
    large = [c for i, c in enumerate(names) if row[f"s{i}"] >= 1 << lg]
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{n}").alias(n) for n in figures], F.col(f"s{i}").alias("distinct_count")) for i, c in enumerate(names)]
    out = df.sparkSession.createDataFrame([row], wide.schema).select(F.inline(F.array(*each)))
    if not large:
        return out
    found = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), hashed(c).alias("h1"), F.xxhash64(F.lit(1), cells[c]["v"]).alias("h2")) for c in large]))).where("h1 is not null")
    exact = found.distinct().groupBy("column").agg(F.count("*").alias("_exact"))
    return out.join(exact, "column", "left").withColumn("distinct_count", F.coalesce("_exact", "distinct_count")).drop("_exact")


#: Characters of the longest value that means that there is none; longer ones need no comparison.
_LONGEST = max(map(len, f.SENTINELS))
_PROFILE = {
    "rows_scanned": ("count(*)", "sum"), "null_count": ("count_if({empty} is null)", "sum"), "blank_count": ("count_if({empty})", "sum"), "populated_count": ("count({v})", "sum"),
    "min_length": ("min({size})", "min"), "max_length": ("max({size})", "max"), "sentinel_count": ("count_if({sentinel})", "sum"), "match_count": ("count_if({fits})", "sum"),
}


def profile_columns(df: DataFrame, columns: Sequence[str], pattern: str | None = None, lg: int = SKETCH) -> DataFrame:
    """Counts per column. NULL, blank and populated values are counted apart; distinct populated values by ``count_columns``. A table without rows has zeros."""
    cells = {}
    for c in columns:
        text = F.col(c).cast("string")
        empty = F.trim(text) == ""
        v = F.when(~empty, text)
        cells[c] = {"empty": empty, "v": v, "size": F.length(v), "sentinel": (F.length(F.trim(v)) <= _LONGEST) & f.is_sentinel(v), "fits": v.rlike(f"^(?:{pattern})") if pattern else F.lit(False)}
    out = count_columns(df, _PROFILE, cells, lg)
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) * 100.0D / {b}, 4) END AS {a.replace('_count', '_pct')}"
    counts = ["column", "rows_scanned", "null_count", "blank_count", "populated_count", "distinct_count", "min_length", "max_length", "sentinel_count", "match_count"]
    return out.selectExpr(*counts, share("null_count", "rows_scanned"), share("blank_count", "rows_scanned"), share("distinct_count", "populated_count"), share("match_count", "populated_count"))


def top_signatures(df: DataFrame, columns: Sequence[str], private: bool = False, top: int = 8, rare: int = 5) -> DataFrame:
    """Column, rank, signature, row_count, signature_count; shapes of few rows of a private column are one row <rare>."""
    cells = _melt(df, columns).where(f.present(F.col("value")))
    shapes = cells.groupBy("column", f.signature(F.col("value")).alias("signature")).agg(F.count("*").alias("row_count"))
    counted = shapes.join(shapes.groupBy("column").agg(F.count("*").alias("signature_count")), "column")  # no window, which would gather a column's shapes
    if private:
        counted = counted.withColumn("signature", F.when(F.col("row_count") < rare, "<rare>").otherwise(F.col("signature"))).groupBy("column", "signature", "signature_count").agg(F.sum("row_count").alias("row_count"))
    order = Window.partitionBy("column").orderBy(F.desc("row_count"), "signature")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("column", "rank", "signature", "row_count", "signature_count")


def profile_register(tables: Mapping[str, DataFrame], bindings: Sequence[tuple[str, str, str]], pattern: str | None = None) -> DataFrame:
    """A profile per (element, table, column) binding; one pass for each table."""
    from functools import reduce

    parts = []
    for table in sorted({t for _, t, _ in bindings}):
        columns = sorted({c for _, t, c in bindings if t == table})
        of = F.create_map(*[F.lit(x) for e, t, c in bindings if t == table for x in (c, e)])
        parts.append(profile_columns(tables[table], columns, pattern).select(of[F.col("column")].alias("cde_id"), F.lit(table).alias("target_table"), F.col("column").alias("target_column"), "rows_scanned", "null_count", "blank_count", "populated_count", "distinct_count"))
    return reduce(DataFrame.unionByName, parts)


def pattern_match_rates(df: DataFrame, columns: Sequence[str], patterns: Mapping[str, str]) -> DataFrame:
    """I4: column, element, populated, matches: all columns against all patterns in one aggregate."""
    aggs = [F.count_if(f.present(F.col(c))).alias(f"n_{i}") for i, c in enumerate(columns)]
    aggs += [F.count_if(f.present(F.col(c)) & f.trimmed(F.col(c)).rlike(p)).alias(f"m_{i}_{j}") for i, c in enumerate(columns) for j, p in enumerate(patterns.values())]
    cells = [F.struct(F.lit(c).alias("column"), F.lit(e).alias("cde_id"), F.col(f"n_{i}").alias("populated"), F.col(f"m_{i}_{j}").alias("matches")) for i, c in enumerate(columns) for j, e in enumerate(patterns)]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def name_key(c: Column) -> Column:
    """A name without its signs and case: first_name, FirstName and FIRST-NAME are one."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


#: Shares and confidences of a decision.
FITS, NEAR, BY_NAME, NARROWED = 95.0, 50.0, 0.6, 0.75


def decide_binding(columns: DataFrame, rates: DataFrame, known: DataFrame, hints: DataFrame, tags: DataFrame, least: int = 20) -> DataFrame:
    """Column, cde_id, method, confidence, why for each of ``columns`` (column).

    rates: column, cde_id, populated, matches. known: cde_id of registered elements. hints: cde_id, name (a name key). tags: column, cde_id.
    In this order: a tag settles a column, also where it names no registered element (then nothing is proposed); with ``least`` values or more, the one
    pattern that fits, of several the one whose hint is the column's name, or a near miss whose hint is; a column whose values fit or nearly fit
    is not left to its name alone; then the only hint.
    """
    pct = F.try_divide(F.col("matches") * 100.0, F.col("populated"))
    named = hints.join(known, "cde_id", "left_semi").select("cde_id", F.col("name").alias("_key")).distinct()
    by_name = columns.withColumn("_key", name_key(F.col("column"))).join(named, "_key").select("column", "cde_id", F.lit(True).alias("_named"))
    fits = rates.join(known, "cde_id", "left_semi").where(F.col("populated") >= least).withColumn("pct", pct)
    cells = fits.join(by_name, ["column", "cde_id"], "full_outer").withColumn("_named", F.coalesce("_named", F.lit(False)))
    hit, near = F.coalesce(F.col("pct") >= FITS, F.lit(False)), F.coalesce(F.col("pct") >= NEAR, F.lit(False))
    facts = {"hits": hit, "hits_named": hit & F.col("_named"), "near": near, "near_named": near & F.col("_named"), "names": F.col("_named")}
    found = cells.groupBy("column").agg(*[F.count_if(c).alias(n) for n, c in facts.items()], *[F.max(F.when(c, F.struct("cde_id", "pct"))).alias(f"{n}_of") for n, c in facts.items()])
    tagged = tags.join(known.withColumn("_known", F.lit(True)), "cde_id", "left").select("column", F.col("cde_id").alias("_tag"), "_known")
    out = columns.join(found, "column", "left").join(tagged, "column", "left").fillna(0, list(facts))
    # condition, element, method, confidence, why nothing is proposed
    cases = [
        (F.col("_known"), F.col("_tag"), "tag", F.lit(1.0), None), (F.col("_tag").isNotNull(), None, None, None, "tag names an element that is not registered"),
        (F.col("hits") == 1, F.col("hits_of.cde_id"), "value_signature", F.round(F.col("hits_of.pct") / 100, 4), None),
        ((F.col("hits") > 1) & (F.col("hits_named") == 1), F.col("hits_named_of.cde_id"), "name_match", F.lit(NARROWED), None), (F.col("hits") > 1, None, None, None, "several patterns fit"),
        ((F.col("near") > 0) & (F.col("near_named") == 1), F.col("near_named_of.cde_id"), "name_match", F.lit(BY_NAME), None), (F.col("near") > 0, None, None, None, "near miss"),
        (F.col("names") == 1, F.col("names_of.cde_id"), "name_match", F.lit(BY_NAME), None), (F.col("names") > 1, None, None, None, "name matches several elements"), (F.lit(True), None, None, None, "nothing identifies it"),
    ]
    none = F.lit(None)
    made = none
    for when, element, method, confidence, why in reversed(cases):
        cell = F.struct((none if element is None else element).cast("string").alias("cde_id"), F.lit(method).cast("string").alias("method"), (none if confidence is None else confidence).cast("double").alias("confidence"), F.lit(why).cast("string").alias("why"))
        made = F.when(when, cell).otherwise(made)
    return out.select("column", made.alias("_made")).select("column", "_made.*")


def pending(columns: DataFrame, bound: DataFrame, proposals: DataFrame, reviews: DataFrame, tags: DataFrame) -> DataFrame:
    """Columns (target_table, target_column) that discovery should look at: not bound, and not settled.

    A proposal that is open or approved settles its column. A column of which all were rejected comes back only if it has a tag now and no proposal was made by tag
    (method 'uc_tag') before. tags: target_table, target_column.
    """
    key = ["target_table", "target_column"]
    decided = proposals.join(reviews.select("proposal_id", "decision"), "proposal_id", "left").groupBy(*key).agg(
        F.bool_and(F.coalesce(F.col("decision") == "rejected", F.lit(False))).alias("_rejected"), F.bool_or(F.col("method") == "uc_tag").alias("_by_tag"))
    tagged = tags.select(*key).distinct().withColumn("_tagged", F.lit(True))
    settled = decided.join(tagged, key, "left").where(~(F.col("_rejected") & F.coalesce("_tagged", F.lit(False)) & ~F.coalesce("_by_tag", F.lit(False))))
    return columns.join(bound.select(*key), key, "left_anti").join(settled.select(*key), key, "left_anti")


def evaluate_discovery(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Outcome, n of found (column, cde_id, why) against truth (column, cde_id). A wanted column that several patterns fit is undecided, not missed; one that is bound nowhere and was left alone is right and not counted."""
    t = truth.where("cde_id is not null").select("column", F.col("cde_id").alias("true_id"))
    both = found.join(t, "column", "left")
    want, got = F.col("true_id").isNotNull(), F.col("cde_id").isNotNull()
    unsure = F.coalesce(F.col("why").contains("patterns") | F.col("why").contains("several"), F.lit(False))
    outcome = F.when(got & want, F.when(F.col("cde_id") == F.col("true_id"), "correct").otherwise("wrong element")).when(got, "spurious").when(want, F.when(unsure, "undecided").otherwise("missed"))
    return both.withColumn("outcome", outcome).where("outcome is not null").groupBy("outcome").agg(F.count("*").alias("n"))


# The formats that a text column of dates is tried in, with the order of their fields.
DATE_FORMATS = {
    "yyyy-MM-dd HH:mm:ss": "ymd", "yyyy-MM-dd'T'HH:mm:ss": "ymd", "yyyy-MM-dd": "ymd", "yyyyMMdd": "ymd", "yyyy/MM/dd": "ymd",
    "dd/MM/yyyy": "dmy", "d/M/yyyy": "dmy", "dd-MM-yyyy": "dmy", "dd.MM.yyyy": "dmy", "dd-MMM-yyyy": "dmy", "dd/MM/yyyy HH:mm:ss": "dmy",
    "MM/dd/yyyy": "mdy", "M/d/yyyy": "mdy",
}


def date_format_probe(df: DataFrame, columns: Sequence[str], formats: Mapping[str, str] = DATE_FORMATS) -> DataFrame:
    """I8: column, place, format, field_order, populated, parsed: one aggregate."""
    aggs = [F.count_if(f.present(F.col(c))).alias(f"n_{i}") for i, c in enumerate(columns)]
    aggs += [F.count_if(f.present(F.col(c)) & F.try_to_timestamp(F.col(c), F.lit(x)).isNotNull()).alias(f"m_{i}_{j}") for i, c in enumerate(columns) for j, x in enumerate(formats)]
    cells = [F.struct(F.lit(c).alias("column"), F.lit(j).alias("place"), F.lit(x).alias("format"), F.lit(o).alias("field_order"), F.col(f"n_{i}").alias("populated"), F.col(f"m_{i}_{j}").alias("parsed")) for i, c in enumerate(columns) for j, (x, o) in enumerate(formats.items())]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def choose_date_format(probe: DataFrame, least: float = 95.0) -> DataFrame:
    """column, format, why: the format that parses most (of equals the first listed), if it parses enough and none of another field order does."""
    good = F.coalesce(F.try_divide(F.col("parsed") * 100.0, F.col("populated")) >= least, F.lit(False))
    best = probe.groupBy("column").agg(F.max("populated").alias("n"), F.max_by(F.when(good, F.col("format")), F.when(good, F.struct("parsed", -F.col("place")))).alias("best"), F.countDistinct(F.when(good, F.col("field_order"))).alias("orders"))
    why = F.when(F.col("n") == 0, "no values").when(F.col("orders") == 0, "no format fits").when(F.col("orders") > 1, "day and month cannot be told apart")
    return best.select("column", F.when(F.col("orders") == 1, F.col("best")).alias("format"), why.alias("why"))


@dataclass(frozen=True)
class Template:
    """A check for a data class; ``violates`` and ``scope`` take the column and the slots."""

    template_id: str
    data_class: str
    violates: object
    rule_type: str = "format"
    severity: str = "P3_monitor"


TEMPLATES = [
    Template("not_blank", "any", lambda c, slots: f.is_blank(c), "not_null"),
    Template("edge_space", "text", lambda c, slots: c.cast("string") != f.trimmed(c)),
    Template("control", "text", lambda c, slots: c.cast("string").rlike(r"\p{Cc}")),
    Template("sentinel", "text", lambda c, slots: f.is_sentinel(f.text(c)), "sentinel"),
    Template("pattern", "text", lambda c, slots: ~f.trimmed(c).rlike(slots["pattern"]), "format", "P2_alert"),
    Template("email", "email", lambda c, slots: ~f.is_valid_email(c), "format", "P2_alert"),
    Template("mobile", "phone", lambda c, slots: ~f.is_au_mobile(f.au_phone_digits(c)), "format", "P2_alert"),
    Template("phone_placeholder", "phone", lambda c, slots: f.is_phone_placeholder(c), "sentinel", "P2_alert"),
    Template("name_placeholder", "name", lambda c, slots: f.is_name_placeholder(c), "sentinel", "P2_alert"),
    Template("name_length", "name", lambda c, slots: F.length(c) > 40),
    Template("digits", "identifier", lambda c, slots: ~f.trimmed(c).rlike("^[0-9]+$"), "format", "P2_alert"),
    Template("date_parses", "date", lambda c, slots: F.try_to_timestamp(f.trimmed(c), F.lit(slots["format"])).isNull(), "format", "P2_alert"),
    Template("date_future", "date", lambda c, slots: F.try_to_timestamp(f.trimmed(c), F.lit(slots["format"])) > slots["as_of"], "format", "P2_alert"),
    Template("negative", "number", lambda c, slots: c.try_cast("double") < 0),
    Template("number", "number", lambda c, slots: c.try_cast("double").isNull(), "format", "P2_alert"),
]


def expand_templates(bindings: Sequence[tuple[str, str, str, Column | None]], by_hand: set[tuple[str, str]] = frozenset(), slots: Mapping[tuple[str, str], Mapping] | None = None) -> list[Rule]:
    """(table, column, data class, scope) bindings -> shadow rules; columns with hand-written rules and templates whose slots are unknown are passed over."""
    out: list[Rule] = []
    for table, column, data_class, scope in bindings:
        if (table, column) in by_hand:
            continue
        for t in TEMPLATES:
            if t.data_class not in ("any", data_class) and not (t.data_class == "text" and data_class in ("email", "phone", "name", "identifier")):
                continue
            try:
                violates = t.violates(F.col(column), (slots or {}).get((table, column), {}))
            except KeyError:
                continue
            within = None if t.rule_type == "not_null" else f.present(F.col(column))
            if scope is not None:
                within = scope if within is None else within & scope
            out.append(RowRule(f"T_{table}_{column}_{t.template_id}", table, within, t.severity, status="shadow", rule_type=t.rule_type, column=column, violates=violates))
    return out


#: Shapes that a text column should not carry.
LEAKS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"(\+?61|0)[ -]?[2-478]([ -]?[0-9]){8}", "long_number": r"[0-9]{9,}"}


def leak_scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column, shape, rows of any table whose text has the shape."""
    aggs = [F.count_if(F.col(c).rlike(p)).alias(f"{c}__{k}") for c in columns for k, p in LEAKS.items()]
    cells = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("shape"), F.col(f"{c}__{k}").alias("rows")) for c in columns for k in LEAKS]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def pseudonyms(values: DataFrame, kind: str) -> DataFrame:
    """Value -> KIND_n, numbered by first sight (value, seen). Ranks come per range of the values' order, not from one sorted task."""
    first = values.groupBy("value").agg(F.min("seen").alias("seen")).where("value is not null")
    # read twice below, so it is kept: another run of it could cut the ranges elsewhere
    ranged = checkpointed(first.repartitionByRange("seen", "value").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_base")  # a row per partition
    n = F.row_number().over(Window.partitionBy("_p").orderBy("seen", "value")) + F.col("_base")
    return ranged.join(F.broadcast(before), "_p").select("value", F.concat(F.lit(f"{kind.upper()}_"), n.cast("string")).alias("pseudonym"))


#: Bytes above which a table is not scanned in full every day.
SCAN_LIMIT = 200_000_000_000


def scan_cost(tables: DataFrame) -> DataFrame:
    """Seconds of a full scan of ``bytes`` (4 and one for each 160 MB), a label, and whether a daily full scan is allowed."""
    s = 4.0 + F.col("bytes").cast("double") / 160e6
    near = F.concat(F.lit("about "), (F.bround(s / 5) * 5).cast("int").cast("string"), F.lit(" s"))
    label = F.when(F.col("bytes").isNull(), "size unknown").when(F.col("bytes") > SCAN_LIMIT, "too large for a daily full scan").when(s < 10, "under 10 s").when(s < 90, near).otherwise(F.concat(F.lit("about "), F.bround(s / 60).cast("int").cast("string"), F.lit(" min")))
    return tables.withColumns({"seconds": F.round(s, 1), "label": label, "allowed": F.col("bytes") <= SCAN_LIMIT})


def row_key_of(columns: Sequence[str], primary_key: Sequence[str] = ()) -> list[str]:
    """The declared key, else the first column whose name says that it is one, else the first column."""
    named = [c for c in columns if c.lower().endswith(("id", "key"))]
    return list(primary_key) or named[:1] or list(columns[:1])


def suggest_row_key(df: DataFrame, primary_key: Sequence[str] = (), lg: int = SKETCH) -> DataFrame:
    """Per column how many values are distinct, their share of the rows (NULL without rows), and whether it is the suggested key; counted by ``count_columns``."""
    out = count_columns(df, {"rows": ("count(*)", "sum")}, {c: {"v": F.col(c)} for c in df.columns}, lg)
    return out.select("column", "distinct_count", F.try_divide(F.col("distinct_count").cast("double"), F.col("rows")).alias("ratio"), F.col("column").isin(*row_key_of(df.columns, primary_key)).alias("suggested"))
