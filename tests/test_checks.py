import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaykit.functions import packs
from assaykit.functions import scalar as f
from assaykit.operators import checks, consistency, grouping, registers
from assaykit.operators.rules import RowRule, UniqueRule, identifier
from assaykit.schemas import CHECK_RUN, VIOLATION_SAMPLE
from assaykit.sources import relations
from assaykit.sources.relations import Condition, Population

VALUE = st.one_of(st.none(), st.integers(-3, 3))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(VALUE, VALUE), max_size=12), st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=5))
def test_batched_equals_one_by_one(spark, data, limits):
    df = spark.createDataFrame(data, "a int, b int")
    rules = [RowRule(f"r{i}", "t", F.col("a") > x, violates=F.col("b") > y) for i, (x, y) in enumerate(limits)]
    assert sorted(map(tuple, checks.row_level_batch(df, rules).collect())) == sorted(map(tuple, checks.one_by_one(df, rules).collect()))


def test_many_rules_stay_in_whole_stage_code(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)] + [(None, None)], "a long, b long")
    rules = [RowRule(f"r{i}", "t", F.col("a") > i % 7, violates=F.col("b") > i) for i in range(150)]
    batch = checks.row_level_batch(df, rules)
    assert sorted(map(tuple, batch.collect())) == [(r.rule_id, sum(1 for j in range(500) if j % 7 > i % 7), sum(1 for j in range(500) if j % 7 > i % 7 and j > i)) for i, r in sorted(enumerate(rules), key=lambda x: x[1].rule_id)]
    final = batch._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("HashAggregate") == 6 and re.findall(r"\*\(\d+\) HashAggregate", final).__len__() == 6
    assert len(checks.row_level_batch(df, rules, None)._jdf.queryExecution().optimizedPlan().toString().split("Aggregate ")) == 2


def test_a_bad_rule_is_the_only_error(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    rules = [RowRule("good", "t", violates=F.col("a") > 1), RowRule("bad", "t", violates=F.col("missing") > 1), RowRule("lost", "u", violates=F.lit(True))]
    got = {r.rule_id: r for r in checks.check_run(spark, rules, {"t": df}).collect()}
    assert (got["good"].violation_count, got["good"].status) == (1, "breach")
    assert got["bad"].status == got["lost"].status == "error"


def test_current_records_keep_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, 1, "N"), (1, 2, "D"), (2, 1, "D"), (2, 2, "N"), (None, 1, "N"), (None, 1, "N"), (3, None, "N"), (3, 1, None)], "k int, v int, s string")
    out = relations.current_records(df, Population(("k",), ("v",), "s", "D"))
    assert sorted(out.collect(), key=str) == sorted([(2, 2, "N"), (None, 1, "N"), (None, 1, "N"), (3, 1, None)], key=str)


@pytest.mark.parametrize("bad", [Condition("nope", "=", (1,)), Condition("k", "~", (1,)), Condition("k", "=", ("x",)), Condition("k", "in", ())])
def test_bad_slices_are_refused(spark, bad):
    with pytest.raises(ValueError):
        relations.slice_rows(spark.createDataFrame([(1,)], "k int"), [bad])


def test_identifiers():
    assert identifier("a_1") == "a_1"
    for bad in ("1a", "a b", "a;", ""):
        with pytest.raises(ValueError):
            identifier(bad)


def test_guarded_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = spark.createDataFrame([("s1", "r"), ("s2", "r"), ("s2", "q")], "sample_id string, rule_id string")
    relations.append(rows.where("sample_id = 's1'"), path, VIOLATION_SAMPLE)
    for _ in range(2):
        assert relations.guarded_append(rows, path, VIOLATION_SAMPLE, ["sample_id"]).count() == 2
    assert relations.as_schema(rows, CHECK_RUN).columns == CHECK_RUN.fieldNames()


def test_samples_take_the_scope_first(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "k int, g int")
    got = checks.uniqueness_samples(df, UniqueRule("u", "t", F.col("k") < 4, keys=("g",)), ["k"])
    assert [r.row_key for r in got.collect()] == ["0", "3"]


def test_orphans_with_null_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "c int")
    parent = spark.createDataFrame([(1,), (None,)], "p int")
    assert tuple(consistency.orphan(child, ["c"], parent, ["p"]).first()) == (3, 2)
    assert tuple(consistency.orphan(child, ["c"], parent, ["p"], "ignore").first()) == (2, 1)


def test_agreement_is_null_safe(spark):
    pairs = spark.createDataFrame([("A ", "a"), ("x", None), (None, None), ("", None), ("b", "c")], "l string, r string")
    assert tuple(consistency.agreement(pairs, F.col("l"), F.col("r"), "text").first()) == (5, 2)
    assert tuple(consistency.agreement(pairs, F.col("l"), F.col("r"), "text", "skip").first()) == (4, 1)


def test_reconcile_null_groups(spark):
    a = spark.createDataFrame([(None, 1.0), ("x", 5.0), ("y", 1.0)], "k string, v double")
    b = spark.createDataFrame([(None, 1.0), ("x", 5.4), ("z", 1.0)], "k string, v double")
    out = {r.k0: r.violates for r in consistency.reconcile(a, ("sum", "v"), b, ("sum", "v"), [("k", "k")], absolute=0.5).collect()}
    assert out == {None: False, "x": False, "y": True, "z": True}


def test_signatures(spark):
    df = spark.createDataFrame([("AB-12 c",), ("é٠",), ("",)], "v string")
    assert [r[0] for r in df.select(f.signature(F.col("v"))).collect()] == ["X{2}-9{2}_X", "X9", ""]


def test_connected_components(spark):
    edges = spark.createDataFrame([("b", "c"), ("d", "c"), ("e", "f"), ("a", "d"), ("g", "g")], "a string, b string")
    assert {r.node: r.component for r in grouping.connected(edges).collect()} == dict.fromkeys("abcd", "a") | {"e": "e", "f": "e", "g": "g"}


def failing(spark, rules, columns, values):
    """The rules that each row breaks."""
    df = spark.createDataFrame(values, columns)
    broken = F.array_compact(F.array(*[F.when(r.within & r.violates, F.lit(r.rule_id.split("_", 1)[1])) for r in rules if isinstance(r, RowRule)]))
    return [set(r[0]) for r in df.select(broken).collect()]


def day():
    return F.lit("2024-06-01").cast("date")


@pytest.mark.parametrize(("rules", "cases"), [
    (lambda: packs.name_migration("t", "c", "N", status=None), [("Ms Jane", {"TITLE"}), (" John", {"EDGE_SPACE"}), ("12 Smith Street", {"ADDRESS_OR_LINK", "NON_LETTER_START", "STRUCTURE"}), ("Mrs", set()), ("O'Brien", set()), ("N/A", {"PLACEHOLDER", "STRUCTURE"}), ("", {"NOT_NULL"}), ("-Anne", {"PUNCTUATION_EDGE", "NON_LETTER_START", "STRUCTURE"})]),
    (lambda: packs.phone_migration("t", "c", "P"), [("0412 345 679", {"WASHABLE"}), ("0412345678", {"PLACEHOLDER"}), ("61299991234", set()), ("12", {"INVALID"}), ("04x", {"UNSUPPORTED"}), (" 0299991234", {"EDGE_SPACE"}), ("0400000000", {"PLACEHOLDER", "ZEROS"}), (None, {"NOT_NULL"})]),
    (lambda: packs.email_migration("t", "c", "E", r"corp\.example"), [("a@b.com", set()), ("a@gmail.co", {"MALFORMED"}), ("no_email1@corp.example", {"GENERATED"}), ("no-reply@x.com", {"NO_REPLY"}), ("a..b@x.com", {"MALFORMED"})]),
    (lambda: packs.birth_epoch("t", "c", "B", day()), [("0", {"NULL_OR_ZERO"}), ("x", set()), ("-2208988800000", {"PLACEHOLDER", "OVER_110"}), ("1700000000000", {"UNDER_14"}), ("1900000000000", {"FUTURE"}), ("631152000000", set())]),
    (lambda: packs.birth("t", "c", "B", day()), [("31-02-1988", {"PARSEABLE"}), ("1990-01-01 00:00:00", set()), ("2007-01-01 00:00:00", {"FROM_14_TO_17"}), ("", {"NOT_NULL"})]),
    (lambda: packs.gnaf("t", "c", "G"), [("GANSW123", set()), ("GAWA_1", {"INVALID"}), ("12", {"NUMERIC"}), ("a|b", {"PIPED"})]),
    (lambda: packs.website("t", "c", "W"), [("http://n/a", {"PLACEHOLDER"}), ("www.x.com", {"NO_PROTOCOL"}), ("https://x.com", set())]),
    (lambda: packs.arbn("t", "c", "A"), [("123456789", set()), ("12", {"LENGTH"}), ("0000", {"ZEROS"}), ("nil", {"PLACEHOLDER"}), ("x1", {"NON_NUMERIC"})]),
    (lambda: packs.role("t", "c", "R"), [("Default", set()), ("default", {"LOWER_CASE"}), (None, {"OTHER_VALUE"}), ("boss", {"OTHER_VALUE"})]),
    (lambda: packs.established("t", "c", "Y", day()), [("x", {"INVALID"}), ("-6847840800000", {"PLACEHOLDER_1753", "BEFORE_1900"}), ("0", set())]),
    (lambda: packs.address_line("t", "c", "L"), [("a  b", {"REPEATED_SPACES"}), ("x" * 81, {"LENGTH"}), ("a\u0007", {"CONTROL"})]),
    (lambda: packs.name("t", "c", "M"), [("Jane", set()), ("TEST", {"PLACEHOLDER"}), ("Jane Pty", {"CONTAMINATED"})]),
])
def test_pack_probes(spark, rules, cases):
    assert failing(spark, rules(), "c string", [(v,) for v, _ in cases]) == [want for _, want in cases]


def test_pack_of_a_subscription(spark):
    names = "number kind product imei sim network benefit account offer bill_type first initial status reason closed k".split()
    rules = packs.subscription("t", "S", *names)
    df = "number string, kind int, product int, imei string, sim string, network string, benefit string, account int, offer int, bill_type string, first string, initial string, status int, reason int, closed string, k int"
    good = ("0412345671", 1, 1, "i", "s", "n", "b", 1, 1, "POSTPAID", "x", "x", 1, 0, None, 1)
    bad = ("unknown", 1, 1, "", "", "", "", 0, 0, "POSTPAID", "x", "y", 2, 0, None, 2)
    got = failing(spark, rules, df, [good, bad])
    assert got[0] == set()
    assert got[1] == {r.rule_id.split("_", 1)[1] for r in rules if isinstance(r, RowRule)}


def test_pack_of_dates_and_presence(spark):
    rules = packs.address_dates("t", "a", "b", "D", day()) + packs.conditional_presence("t", "c", "a", "D")
    got = failing(spark, rules, "a string, b string, c string", [("-6847804800000", "0", None), ("1900000000000", "0", "x"), (None, None, None)])
    assert got == [{"START_SENTINEL_1753", "START_BEFORE_1900", "REQUIRED"}, {"START_FUTURE", "END_BEFORE_START"}, set()]


def test_versions_and_packs_of_keys(spark):
    df = spark.createDataFrame([("1", " 2", "1"), ("1", "x", "1")], "k string, v string, trimmed string")
    rules = [*packs.identifier("t", "k", "K"), *packs.constant("t", ["k"], "C"), *packs.phone("t", "k", "v", "P"), *packs.conditional_presence("t", "v", "k", "Q")]
    got = {r.rule_id: r.violation_count for r in checks.measure(spark, rules, {"t": df}).collect()}
    assert got["K_UNIQUE"] == 2 and got["C_k_VARIES"] == 2 and got["K_NOT_NULL"] == 0
    assert packs.uncovered([("t", "k"), ("t", "z")], rules) == [("t", "z")]
    reg = spark.createDataFrame([("a", 1, "x"), ("a", 2, "retired"), ("b", 1, "x")], "k string, v int, status string")
    assert [r.k for r in registers.current(reg, "k", "v").collect()] == ["b"]
