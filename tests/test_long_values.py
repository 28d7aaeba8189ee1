"""Patterns of the rule packs on values of any length: a group that gives back what it took would need a stack frame for each part."""

import re

from pyspark.sql import functions as F

from assaykit.functions import packs, scalar
from assaykit.operators import checks

N = 60_000


def test_emails_of_many_parts(spark):
    values = ["a@b.c", "a.b@c.d.e", "a@b", ".a@b.c", "a..b@c.d", "a@b.c.", "a@b..c", "a b@c.d", "a@b@c.d", "@b.c", "a@.c", ""]
    df = spark.createDataFrame([(v, "short") for v in values], "v string, kind string")
    made = dict(df.select("v", scalar.is_valid_email(F.col("v"))).collect())
    assert made == {v: bool(re.match(scalar.EMAIL, v)) for v in values}
    long = spark.range(1).select(F.concat(F.lit("a@"), F.repeat(F.lit("b."), N), F.lit("c")).alias("good"), F.concat(F.repeat(F.lit("b."), N), F.lit("c@d")).alias("bad"))
    assert tuple(long.select(scalar.is_valid_email(F.col("good")), scalar.is_valid_email(F.col("bad"))).first()) == (True, False)


def _violations(spark, rules, df):
    df = df.withColumns({"trimmed": F.trim("c"), "washed": scalar.au_phone_digits(F.col("c"))})
    return {r["rule_id"]: r["violation_count"] for r in checks.measure(spark, rules, {"t": df}).collect()}


def test_names_of_many_words(spark):
    df = spark.range(1).select(F.explode(F.array(F.repeat(F.lit("Ann "), N), F.concat(F.repeat(F.lit("Ann "), N), F.lit("7")), F.lit("Ann-Lee O'Neil"), F.lit("Ann--Lee"))).alias("c"))
    assert _violations(spark, packs.name("t", "c", "X"), df)["X_STRUCTURE"] == 2
    assert _violations(spark, packs.name_migration("t", "c", "X", status="c"), df)["X_STRUCTURE"] == 2


def test_strict_addresses_of_many_labels(spark):
    good, bad = F.concat(F.lit("a@b"), F.repeat(F.lit(".c-d"), N)), F.concat(F.lit("a@b"), F.repeat(F.lit(".c-"), N))
    df = spark.range(1).select(F.explode(F.array(good, bad, F.lit("a@b-c.de"), F.lit("a@b.c-"))).alias("c"))
    assert _violations(spark, packs.email_migration("t", "c", "X", r"corp\.example"), df)["X_MALFORMED"] == 2
