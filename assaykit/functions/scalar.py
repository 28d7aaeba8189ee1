"""Scalar helpers, each Column -> Column. All but ``is_blank`` give NULL for NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, which must be these for equal verdicts.
SENTINELS = ("service-number-unknown", "unknown", "n/a", "na", "none", "null", "")
NAME_PLACEHOLDERS = (
    "N/A", "NONE", "NULL", "UNKNOWN", "NOT APPLICABLE", "NOT PROVIDED", "TBC", "TBD", "TEST", "DUMMY", "SAMPLE", "UNDEFINED", "NOT AVAILABLE",
)
PHONE_PLACEHOLDERS = (
    "0400000000", "0400000001", "0400000002", "0404040404", "0400000123", "0400000321", "0400009999", "0410000000",
    "0411000321", "0411111110", "0411111111", "0412000123", "0412345678", "0413234234", "0420000000", "0421212111",
    "0422222222", "0432100000", "0433333333", "0444444444", "0452397392", "0455555555", "0477777777", "0488888888",
    "0491570006", "0499999999", "0200000000", "0200000001", "0222222222", "0250000000", "0280000000", "0280808080",
    "0288888888", "0290000000", "0299999999", "0300000000", "0390000000", "0700000000", "0800000000", "1300000000",
    "1300300937", "133937", "1300133937", "0400011132", "0411111112", "0411111113", "0411111116", "0422226838",
)
EMAIL = r"^[^@\s.]+(\.[^@\s.]+)*@[^@\s.]+(\.[^@\s.]+)+$"
MOBILE = r"^04[0-9]{8}$"
AU_NUMBER = r"^0[23478][0-9]{8}$"


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def present(c: Column) -> Column:
    return ~is_blank(c)


def text(c: Column) -> Column:
    return c.cast("string")


def trimmed(c: Column) -> Column:
    return F.trim(c.cast("string"))


def is_valid_email(c: Column) -> Column:
    # possessive groups give nothing back, so they take no stack frame for each part of a long value; parts and dots share no character, so the same values match
    return c.rlike(EMAIL.replace(")*", ")*+").replace(")+", ")++"))


def is_au_mobile(c: Column) -> Column:
    return c.rlike(MOBILE)


def is_sentinel(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*SENTINELS)


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "")


def au_phone_digits(c: Column) -> Column:
    """Digits alone, in national form: the country code 61 becomes 0, and nine digits with an area code get their 0."""
    d = digits(c)
    return F.when(d.rlike("^61[0-9]{9}$"), F.concat(F.lit("0"), F.substring(d, 3, 9))).when(d.rlike("^[23478][0-9]{8}$"), F.concat(F.lit("0"), d)).otherwise(d)


def is_phone_placeholder(c: Column) -> Column:
    return au_phone_digits(c).isin(*PHONE_PLACEHOLDERS) | digits(c).rlike("0{7,}")


def is_name_placeholder(c: Column) -> Column:
    return F.upper(F.trim(c)).isin(*NAME_PLACEHOLDERS)


def epoch_date(c: Column) -> Column:
    """Epoch milliseconds as text -> date; NULL where it is no number."""
    return F.to_date(F.timestamp_millis(c.try_cast("bigint")))


def signature(c: Column) -> Column:
    """The shape of a value: digits 9, letters X, white space _, other signs kept; a run of n becomes c{n}."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{L}", "X"), r"\p{Nd}", "9"), r"(?U)\s", "_")
    runs = F.regexp_extract_all(shape, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(F.length(r) == 1, r).otherwise(F.concat(F.substring(r, 1, 1), F.lit("{"), F.length(r).cast("string"), F.lit("}")))), "")


def parse_date(c: Column, fmt: str) -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit(fmt)))


def younger_than(born: Column, years: int, as_of: Column) -> Column:
    """Fewer than ``years`` years old on the day ``as_of``."""
    return born > F.add_months(as_of, -12 * years)


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def normal_text(c: Column) -> Column:
    """Trimmed, lower case, runs of spaces as one; an empty text is NULL."""
    t = F.regexp_replace(F.lower(F.trim(c.cast("string"))), " +", " ")
    return F.nullif(t, F.lit(""))


#: How two values are made comparable, by the name of the comparison.
NORMAL = {
    "exact": lambda c: c,
    "text": normal_text,
    "phone_au": lambda c: F.nullif(au_phone_digits(c.cast("string")), F.lit("")),
    "day": lambda c: c.try_cast("date"),
    "number": lambda c: c.try_cast("decimal(38,6)"),
}
