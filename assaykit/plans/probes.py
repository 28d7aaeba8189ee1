"""Rule packs over values derived from the given tables, each with the rules' SQL.

A pack reads columns that a relation derives from real rows: ids, names and dates of the row, some of them bent in one of the ways that the pack
looks for. Spark and the oracle share that relation's SQL; every rule's scope and condition are written apart in each. Cases whose names end in a
table's name read what that table holds as it is: addresses and numbers in whole texts, lines, URLs, keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import packs, scalar
from assaykit.operators import checks
from assaykit.operators.rules import Rule

TABLES = ("customer", "orders", "part", "lineitem", "documents", "pages", "conversations", "events")


def _case(key: str, *values: str) -> str:
    """One of the expressions for each row, by the remainder of a key."""
    return f"CASE CAST({key} % {len(values)} AS INT) " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _day():
    return F.lit("2024-06-01").cast("date")


DAY = "DATE '2024-06-01'"
TRUE = "TRUE"


def there(c: str) -> str:
    return f"({c} IS NOT NULL AND trim(CAST({c} AS STRING)) <> '')"


def blank(c: str) -> str:
    return f"({c} IS NULL OR trim(CAST({c} AS STRING)) = '')"


def like(c: str, pattern: str) -> str:
    return "regexp_matches(" + c + ", '" + pattern.replace("'", "''") + "')"


def digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def national(c: str) -> str:
    d = digits(c)
    return f"(CASE WHEN {like(d, '^61[0-9]{9}$')} THEN '0' || substr({d}, 3) WHEN {like(d, '^[23478][0-9]{8}$')} THEN '0' || {d} ELSE {d} END)"


def listed(c: str, values) -> str:
    return f"{c} IN ({', '.join(chr(39) + v + chr(39) for v in values)})"


def epoch(c: str) -> str:
    return f"CAST(epoch_ms(TRY_CAST({c} AS BIGINT)) AS DATE)"


@dataclass
class Case:
    """source: SQL of the relation ``c`` that both sides read, or Spark alone where ``twin`` says it for the oracle. oracle: rule -> (scope, condition). counted: rule -> SQL of rows_scanned and violation_count."""

    rules: Callable[[], list[Rule]]
    source: str
    oracle: dict[str, tuple[str, str]]
    counted: dict[str, str] = field(default_factory=dict)
    joins: dict[str, str] = field(default_factory=dict)
    twin: str | None = None


T = "trim(c)"
S = there("c")
PHONE = _case("c_custkey", "'04' || lpad(CAST(c_custkey AS STRING), 8, '1')", "'+61 4' || lpad(CAST(c_custkey % 1000 AS STRING), 8, '7')", "'0412345678'", "'(02) 9' || lpad(CAST(c_custkey AS STRING), 7, '3')", "'1300' || lpad(CAST(c_custkey % 100 AS STRING), 6, '4')", "'04x' || CAST(c_custkey AS STRING)", "' 02 9999 1234'", "'0400000000'", "CAST(NULL AS STRING)", "''", "'4' || lpad(CAST(c_custkey % 7 AS STRING), 8, '5')", "'61299991234'")
NAME = _case("c_custkey", "'Jane'", "c_name", "'TEST'", "'Mary-Jane O''Neil'", "' Jane'", "'Ms Jane'", "'Jane Pty Ltd'", "'-Jane'", "'Jane--Lee'", "'12 High Street'", "'jane@x.com'", "repeat('x', 41)", "CAST(NULL AS STRING)", "''", "'Jane' || chr(7)", "'Estate of the late ' || c_name", "'Renée’s'", "'Ann  Lee'", "'unknown'", "'J4ne'")
BORN = _case("o_orderkey", "'31-02-1988'", "CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 00:00:00'", "'1900-01-01 00:00:00'", "'2012-0' || CAST(o_orderkey % 9 + 1 AS STRING) || '-11 10:00:00'", "'2007-06-01 00:00:00'", "'2031-01-01 00:00:00'", "''", "CAST(NULL AS STRING)", "'1913-12-31 00:00:00'", "'1980-01-01 00:00:00'", "'2010-06-01 00:00:00'", "'2010-06-02 00:00:00'")
MILLIS = _case("o_orderkey", "'0'", "'x'", "'-2208988800000'", "CAST(1300000000000 + o_orderkey * 86400000 AS STRING)", "'1900000000000'", "CAST(631152000000 + o_custkey * 3600000 AS STRING)", "'-2500000000000'", "CAST(NULL AS STRING)", "''", "'-6847840800000'", "'1275350400000'", "'253402214400000'")
LINE = _case("p_partkey", "p_name", "CAST(p_partkey % 10 AS STRING) || '  High St'", "repeat('x', 81)", "'a' || chr(7)", "'Main St '", "'Perth WA 6000'", "'4 Sydney Rd, nsw'", "CAST(p_partkey % 100 AS STRING)", "CAST(NULL AS STRING)", "'  '")
COUNT = _case("p_partkey", "'12.5'", "'-3'", "'007'", "'$1,000'", "'1e3'", "CAST(p_partkey AS STRING)", "'0'", "'none'", "'0412345678'", "'1300 123 456'", "'- 4'", "CAST(NULL AS STRING)", "'-2.5E-3'", "'.5'")

NAME_MARKS = {
    "COMPANY": like(T, r"(?i)(^|[^\p{L}])(P-L|PTY|PTY LTD)([^\p{L}]|$)"),
    "TITLE": like(T, r"(?i)^(MR|MISS|MRS|MS)\.?\s+"),
    "ADDRESS": f"({like(T, r'(?i)(^|\s)(' + packs.ADDRESS_WORDS + r')(\s|:|$)')} OR {like(T, r'(@|https?://|www\.)')})",
}

CASES: dict[str, Case] = {
    "r2_email_migration": Case(
        lambda: packs.email_migration("c", "c", "X", r"corp\.example"),
        "SELECT " + _case("c_custkey", "'u' || CAST(c_custkey AS STRING) || '@mail.com'", "'a@gmail.co'", "'b@optusnet.co'", "'no_email' || CAST(c_custkey AS STRING) || '@corp.example'", "'no-reply@x.com'", "'a..b@x.com'", "c_name || '@x.com'", "'.a@b.com'", "CAST(NULL AS STRING)", "' '", "'a@b'", "'a@yahoo.co.uk'") + " AS c FROM customer",
        {
            "NOT_NULL": (TRUE, blank("c")),
            "MALFORMED": (S, f"NOT {like(T, packs.MAIL_STRICT)} OR {like(T, r'^[.]|\.\.|[.]@')} OR {like('lower(' + T + ')', r'@(gmail|hotmail|yahoo|outlook|bigpond|optusnet)\.co$')}"),
            "GENERATED": (S, like(f"lower({T})", r"^no[_ -]?email[0-9]*@corp\.example$")), "NO_REPLY": (S, like(f"lower({T})", "no[_ -]?reply")),
        },
    ),
    "r3_phone": Case(
        lambda: packs.phone("c", "c", "l", "X"), f"SELECT {PHONE} AS c, {PHONE.replace('c_custkey %', '(c_custkey + 3) %')} AS l FROM customer",
        {"MOBILE_NOT_NULL": (TRUE, blank("c")), "MOBILE_FMT": (S, f"NOT {like('c', '^04[0-9]{8}$')}"), "LANDLINE_FMT": (there("l"), f"NOT {like('l', '^0[0-9]{9}$')}")},
    ),
    "r4_phone_washed": Case(
        lambda: packs.phone_washed("c", "c", "l", "X"), f"SELECT {PHONE} AS c, {PHONE.replace('c_custkey %', '(c_custkey + 3) %')} AS l FROM customer",
        {
            f"{name}_{rule}": (there(c) + ("" if rule == "PLACEHOLDER" else f" AND NOT {like(digits(c), '^(13|18|19)00')}"), violates)
            for c, name, good in (("c", "MOBILE", "^04[0-9]{8}$"), ("l", "LANDLINE", "^0[23478][0-9]{8}$"))
            for rule, violates in (
                ("AU_FMT", f"{like(c, r'[^0-9\s()+./-]')} OR NOT {like(national(c), good)}"), ("WASHABLE", f"{like(c, '[^0-9]')} AND NOT {like(c, r'[^0-9\s()+./-]')} AND {like(national(c), good)}"),
                ("PLACEHOLDER", f"{listed(national(c), scalar.PHONE_PLACEHOLDERS)} OR {like(digits(c), '0{7,}')}"),
            )
        },
        {"MOBILE_SHARED": f"SELECT COUNT(*), COUNT(*) FILTER (n > 10) FROM (SELECT COUNT(*) OVER (PARTITION BY {national('c')}) AS n FROM c WHERE {S})"},
    ),
    "r5_phone_migration": Case(
        lambda: packs.phone_migration("c", "c", "X"), f"SELECT {PHONE} AS c FROM customer",
        {
            "NOT_NULL": (TRUE, blank("c")), "EDGE_SPACE": (S, f"c <> {T}"), "WASHABLE": (S, f"{like(T, r'[\s()+./-]')} AND NOT {like(T, r'[^0-9\s()+./-]')}"), "UNSUPPORTED": (S, like(T, r"[^0-9\s()+./-]")),
            "INVALID": (f"{S} AND NOT {like(digits('c'), '^(13|18|19)00')}", f"NOT {like(T, r'[^0-9\s()+./-]')} AND NOT {like(national('c'), '^0[23478][0-9]{8}$')}"),
            "PLACEHOLDER": (S, listed(national("c"), scalar.PHONE_PLACEHOLDERS)), "ZEROS": (S, like(digits("c"), "0{7,}")),
        },
    ),
    "r6_name": Case(
        lambda: packs.name("c", "c", "X"), f"SELECT {NAME} AS c FROM customer",
        {
            "NOT_NULL": (TRUE, blank("c")), "PLACEHOLDER": (S, listed(f"upper({T})", scalar.NAME_PLACEHOLDERS)), "FORMATTING": (S, f"c <> {T} OR {like('c', r'\p{Cc}')} OR " + like(T, "^[-']|[-']$|[-']{2,}")),
            "CONTAMINATED": (S, " OR ".join(NAME_MARKS.values())), "LENGTH": (S, "length(c) > 40"), "STRUCTURE": (S, "NOT " + like(T, r"^\p{L}+([\p{Zs}'-]\p{L}+)*$")),
        },
    ),
    "r7_name_migration": Case(
        lambda: packs.name_migration("c", "c", "X", status="s"), f"SELECT {NAME} AS c, {_case('c_custkey', chr(39) + '5' + chr(39), chr(39) + '1' + chr(39), 'CAST(NULL AS STRING)')} AS s FROM customer",
        {
            "NOT_NULL": (TRUE, blank("c")), "EDGE_SPACE": (S, f"c <> {T}"), "CONTROL": (S, like("c", r"\p{Cc}")), "PLACEHOLDER": (S, listed(f"upper({T})", scalar.NAME_PLACEHOLDERS)),
            "PUNCTUATION_EDGE": (S, like(T, r"^[-'\x{2019}]|[-'\x{2019}]$")), "PUNCTUATION_TWICE": (S, like(T, r"\p{P}{2,}")), "TITLE": (S, NAME_MARKS["TITLE"]), "COMPANY": (S, NAME_MARKS["COMPANY"]), "ADDRESS_OR_LINK": (S, NAME_MARKS["ADDRESS"]),
            "NON_LETTER_START": (S, like(T, r"^[^\p{L}]")), "STRUCTURE": (S, "NOT " + like(T, r"^\p{L}+([\p{Zs}'\x{2019}-]\p{L}+)*$")), "LENGTH": (S, "length(c) > 40"),
            "DECEASED_NO_ESTATE": (TRUE, f"s = '5' AND coalesce(upper({T}), '') NOT LIKE '%ESTATE OF THE LATE%'"), "ESTATE_NOT_DECEASED": (S, f"upper({T}) LIKE '%ESTATE OF THE LATE%' AND coalesce(s, '') <> '5'"),
        },
    ),
    "r8_birth": Case(
        lambda: packs.birth("c", "c", "X", _day()), f"SELECT {BORN} AS c FROM orders",
        {"PARSEABLE": (S, "try_strptime(c, '%Y-%m-%d %H:%M:%S') IS NULL"), "NOT_NULL": (TRUE, blank("c"))}
        | {rule: ("d IS NOT NULL", violates) for rule, violates in (("PLAUSIBLE", "year(d) < 1920 OR year(d) > 2008"), ("FUTURE", f"d > {DAY}"), ("UNDER_14", f"d <= {DAY} AND d > {DAY} - INTERVAL 14 YEAR"), ("FROM_14_TO_17", f"d <= {DAY} - INTERVAL 14 YEAR AND d > {DAY} - INTERVAL 18 YEAR"), ("OVER_110", f"d < {DAY} - INTERVAL 110 YEAR"), ("PLACEHOLDER", "d IN (DATE '1900-01-01', DATE '1901-01-01', DATE '1970-01-01', DATE '1980-01-01')"))},
    ),
    "r9_birth_epoch": Case(
        lambda: packs.birth_epoch("c", "c", "X", _day()), f"SELECT {MILLIS} AS c FROM orders",
        {"NULL_OR_ZERO": (TRUE, f"{blank('c')} OR TRY_CAST(c AS BIGINT) = 0")}
        | {rule: ("m IS NOT NULL AND TRY_CAST(c AS BIGINT) <> 0", violates) for rule, violates in (("BEFORE_1900", "m < DATE '1900-01-01'"), ("FUTURE", f"m > {DAY}"), ("UNDER_14", f"m <= {DAY} AND m > {DAY} - INTERVAL 14 YEAR"), ("FROM_14_TO_17", f"m <= {DAY} - INTERVAL 14 YEAR AND m > {DAY} - INTERVAL 18 YEAR"), ("OVER_110", f"m < {DAY} - INTERVAL 110 YEAR"), ("PLACEHOLDER", "m IN (DATE '1900-01-01', DATE '1901-01-01', DATE '1911-11-11', DATE '1970-01-01', DATE '1980-01-01', DATE '9999-12-31')"))},
    ),
    "r11_identifier_migration": Case(
        lambda: packs.identifier("c", "c", "X", formatting=False), "SELECT " + _case("o_orderkey", "CAST(o_custkey AS STRING)", "' ' || CAST(o_custkey AS STRING)", "'K' || CAST(o_orderkey AS STRING)", "CAST(o_orderkey AS STRING)", "CAST(NULL AS STRING)", "''") + " AS c FROM orders",
        {"NOT_NULL": (TRUE, blank("c")), "NUMERIC": (S, f"NOT {like(T, '^[0-9]+$')}")},
        {"UNIQUE": f"SELECT COUNT(*), COUNT(*) FILTER (n > 1) FROM (SELECT COUNT(*) OVER (PARTITION BY {T}) AS n FROM c WHERE {S})"},
    ),
    "r12_subscription": Case(
        lambda: packs.subscription("c", "X", *"c kind product imei sim network benefit account offer bill_type first_ts initial_ts status reason closed_ts k".split()),
        "SELECT o_orderkey AS k, " + _case("o_orderkey", "'04' || lpad(CAST(o_custkey AS STRING), 8, '6')", "'service-number-unknown'", "'N/A'", "CAST(NULL AS STRING)", "'041'") + " AS c, o_orderkey % 3 AS kind, o_custkey % 2 AS product, "
        + ", ".join(f"{_case(f'(o_custkey + {i})', 'o_orderpriority', 'CAST(NULL AS STRING)', 'chr(32)')} AS {n}" for i, n in enumerate(("imei", "sim", "network", "benefit")))
        + ", o_custkey % 7 AS account, o_custkey % 5 AS offer, CASE WHEN o_orderstatus = 'O' THEN 'POSTPAID' ELSE 'PREPAID' END AS bill_type, CAST(o_orderdate AS DATE) AS first_ts, CASE WHEN o_orderkey % 11 = 0 THEN DATE '1995-01-01' ELSE CAST(o_orderdate AS DATE) END AS initial_ts, o_orderkey % 4 AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 END AS reason, CASE WHEN o_orderkey % 6 = 2 THEN CAST(o_orderdate AS DATE) END AS closed_ts FROM orders",
        {
            "SENTINEL": ("kind = 1", f"lower({T}) IN ('service-number-unknown', 'unknown', 'n/a', 'na', 'none', 'null', '')"), "FMT": ("kind = 1", f"NOT {like('c', '^04[0-9]{8}$')}"),
            "IMEI_NOT_NULL": (TRUE, blank("imei")), "SIM_NOT_NULL": ("product <> 0", blank("sim")), "NETWORK_NOT_NULL": (TRUE, blank("network")), "BENEFIT_NOT_NULL": (TRUE, blank("benefit")),
            "ACCOUNT_NOT_ZERO": (TRUE, "account = 0"), "OFFER_NOT_ZERO": ("bill_type = 'POSTPAID'", "offer = 0"), "STARTS_AGREE": (TRUE, "first_ts <> initial_ts"), "REASON_REQUIRED": ("status <> 1", "reason = 0 OR reason IS NULL"), "CLOSED_AGREES": (TRUE, "(closed_ts IS NOT NULL) <> (status = 2)"),
        },
        {"UNIQUE": f"SELECT COUNT(*), COUNT(*) FILTER (n > 1) FROM (SELECT COUNT(*) OVER (PARTITION BY c) AS n FROM c WHERE kind = 1 AND lower({T}) <> 'service-number-unknown')", "KEY_UNIQUE": "SELECT COUNT(*), COUNT(*) FILTER (n > 1) FROM (SELECT COUNT(*) OVER (PARTITION BY k) AS n FROM c)"},
    ),
    "r13_conditional_presence": Case(
        lambda: packs.conditional_presence("c", "c", "w", "X"), "SELECT " + _case("o_orderkey", "o_orderpriority", "CAST(NULL AS STRING)", "' '") + " AS c, " + _case("o_custkey", "o_orderpriority", "CAST(NULL AS STRING)", "''", "'1'") + " AS w FROM orders",
        {"REQUIRED": (there("w"), blank("c"))},
    ),
    "r14_constant": Case(
        lambda: packs.constant("c", ["c", "none", "priority"], "X"), "SELECT o_orderkey * 0 AS c, CAST(NULL AS STRING) AS none, o_orderpriority AS priority FROM orders", {},
        {f"{c}_VARIES": f"SELECT COUNT(*), CASE WHEN COUNT(DISTINCT {c}) <= 1 THEN COUNT(*) ELSE 0 END FROM c" for c in ("c", "none", "priority")},
    ),
    "r15_role": Case(
        lambda: packs.role("c", "c", "X"), "SELECT " + _case("c_custkey", "'Default'", "'default'", "CAST(NULL AS STRING)", "c_mktsegment", "' DEFAULT '", "''") + " AS c FROM customer",
        {"LOWER_CASE": (S, f"lower({T}) = 'default' AND {T} <> 'Default'"), "OTHER_VALUE": (TRUE, f"{blank('c')} OR lower({T}) <> 'default'")},
    ),
    "r16_address_dates": Case(
        lambda: packs.address_dates("c", "c", "e", "X", _day()), f"SELECT {MILLIS} AS c, {MILLIS.replace('o_orderkey %', '(o_orderkey + 5) %')} AS e FROM orders",
        {f"{n}_{rule}": (f"{c} IS NOT NULL", violates) for c, n in (("c", "START"), ("e", "END")) for rule, violates in (("SENTINEL_1753", f"{epoch(c)} = DATE '1753-01-01'"), ("BEFORE_1900", f"{epoch(c)} < DATE '1900-01-01'"))}
        | {"START_FUTURE": ("c IS NOT NULL", f"m > {DAY}"), "END_BEFORE_START": ("e IS NOT NULL AND c IS NOT NULL", f"{epoch('e')} < m")},
    ),
    "r17_gnaf": Case(
        lambda: packs.gnaf("c", "c", "X"), "SELECT " + _case("p_partkey", "'GANSW' || CAST(p_partkey AS STRING)", "'GAWA_' || CAST(p_partkey AS STRING)", "CAST(p_partkey AS STRING)", "'GAVIC1|GAVIC2'", "p_name", "CAST(NULL AS STRING)") + " AS c FROM part",
        {"NUMERIC": (S, like(T, "^[0-9]+$")), "PIPED": (S, f"{T} LIKE '%|%'"), "INVALID": (S, f"NOT {like(T, '^GA[A-Z]{2,3}[0-9]+$')} AND NOT {like(T, '^[0-9]+$')} AND {T} NOT LIKE '%|%'")},
    ),
    "r18_address_line": Case(
        lambda: packs.address_line("c", "c", "X", international="w", street_number="n"), f"SELECT {LINE} AS c, " + _case("p_partkey", "'N'", "'no'", "'Y'", "CAST(NULL AS STRING)") + " AS w, CAST(p_partkey % 100 AS STRING) AS n FROM part",
        {
            "EDGE_SPACE": (S, f"c <> {T}"), "CONTROL": (S, like("c", r"\p{Cc}")), "REPEATED_SPACES": (S, like(T, " {2,}")), "LENGTH": (S, "length(c) > 80"),
            "STATE_OR_POSTCODE": (S, f"upper(trim(w)) IN ('N', 'NO', '0', 'FALSE', 'F') AND ({like(T, r'(?i)(^|\s)(' + packs.STATES + r')(\s|$)')} OR {like(T, r'(^|\s)[0-9]{4}(\s|$)')})"),
            "STREET_NUMBER": (f"{S} AND {there('n')}", f"{T} = trim(n)"),
        },
    ),
    "r19_count_text": Case(
        lambda: packs.count_text("c", "c", "X", office=True), f"SELECT {COUNT} AS c FROM part",
        {rule: (S, violates) for rule, violates in (
            ("NO_NUMBER", f"NOT {like(T, '[0-9]')}"), ("UNIT_TEXT", f"{like(T, '[0-9]')} AND {like(T, r'[$,]|\p{L}')} AND NOT {like(T, packs.SCIENTIFIC)}"), ("DECIMAL", like(T, r"^-?[0-9]*\.[0-9]+$")), ("SCIENTIFIC", like(T, packs.SCIENTIFIC)), ("NEGATIVE", like(T, r"^-\s*[0-9]")), ("ZERO", like(T, "^0+$")),
            ("LEADING_ZERO", like(T, "^0+[1-9][0-9]*$")), ("PHONE_LIKE", like(digits("c"), "^(0[23478][0-9]{8}|61[23478][0-9]{8}|1[38]00[0-9]{6})$")), ("OUTLIER", f"{like(T, '^[0-9]+$')} AND TRY_CAST({T} AS BIGINT) > 1000"))},
    ),
    "r20_website": Case(
        lambda: packs.website("c", "c", "X"), "SELECT " + _case("c_custkey", "'http://n/a'", "'http://Nil'", "'www.x.com'", "'https://' || lower(c_name)", "'.'", "CAST(NULL AS STRING)", "c_name") + " AS c FROM customer",
        {"PLACEHOLDER": (S, listed(f"lower({T})", packs.WEBSITE_PLACEHOLDERS)), "NO_PROTOCOL": (S, f"NOT {like('lower(' + T + ')', '^https?://')} AND NOT {listed('lower(' + T + ')', packs.WEBSITE_PLACEHOLDERS)}")},
    ),
    "r21_established": Case(
        lambda: packs.established("c", "c", "X", _day()), f"SELECT {MILLIS} AS c FROM orders",
        {"INVALID": ("c IS NOT NULL", "TRY_CAST(c AS BIGINT) IS NULL"), "FUTURE": ("c IS NOT NULL AND TRY_CAST(c AS BIGINT) IS NOT NULL", f"m > {DAY}"), "PLACEHOLDER_1753": ("c IS NOT NULL", "TRY_CAST(c AS BIGINT) = -6847840800000"), "BEFORE_1900": ("c IS NOT NULL AND TRY_CAST(c AS BIGINT) IS NOT NULL", "m < DATE '1900-01-01'")},
    ),
    "r22_arbn": Case(
        lambda: packs.arbn("c", "c", "X"), "SELECT " + _case("p_partkey", "lpad(CAST(p_partkey AS STRING), 9, '1')", "CAST(p_partkey AS STRING)", "'0000'", "'Nil'", "'-'", "'x' || CAST(p_partkey AS STRING)", "p_name", "CAST(NULL AS STRING)") + " AS c FROM part",
        {"LENGTH": (S, f"{like(T, '^[0-9]+$')} AND length({T}) <> 9 AND NOT {like(T, '^0+$')}"), "NON_NUMERIC": (S, f"{like(T, '[^0-9]')} AND NOT {listed('lower(' + T + ')', packs.ARBN_PLACEHOLDERS)}"), "ZEROS": (S, like(T, "^0+$")), "PLACEHOLDER": (S, listed(f"lower({T})", packs.ARBN_PLACEHOLDERS))},
    ),
    "r24_cross_table": Case(
        lambda: packs.cross_table("c", "X", "orphans", "pairs", "totals", F.col("p"), (F.col("a"), F.col("b")), (F.col("d"), F.col("e")), (F.col("n"), F.col("m"))), "SELECT 1 AS c", {},
        {
            "ORPHAN": "SELECT COUNT(*), COUNT(*) FILTER (NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k)) FROM (SELECT CASE WHEN o_orderkey % 10 = 3 THEN -o_custkey WHEN o_orderkey % 10 = 4 THEN NULL ELSE o_custkey END AS k FROM orders)",
            "TEXT_AGREES": "SELECT COUNT(*), COUNT(*) FILTER (lower(trim(o_orderpriority)) <> lower(trim(c_mktsegment))) FROM orders, customer WHERE o_custkey = c_custkey",
            "TIME_AGREES": "SELECT COUNT(*), COUNT(*) FILTER (CAST(o_orderdate AS DATE) <> DATE '1995-01-01' + CAST(c_nationkey AS INT)) FROM orders, customer WHERE o_custkey = c_custkey",
            "TOTALS_AGREE": "SELECT 1, CASE WHEN (SELECT COUNT(DISTINCT o_custkey) FROM orders) = (SELECT COUNT(*) FROM customer) THEN 0 ELSE 1 END",
        },
        {
            "orphans": "SELECT c_custkey AS p FROM (SELECT CASE WHEN o_orderkey % 10 = 3 THEN -o_custkey WHEN o_orderkey % 10 = 4 THEN NULL ELSE o_custkey END AS k FROM orders) LEFT JOIN customer ON k = c_custkey",
            "pairs": "SELECT o_orderpriority AS a, c_mktsegment AS b, CAST(o_orderdate AS DATE) AS d, date_add(DATE '1995-01-01', CAST(c_nationkey AS INT)) AS e FROM orders JOIN customer ON o_custkey = c_custkey",
            "totals": "SELECT (SELECT COUNT(DISTINCT o_custkey) FROM orders) AS n, (SELECT COUNT(*) FROM customer) AS m",
        },
    ),
}


def words(table: str, test: str) -> tuple[str, str]:
    """SQL of the words of all whole texts that pass a test of ``w``, in both dialects."""
    gaps = r"'[ \n\t]+'"
    spark = test.replace("{digits}", "length(regexp_replace(w, '[^0-9]', ''))")
    other = test.replace("{digits}", "length(regexp_replace(w, '[^0-9]', '', 'g'))")
    return f"SELECT explode(filter(split(text, {gaps}), w -> {spark})) AS c FROM {table}", f"SELECT w AS c FROM (SELECT unnest(string_split_regex(text, {gaps})) AS w FROM {table}) WHERE {other}"


def _texts(name: str, like_case: str, sql: tuple[str, str], drop: tuple[str, ...] = ()) -> None:
    """A case with the rules and conditions of another one, over what the tables hold."""
    of = CASES[like_case]
    CASES[name] = Case(of.rules, sql[0], of.oracle, {k: v for k, v in of.counted.items() if k not in drop}, twin=sql[1])


def _same(sql: str) -> tuple[str, str]:
    return sql, sql


for _table in ("documents", "conversations"):
    _texts(f"r2_email_{_table}", "r2_email_migration", words(_table, "w LIKE '%@%'"))
    _texts(f"r5_phone_{_table}", "r5_phone_migration", words(_table, "{digits} BETWEEN 8 AND 13"))
    _texts(f"r19_numbers_{_table}", "r19_count_text", words(_table, "{digits} BETWEEN 1 AND 13"))
_texts("r7_name_documents", "r7_name_migration", (r"SELECT explode(split(text, '\n')) AS c, lang AS s FROM documents", r"SELECT unnest(string_split(text, chr(10))) AS c, lang AS s FROM documents"))
_texts("r11_identifier_events", "r11_identifier_migration", _same("SELECT CAST(user_id AS STRING) AS c FROM events"))
_texts("r11_identifier_pages", "r11_identifier_migration", _same("SELECT url AS c FROM pages"))
_texts("r20_website_pages", "r20_website", _same("SELECT url AS c FROM pages"))
_texts("r20_website_documents", "r20_website", words("documents", "w LIKE '%://%' OR w LIKE '%www.%'"))
CASES["r14_constant_documents"] = Case(
    lambda: packs.constant("c", ["c", "source", "n_chars"], "X"), "SELECT lang AS c, source, n_chars FROM documents", {},
    {f"{c}_VARIES": f"SELECT COUNT(*), CASE WHEN COUNT(DISTINCT {c}) <= 1 THEN COUNT(*) ELSE 0 END FROM c" for c in ("c", "source", "n_chars")},
)


def _query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def here(sql: str) -> DataFrame:
            """The SQL over frames of the tables; no view is left in the session."""
            text, used = sql.replace("{", "{{").replace("}", "}}"), {}
            for name in TABLES:
                named = text.replace(f" FROM {name}", f" FROM {{{name}}}").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
                if named != text:
                    used[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                text = named
            return spark.sql(text, **used)

        df = here(case.source)
        if "c" in df.columns:
            df = df.withColumns({"washed": scalar.au_phone_digits(F.col("c").cast("string")), "trimmed": F.trim(F.col("c").cast("string"))})
        return checks.measure(spark, case.rules(), {"c": df}, {name: here(sql) for name, sql in case.joins.items()}).drop("error")

    return run


def _oracle(case: Case) -> str:
    rows = [f"SELECT 'X_{rule}' AS rule_id, COUNT(*) FILTER ({scope}) AS rows_scanned, COUNT(*) FILTER (({scope}) AND ({violates})) AS violation_count FROM v" for rule, (scope, violates) in case.oracle.items()]
    rows += [f"SELECT 'X_{rule}' AS rule_id, r.a AS rows_scanned, r.b AS violation_count FROM ({sql}) r(a, b)" for rule, sql in case.counted.items()]
    extra = "*, CAST(try_strptime(CAST(c AS STRING), '%Y-%m-%d %H:%M:%S') AS DATE) AS d, CAST(epoch_ms(TRY_CAST(c AS BIGINT)) AS DATE) AS m"
    return f"WITH c AS ({case.twin or case.source}), v AS (SELECT {extra} FROM c) SELECT rule_id, CAST(rows_scanned AS BIGINT) AS rows_scanned, CAST(violation_count AS BIGINT) AS violation_count FROM ({' UNION ALL '.join(rows)})"


QUERIES = {name: _query(case) for name, case in CASES.items()}
ORACLE = {name: _oracle(case) for name, case in CASES.items()}
