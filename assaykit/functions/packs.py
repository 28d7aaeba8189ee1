"""Rule packs: what can be wrong with an e-mail address, a phone number, a name ... as rules over a column of any table.

Each builder gives RowRules (and UniqueRules) whose ids begin with ``prefix``. Age and date rules take the day they are judged on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.functions import scalar as f
from assaykit.operators.rules import JoinRule, RowRule, Rule, UniqueRule, VarianceRule

P1, P2, P3 = "P1_block", "P2_alert", "P3_monitor"

# Fixed values, which must be these for equal verdicts.
MAIL_STRICT = r"^[A-Za-z0-9][A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]*@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+$"
MAIL_TYPO_DOMAINS = "gmail|hotmail|yahoo|outlook|bigpond|optusnet"
WASHABLE, UNSUPPORTED = r"[\s()+./-]", r"[^0-9\s()+./-]"
SPECIAL_SERVICE = "^(13|18|19)00"
ADDRESS_WORDS = "C/O|CARE OF|PO BOX|UNIT|SUITE|LEVEL|FLOOR|STREET|ROAD|AVENUE|DRIVE|HIGHWAY|POSTCODE|SUBURB|NOTE|NOTES"
STATES = "NSW|VIC|QLD|WA|SA|TAS|ACT|NT|NEW SOUTH WALES|VICTORIA|QUEENSLAND|WESTERN AUSTRALIA|SOUTH AUSTRALIA|TASMANIA|AUSTRALIAN CAPITAL TERRITORY|NORTHERN TERRITORY"
NOT_INTERNATIONAL = ("N", "NO", "0", "FALSE", "F")
BIRTH_PLACEHOLDERS = ("1900-01-01", "1901-01-01", "1970-01-01", "1980-01-01")
EPOCH_BIRTH_PLACEHOLDERS = ("1900-01-01", "1901-01-01", "1911-11-11", "1970-01-01", "1980-01-01", "9999-12-31")
WEBSITE_PLACEHOLDERS = ("http://n/a", "http://no", "http://none", "http://www.nowebsite.com", ".", "http://0", "http://nil", "http://----")
ARBN_PLACEHOLDERS = ("n/a", "na", "nil", "none", "-")
MIN_DATE_MS = -6847840800000
NAME_LENGTH, LINE_LENGTH, MOST_OFFICES, MOST_SHARING = 40, 80, 1000, 10
DECEASED = "5"
SCIENTIFIC = r"(?i)^-?[0-9]+(\.[0-9]+)?e[+-]?[0-9]+$"


class _Pack:
    def __init__(self, table: str, column: str, prefix: str) -> None:
        self.table, self.column, self.prefix = table, column, prefix
        self.c = F.col(column)
        self.t, self.scope = f.trimmed(self.c), f.present(self.c)
        self.rules: list[Rule] = []

    def add(self, name: str, violates: Column, severity: str = P2, rule_type: str = "format", scope: Column | None | str = "present") -> None:
        within = self.scope if isinstance(scope, str) else scope
        self.rules.append(RowRule(f"{self.prefix}_{name}", self.table, within, severity, rule_type=rule_type, column=self.column, violates=violates))

    def blank(self, severity: str = P2, name: str = "NOT_NULL") -> None:
        self.add(name, f.is_blank(self.c), severity, "not_null", None)

    def edges(self, severity: str = P3) -> None:
        self.add("EDGE_SPACE", f.text(self.c) != self.t, severity)

    def control(self, severity: str = P3) -> None:
        self.add("CONTROL", f.text(self.c).rlike(r"\p{Cc}"), severity)


def email(table: str, column: str, status: str, prefix: str) -> list[Rule]:
    """Address and its status column."""
    p = _Pack(table, column, prefix)
    p.add("FMT", ~f.is_valid_email(p.c), P1)
    p.add("NO_AT", ~p.c.contains("@"), P1)
    p.add("SPACE", p.c.rlike(r"\s"))
    p.add("NO_TLD", p.c.contains("@") & ~F.split_part(p.c, F.lit("@"), F.lit(-1)).contains("."))
    p.add("DOUBLE_DOT", p.c.contains(".."), P3)
    p.add("LAST_DOT", p.c.endswith("."), P3)
    p.blank()
    p.add("STATUS_NOT_NULL", f.is_blank(F.col(status)), P3, "not_null", None)
    p.add("STATUS_AGREES", (F.col(status) == "INVALID") & f.is_valid_email(p.c), P2, "consistency")
    return p.rules


def email_migration(table: str, column: str, prefix: str, own_domain: str) -> list[Rule]:
    """R2. own_domain: a pattern of the domain under which stand-in addresses were made."""
    p = _Pack(table, column, prefix)
    low = F.lower(p.t)
    p.blank()
    p.add("MALFORMED", ~p.t.rlike(MAIL_STRICT.replace(")+$", ")++$")) |  # possessive, as in ``scalar.is_valid_email``
          p.t.rlike(r"^[.]|\.\.|[.]@") | low.rlike(rf"@({MAIL_TYPO_DOMAINS})\.co$"))
    p.add("GENERATED", low.rlike(rf"^no[_ -]?email[0-9]*@{own_domain}$"), P2, "sentinel")
    p.add("NO_REPLY", low.rlike("no[_ -]?reply"), P2, "sentinel")
    return p.rules


def phone(table: str, mobile: str, landline: str, prefix: str) -> list[Rule]:
    """R3."""
    m, n = _Pack(table, mobile, f"{prefix}_MOBILE"), _Pack(table, landline, f"{prefix}_LANDLINE")
    m.blank()
    m.add("FMT", ~f.is_au_mobile(m.c), P3)
    n.add("FMT", ~n.c.rlike("^0[0-9]{9}$"), P3)
    return m.rules + n.rules


def phone_washed(table: str, mobile: str, landline: str, prefix: str) -> list[Rule]:
    """After washing, and a number that too many rows share. The washed number is a column ``washed`` of the relation.

    Special-service numbers are out of scope of the two format rules, as they are no subscriber's number.
    """
    out: list[Rule] = []
    for column, name, wanted in ((mobile, "MOBILE", f.MOBILE), (landline, "LANDLINE", f.AU_NUMBER)):
        p = _Pack(table, column, f"{prefix}_{name}")
        plain = p.scope & ~f.digits(p.c).rlike(SPECIAL_SERVICE)
        odd, good = p.c.rlike(UNSUPPORTED), f.au_phone_digits(p.c).rlike(wanted)
        p.add("AU_FMT", odd | ~good, P3, scope=plain)
        p.add("WASHABLE", p.c.rlike("[^0-9]") & ~odd & good, P3, scope=plain)
        p.add("PLACEHOLDER", f.is_phone_placeholder(p.c), P2, "sentinel")
        out += p.rules
    return [*out, UniqueRule(f"{prefix}_MOBILE_SHARED", table, f.present(F.col(mobile)), P3, rule_type="uniqueness", column=mobile, keys=("washed",), most=MOST_SHARING)]


def phone_migration(table: str, column: str, prefix: str) -> list[Rule]:
    """R5."""
    p = _Pack(table, column, prefix)
    fit = ~p.t.rlike(UNSUPPORTED)
    p.blank(P3)
    p.edges()
    p.add("WASHABLE", p.t.rlike(WASHABLE) & fit, P3)
    p.add("UNSUPPORTED", p.t.rlike(UNSUPPORTED))
    p.add("INVALID", fit & ~f.au_phone_digits(p.c).rlike(f.AU_NUMBER), P2, scope=p.scope & ~f.digits(p.c).rlike(SPECIAL_SERVICE))
    p.add("PLACEHOLDER", f.au_phone_digits(p.c).isin(*f.PHONE_PLACEHOLDERS), P2, "sentinel")
    p.add("ZEROS", f.digits(p.c).rlike("0{7,}"), P2, "sentinel")
    return p.rules


def name(table: str, column: str, prefix: str, presence: bool = True) -> list[Rule]:
    """R6."""
    p = _Pack(table, column, prefix)
    if presence:
        p.blank()
    p.add("PLACEHOLDER", f.is_name_placeholder(f.text(p.c)), P2, "sentinel")
    p.add("FORMATTING", (f.text(p.c) != p.t) | f.text(p.c).rlike(r"\p{Cc}") | p.t.rlike("^[-']|[-']$|[-']{2,}"), P3)
    p.add("CONTAMINATED", _contaminated(p.t) | p.t.rlike(r"(?i)^(MR|MISS|MRS|MS)\.?\s+") | _company(p.t))
    p.add("LENGTH", F.length(f.text(p.c)) > NAME_LENGTH, P3)
    p.add("STRUCTURE", ~p.t.rlike(r"^\p{L}++([\p{Zs}'-]\p{L}++)*+$"), P3)
    return p.rules


def _contaminated(t: Column) -> Column:
    return t.rlike(rf"(?i)(^|\s)({ADDRESS_WORDS})(\s|:|$)") | t.rlike(r"(@|https?://|www\.)")


def _company(t: Column) -> Column:
    return t.rlike(r"(?i)(^|[^\p{L}])(P-L|PTY|PTY LTD)([^\p{L}]|$)")


def _structured(t: Column) -> Column:
    """Words of letters with one space, hyphen or apostrophe of either kind between."""
    # possessive: a group that may give back what it took needs a stack frame for each word, and a long text has too many
    return t.rlike(r"^\p{L}++([\p{Zs}'\x{2019}-]\p{L}++)*+$")


def name_migration(table: str, column: str, prefix: str, presence: bool = True, length: bool = True, status: str | None = None) -> list[Rule]:
    """R7. status: the column that tells a deceased contact, where the estate rules apply."""
    p = _Pack(table, column, prefix)
    if presence:
        p.blank()
    p.edges()
    p.control()
    p.add("PLACEHOLDER", F.upper(p.t).isin(*f.NAME_PLACEHOLDERS), P2, "sentinel")
    p.add("PUNCTUATION_EDGE", p.t.rlike(r"^[-'\x{2019}]|[-'\x{2019}]$"))
    p.add("PUNCTUATION_TWICE", p.t.rlike(r"\p{P}{2,}"), P3)
    p.add("TITLE", p.t.rlike(r"(?i)^(MR|MISS|MRS|MS)\.?\s+"))
    p.add("COMPANY", _company(p.t))
    p.add("ADDRESS_OR_LINK", _contaminated(p.t))
    p.add("NON_LETTER_START", p.t.rlike(r"^[^\p{L}]"))
    p.add("STRUCTURE", ~_structured(p.t))
    if length:
        p.add("LENGTH", F.length(f.text(p.c)) > NAME_LENGTH, P3)
    if status:
        dead = f.text(F.col(status))
        estate = F.upper(p.t).contains("ESTATE OF THE LATE")
        p.add("DECEASED_NO_ESTATE", (dead == DECEASED) & ~F.coalesce(estate, F.lit(False)), P3, "consistency", None)
        p.add("ESTATE_NOT_DECEASED", estate & (F.coalesce(dead, F.lit("")) != DECEASED), P3, "consistency")
    return p.rules


def _ages(p: _Pack, born: Column, day: Column, scope: Column, placeholders: Sequence[str], severity: str) -> None:
    p.add("FUTURE", born > day, P2, scope=scope)
    p.add("UNDER_14", (born <= day) & f.younger_than(born, 14, day), P2, scope=scope)
    p.add("FROM_14_TO_17", ~f.younger_than(born, 14, day) & f.younger_than(born, 18, day), P3, scope=scope)
    p.add("OVER_110", born < F.add_months(day, -110 * 12), P2, scope=scope)
    p.add("PLACEHOLDER", born.isin(*[F.lit(x).cast("date") for x in placeholders]), severity, "sentinel", scope)


def birth(table: str, column: str, prefix: str, day: Column) -> list[Rule]:
    """A date of birth as text yyyy-MM-dd HH:mm:ss."""
    p = _Pack(table, column, prefix)
    born = f.parse_date(p.c, "yyyy-MM-dd HH:mm:ss")
    p.add("PARSEABLE", born.isNull(), P1)
    p.add("PLAUSIBLE", (F.year(born) < 1920) | (F.year(born) > 2008), P2, scope=born.isNotNull())
    p.blank()
    _ages(p, born, day, born.isNotNull(), BIRTH_PLACEHOLDERS, P3)
    return p.rules


def birth_epoch(table: str, column: str, prefix: str, day: Column) -> list[Rule]:
    """A date of birth as epoch milliseconds in text."""
    p = _Pack(table, column, prefix)
    born, raw = f.epoch_date(p.c), p.c.try_cast("bigint")
    scope = born.isNotNull() & (raw != 0)
    p.add("NULL_OR_ZERO", f.is_blank(p.c) | (raw == 0), P2, "not_null", None)
    p.add("BEFORE_1900", born < F.lit("1900-01-01").cast("date"), P3, scope=scope)
    _ages(p, born, day, scope, EPOCH_BIRTH_PLACEHOLDERS, P2)
    return p.rules


def identifier(table: str, column: str, prefix: str, formatting: bool = True) -> list[Rule]:
    """R10; without ``formatting`` R11. Uniqueness is of the trimmed value, a column ``trimmed`` of the relation."""
    p = _Pack(table, column, prefix)
    p.blank(P1)
    p.add("NUMERIC", ~p.t.rlike("^[0-9]+$"))
    if formatting:
        p.add("FORMATTING", (f.text(p.c) != p.t) | f.text(p.c).rlike(r"\p{Cc}"), P3)
    return [*p.rules, UniqueRule(f"{prefix}_UNIQUE", table, p.scope, P1, rule_type="uniqueness", column=column, keys=("trimmed",))]


def unique_key(table: str, column: str, prefix: str) -> list[Rule]:
    """A key that no two rows share as it stands."""
    return [UniqueRule(f"{prefix}_UNIQUE", table, None, P1, rule_type="uniqueness", column=column, keys=(column,))]


def subscription(table: str, prefix: str, number: str, kind: str, product: str, imei: str, sim: str, network: str, benefit: str, account: str, offer: str, bill_type: str, first: str, initial: str, status: str, reason: str, closed: str, key: str) -> list[Rule]:
    """A service with its number, devices, keys, dates and status."""
    p = _Pack(table, number, prefix)
    is_phone = F.col(kind) == 1
    p.add("SENTINEL", f.is_sentinel(p.c), P1, "sentinel", is_phone)
    p.add("FMT", ~f.is_au_mobile(p.c), P2, scope=is_phone)
    p.add("IMEI_NOT_NULL", f.is_blank(F.col(imei)), P3, "not_null", None)
    p.add("SIM_NOT_NULL", f.is_blank(F.col(sim)), P2, "not_null", F.col(product) != 0)
    p.add("NETWORK_NOT_NULL", f.is_blank(F.col(network)), P2, "not_null", None)
    p.add("BENEFIT_NOT_NULL", f.is_blank(F.col(benefit)), P3, "not_null", None)
    p.add("ACCOUNT_NOT_ZERO", F.col(account) == 0, P2, "sentinel", None)
    p.add("OFFER_NOT_ZERO", F.col(offer) == 0, P1, "sentinel", F.col(bill_type) == "POSTPAID")
    p.add("STARTS_AGREE", F.col(first) != F.col(initial), P3, "consistency", None)
    p.add("REASON_REQUIRED", (F.col(reason) == 0) | F.col(reason).isNull(), P2, "consistency", F.col(status) != 1)
    p.add("CLOSED_AGREES", F.col(closed).isNotNull() != (F.col(status) == 2), P2, "consistency", None)
    unique = UniqueRule(f"{prefix}_UNIQUE", table, is_phone & (F.lower(F.trim(p.c)) != SENTINEL_NUMBER), P1, rule_type="uniqueness", column=number, keys=(number,))
    return [*p.rules, unique, UniqueRule(f"{prefix}_KEY_UNIQUE", table, None, P1, rule_type="uniqueness", column=key, keys=(key,))]


SENTINEL_NUMBER = f.SENTINELS[0]


def conditional_presence(table: str, column: str, when: str, prefix: str) -> list[Rule]:
    """A value is needed where another one is there."""
    p = _Pack(table, column, prefix)
    p.add("REQUIRED", f.is_blank(p.c), P1, "consistency", f.present(F.col(when)))
    return p.rules


def constant(table: str, columns: Sequence[str], prefix: str, severity: str = P3) -> list[Rule]:
    """R14."""
    return [VarianceRule(f"{prefix}_{c}_VARIES", table, None, severity, rule_type="variance", column=c, values=c) for c in columns]


def role(table: str, column: str, prefix: str) -> list[Rule]:
    """R15."""
    p = _Pack(table, column, prefix)
    p.add("LOWER_CASE", (F.lower(p.t) == "default") & (p.t != "Default"), P3)
    p.add("OTHER_VALUE", f.is_blank(p.c) | (F.lower(p.t) != "default"), P3, "consistency", None)
    return p.rules


def address_dates(table: str, start: str, end: str, prefix: str, day: Column) -> list[Rule]:
    """R16."""
    out: list[Rule] = []
    for column, label in ((start, "START"), (end, "END")):
        p = _Pack(table, column, f"{prefix}_{label}")
        d, there = f.epoch_date(p.c), p.c.isNotNull()
        p.add("SENTINEL_1753", d == F.lit("1753-01-01").cast("date"), P3, "sentinel", there)
        p.add("BEFORE_1900", d < F.lit("1900-01-01").cast("date"), P3, scope=there)
        if label == "START":
            p.add("FUTURE", d > day, P3, scope=there)
        else:
            p.add("BEFORE_START", d < f.epoch_date(F.col(start)), P2, "consistency", there & F.col(start).isNotNull())
        out += p.rules
    return out


def gnaf(table: str, column: str, prefix: str) -> list[Rule]:
    """R17."""
    p = _Pack(table, column, prefix)
    number, piped = p.t.rlike("^[0-9]+$"), p.t.contains("|")
    p.add("NUMERIC", number, P3)
    p.add("PIPED", piped, P3)
    p.add("INVALID", ~p.t.rlike("^GA[A-Z]{2,3}[0-9]+$") & ~number & ~piped, P3)
    return p.rules


def address_line(table: str, column: str, prefix: str, length: int | None = LINE_LENGTH, international: str | None = None, street_number: str | None = None) -> list[Rule]:
    """R18."""
    p = _Pack(table, column, prefix)
    p.edges()
    p.control()
    p.add("REPEATED_SPACES", p.t.rlike(" {2,}"), P3)
    if length:
        p.add("LENGTH", F.length(f.text(p.c)) > length, P3)
    if international:
        here = F.upper(f.trimmed(F.col(international))).isin(*NOT_INTERNATIONAL)
        p.add("STATE_OR_POSTCODE", here & (p.t.rlike(rf"(?i)(^|\s)({STATES})(\s|$)") | p.t.rlike(r"(^|\s)[0-9]{4}(\s|$)")), P3, "consistency")
    if street_number:
        n = F.col(street_number)
        p.add("STREET_NUMBER", p.t == f.trimmed(n), P3, "consistency", p.scope & f.present(n))
    return p.rules


def count_text(table: str, column: str, prefix: str, office: bool) -> list[Rule]:
    """A count kept as text."""
    p = _Pack(table, column, prefix)
    p.add("NO_NUMBER", ~p.t.rlike("[0-9]"))
    p.add("UNIT_TEXT", p.t.rlike("[0-9]") & p.t.rlike(r"[$,]|\p{L}") & ~p.t.rlike(SCIENTIFIC))
    p.add("DECIMAL", p.t.rlike(r"^-?[0-9]*\.[0-9]+$"))
    p.add("SCIENTIFIC", p.t.rlike(SCIENTIFIC))
    p.add("NEGATIVE", p.t.rlike(r"^-\s*[0-9]"))
    p.add("ZERO", p.t.rlike("^0+$"), P3, "sentinel")
    if office:
        p.add("LEADING_ZERO", p.t.rlike("^0+[1-9][0-9]*$"), P3)
        p.add("PHONE_LIKE", f.digits(p.c).rlike("^(0[23478][0-9]{8}|61[23478][0-9]{8}|1[38]00[0-9]{6})$"))
        p.add("OUTLIER", p.t.rlike("^[0-9]+$") & (p.t.try_cast("bigint") > MOST_OFFICES), P3)
    return p.rules


def website(table: str, column: str, prefix: str) -> list[Rule]:
    """R20."""
    p = _Pack(table, column, prefix)
    low = F.lower(p.t)
    p.add("PLACEHOLDER", low.isin(*WEBSITE_PLACEHOLDERS), P2, "sentinel")
    p.add("NO_PROTOCOL", ~low.rlike("^https?://") & ~low.isin(*WEBSITE_PLACEHOLDERS))
    return p.rules


def established(table: str, column: str, prefix: str, day: Column) -> list[Rule]:
    """R21."""
    p = _Pack(table, column, prefix)
    d, raw, there = f.epoch_date(p.c), p.c.try_cast("bigint"), p.c.isNotNull()
    p.add("INVALID", raw.isNull(), P3, scope=there)
    p.add("FUTURE", d > day, P3, scope=there & raw.isNotNull())
    p.add("PLACEHOLDER_1753", raw == MIN_DATE_MS, P3, "sentinel", there)
    p.add("BEFORE_1900", d < F.lit("1900-01-01").cast("date"), P3, scope=there & raw.isNotNull())
    return p.rules


def arbn(table: str, column: str, prefix: str) -> list[Rule]:
    """A nine-digit registration number."""
    p = _Pack(table, column, prefix)
    zeros, placeholder = p.t.rlike("^0+$"), F.lower(p.t).isin(*ARBN_PLACEHOLDERS)
    p.add("LENGTH", p.t.rlike("^[0-9]+$") & (F.length(p.t) != 9) & ~zeros)
    p.add("NON_NUMERIC", p.t.rlike("[^0-9]") & ~placeholder)
    p.add("ZEROS", zeros, P2, "sentinel")
    p.add("PLACEHOLDER", placeholder, P2, "sentinel")
    return p.rules


def cross_table(table: str, prefix: str, orphans: str, pairs: str, totals: str, parent_key: Column, texts: tuple[Column, Column], times: tuple[Column, Column], sums: tuple[Column, Column]) -> list[Rule]:
    """A child without a parent, two agreements of matched rows, and totals that should be equal.

    orphans, pairs and totals name joins: a left join to the parent, the matched rows, and one row with both totals. Values that are NULL on a
    side agree; totals do not.
    """
    left, right = (F.lower(F.trim(c)) for c in texts)
    return [
        JoinRule(f"{prefix}_ORPHAN", table, None, P1, rule_type="referential", join=orphans, violates=parent_key.isNull()),
        JoinRule(f"{prefix}_TEXT_AGREES", table, None, P2, rule_type="consistency", join=pairs, violates=left != right),
        JoinRule(f"{prefix}_TIME_AGREES", table, None, P2, rule_type="consistency", join=pairs, violates=times[0] != times[1]),
        JoinRule(f"{prefix}_TOTALS_AGREE", table, None, P3, rule_type="reconciliation", join=totals, violates=~sums[0].eqNullSafe(sums[1])),
    ]


def universal(table: str, column: str, prefix: str) -> list[Rule]:
    """The four checks that fit any text column."""
    p = _Pack(table, column, prefix)
    p.blank(P3)
    p.edges()
    p.control()
    p.add("PLACEHOLDER", F.upper(p.t).isin(*f.NAME_PLACEHOLDERS), P3, "sentinel")
    return p.rules


def uncovered(attributes: Sequence[tuple[str, str]], rules: Sequence[Rule]) -> list[tuple[str, str]]:
    """(table, column) pairs that no rule names."""
    named = {(r.table, r.column) for r in rules}
    return [a for a in attributes if a not in named]


def on_column(rules: Sequence[Rule], table: str) -> list[Rule]:
    """The same rules for another table."""
    return [replace(r, table=table) for r in rules]
