"""Rules as data: what a violating row is, where the rule applies, and how much may fail."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("P1_block", "P2_alert", "P3_monitor")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str) -> str:
    """The name, or ValueError: rule ids and columns become column names of a plan."""
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def is_identifier(c: Column) -> Column:
    """B4 for a column of names."""
    return F.coalesce(c.rlike(rf"^{_IDENTIFIER.pattern}$") & ~c.contains("\n"), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """What all kinds share. ``scope`` limits a rule to some rows; NULL in a predicate is no violation."""

    rule_id: str
    table: str
    scope: Column | None = None
    severity: str = "P2_alert"
    threshold_pct: float = 0.0
    status: str = "active"
    rule_type: str = "format"
    column: str | None = None

    kind = "row_level"

    def __post_init__(self) -> None:
        identifier(self.rule_id)
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity of {self.rule_id}: {self.severity}")
        if self.column is not None:
            identifier(self.column)

    @property
    def within(self) -> Column:
        return F.lit(True) if self.scope is None else self.scope

    def shadow(self) -> Rule:
        return replace(self, status="shadow")


@dataclass(frozen=True)
class RowRule(Rule):
    """``violates`` is true for a violating row."""

    violates: Column = field(default_factory=lambda: F.lit(False))


@dataclass(frozen=True)
class UniqueRule(Rule):
    """No more than ``most`` rows in scope share ``keys``."""

    keys: tuple[str, ...] = ()
    most: int = 1
    kind = "uniqueness"


@dataclass(frozen=True)
class VarianceRule(Rule):
    """A column with one value or none over the whole relation fails in every row in scope."""

    values: str = ""
    kind = "variance"


@dataclass(frozen=True)
class JoinRule(Rule):
    """``violates`` over a named join of two or three relations; ``join`` names it, rules with one name share it."""

    join: str = ""
    violates: Column = field(default_factory=lambda: F.lit(False))
    kind = "cross_table"
