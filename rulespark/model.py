"""Decision tables: types, operators, schema, rules, and the errors of each phase."""

from __future__ import annotations

import enum
import re
from dataclasses import dataclass, field
from typing import Any, Protocol


class RuleError(Exception):
    """Base of all errors of this package."""


class CompileError(RuleError): ...


class LoadError(RuleError): ...


class EvaluationError(RuleError): ...


class ColumnType(enum.Enum):
    STRING = "string"
    INTEGER = "bigint"
    DECIMAL = "decimal(38,18)"
    BOOLEAN = "boolean"
    DATE = "date"
    TIMESTAMP = "timestamp"


class Op(enum.Enum):
    EQ = "EQ"
    NE = "NE"
    GT = "GT"
    GTE = "GTE"
    LT = "LT"
    LTE = "LTE"
    BETWEEN_INCLUSIVE = "BETWEEN_INCLUSIVE"
    BETWEEN_EXCLUSIVE = "BETWEEN_EXCLUSIVE"
    NOT_BETWEEN_INCLUSIVE = "NOT_BETWEEN_INCLUSIVE"
    NOT_BETWEEN_EXCLUSIVE = "NOT_BETWEEN_EXCLUSIVE"
    IN = "IN"
    NOT_IN = "NOT_IN"
    RULE_ID = "RULE_ID"
    PRIORITY = "PRIORITY"
    SET = "SET"

    @property
    def is_range(self) -> bool:
        return "BETWEEN" in self.name

    @property
    def is_set(self) -> bool:
        return self in (Op.IN, Op.NOT_IN)

    @property
    def role(self) -> str:
        return {Op.SET: "output", Op.RULE_ID: "metadata", Op.PRIORITY: "metadata"}.get(self, "input")


# The other notations of operators.
ALIASES = {
    "=": Op.EQ,
    "!=": Op.NE,
    "NOT EQUAL": Op.NE,
    "NOT_EQUAL": Op.NE,
    ">": Op.GT,
    ">=": Op.GTE,
    "<": Op.LT,
    "<=": Op.LTE,
    "BETWEEN": Op.BETWEEN_INCLUSIVE,
    "NOT BETWEEN": Op.NOT_BETWEEN_INCLUSIVE,
    "NOT IN": Op.NOT_IN,
}


def operator_of(token: str | None) -> Op:
    if token is None:
        raise ValueError("Operator token must not be null.")
    name = re.sub(r"\s+", " ", token.strip().upper())
    if name in ALIASES:
        return ALIASES[name]
    try:
        return Op(name)
    except ValueError:
        raise ValueError(f"Unsupported operator token: {token}") from None


@dataclass(frozen=True)
class Schema:
    """Types of the columns of a table, by name; RULE_ID and PRIORITY columns need none."""

    columns: dict[str, ColumnType]
    nullable: dict[str, bool] = field(default_factory=dict)

    @classmethod
    def of(cls, **columns: ColumnType | str) -> Schema:
        return cls({k: v if isinstance(v, ColumnType) else ColumnType[v] for k, v in columns.items()})


class RuleSource(Protocol):
    """What a custom source of rules offers."""

    name: str
    format: str

    def open(self): ...


@dataclass(frozen=True)
class Column:
    name: str
    op: Op
    type: ColumnType

    @property
    def test_only(self) -> bool:
        return self.name.startswith("TEST_")


@dataclass(frozen=True)
class Rule:
    """Operands by column: None (blank: no condition), a value, (low, high), or a tuple of set elements."""

    rule_id: str
    operands: dict[str, Any]
    outputs: dict[str, Any]
    priority: int = 0


@dataclass(frozen=True)
class Metadata:
    row_count: int
    inputs: list[str]
    outputs: list[str]
    priority_column: str | None
    kind: str
    selection: str
    format_version: int = 1


@dataclass(frozen=True)
class Decision:
    rule_id: str
    outputs: dict[str, Any]
    matched: tuple[str, ...] = ()
