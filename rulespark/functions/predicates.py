"""Conditions as Columns and in plain Python, with the same rules for missing inputs.

A missing INTEGER, BOOLEAN or DATE input counts as 0, false or 1970-01-01. For INTEGER columns, numbers with a fraction
are cut toward zero, those beyond 64 bits count as the least or greatest such number, and NaN counts as missing. A missing STRING (or an empty one), DECIMAL
or TIMESTAMP lies below every operand and equals none, but an empty element of a set.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column as C
from pyspark.sql import functions as F

from rulespark.model import Column, ColumnType, EvaluationError, Op

ZERO = {ColumnType.INTEGER: 0, ColumnType.BOOLEAN: False, ColumnType.DATE: dt.date(1970, 1, 1)}
LARGEST = 2**63 - 1
#: What a condition on a missing input comes to, for types without a zero.
IF_MISSING = {Op.NE: True, Op.NOT_IN: True, Op.LT: True, Op.LTE: True, Op.NOT_BETWEEN_INCLUSIVE: True, Op.NOT_BETWEEN_EXCLUSIVE: True}


def input_value(column: Column, x: C | None, found: str | None) -> C:
    """The input of a condition, ready to compare; ``found``: its Spark type, None if the table has no such column."""
    kind = column.type
    if x is None:
        x = F.lit(None).cast(kind.value)
    elif kind is ColumnType.STRING:
        x = F.nullif(x.cast("string"), F.lit(""))
    elif kind is ColumnType.INTEGER:
        if found in ("string", "boolean", "date", "timestamp", "timestamp_ntz"):
            raise EvaluationError(f"{column.name}: {found} is no number")
        x = whole_number(x, found)
    elif kind is ColumnType.DECIMAL:
        x = x if found in ("double", "float") else x.cast("decimal(38,18)")
    elif kind in (ColumnType.BOOLEAN, ColumnType.DATE) and found != kind.value and not (kind is ColumnType.DATE and str(found).startswith("timestamp")):
        raise EvaluationError(f"{column.name}: {found} instead of {kind.value}")
    else:
        x = x.cast(kind.value)
    return F.coalesce(x, F.lit(ZERO[kind])) if kind in ZERO else x


def whole_number(x: C, found: str | None) -> C:
    if found in ("tinyint", "smallint", "int", "bigint"):
        return x.cast("bigint")
    bound = lambda v: F.lit(float(v)) if found in ("double", "float") else F.lit(str(v)).cast("decimal(38,0)")
    inside = F.when(x >= bound(LARGEST), F.lit(LARGEST)).when(x <= bound(-LARGEST - 1), F.lit(-LARGEST - 1)).otherwise(x.try_cast("bigint"))
    return F.when(~F.isnan(x), inside) if found in ("double", "float") else inside


def operand_type(column: Column, found: str | None) -> str:
    return "double" if column.type is ColumnType.DECIMAL and found in ("double", "float") else column.type.value


def condition(column: Column, x: C, low: C, high: C | None = None, has_empty: C | bool = False) -> C:
    """``low``: the operand (of ranges the lower bound, of sets the array of elements but empty ones). Never null."""
    op = column.op
    made = {
        Op.EQ: lambda: x == low,
        Op.NE: lambda: x != low,
        Op.GT: lambda: x > low,
        Op.GTE: lambda: x >= low,
        Op.LT: lambda: x < low,
        Op.LTE: lambda: x <= low,
        Op.BETWEEN_INCLUSIVE: lambda: (x >= low) & (x <= high),
        Op.BETWEEN_EXCLUSIVE: lambda: (x > low) & (x < high),
        Op.NOT_BETWEEN_INCLUSIVE: lambda: (x < low) | (x > high),
        Op.NOT_BETWEEN_EXCLUSIVE: lambda: (x <= low) | (x >= high),
        Op.IN: lambda: F.array_contains(low, x),
        Op.NOT_IN: lambda: ~F.array_contains(low, x),
    }[op]()
    if op.is_set:
        empty = has_empty if isinstance(has_empty, C) else F.lit(bool(has_empty))
        if column.type in ZERO:
            zero = empty & (x == F.lit(ZERO[column.type]))
            return (made | zero) if op is Op.IN else (made & ~zero)
        return F.coalesce(made, empty if op is Op.IN else ~empty)
    return F.coalesce(made, F.lit(IF_MISSING.get(op, False)))


def literal_condition(column: Column, x: C, operand: Any, kind: str) -> C:
    """The condition of one rule, its operand as constants."""
    lit = lambda v: F.lit(v).cast(kind)
    if column.op.is_range:
        return condition(column, x, lit(operand[0]), lit(operand[1]))
    if column.op.is_set:
        real = [v for v in operand if v is not None]
        empty = F.lit(len(real) < len(operand))
        hit = x.isin([lit(v) for v in real]) if real else F.lit(False)
        if column.type in ZERO:
            hit = hit | (empty & (x == F.lit(ZERO[column.type])))
        else:
            hit = F.when(x.isNull(), empty).otherwise(hit)
        return hit if column.op is Op.IN else ~hit
    return condition(column, x, lit(operand))


def holds(column: Column, x: Any, operand: Any) -> bool:
    """The same in plain Python, for one input; the tests' yardstick."""
    kind = column.type
    if operand is None:
        return True
    if kind is ColumnType.STRING:
        x = None if x is None or str(x) == "" else str(x)
    if kind is ColumnType.INTEGER and x is not None:
        if isinstance(x, (str, bool)):
            raise EvaluationError(f"{column.name}: {x!r} is no number")
        x = None if x != x else max(-LARGEST - 1, min(LARGEST, int(x) if abs(x) <= LARGEST else LARGEST if x > 0 else -LARGEST - 1))
    if kind is ColumnType.DECIMAL and x is not None:
        from decimal import Decimal

        x = Decimal(str(x))
    if kind in ZERO:
        x = ZERO[kind] if x is None else x
        operand = tuple(ZERO[kind] if v is None else v for v in operand) if column.op.is_set else operand
    op = column.op
    if op.is_set:
        return (x in operand) == (op is Op.IN)
    if x is None:
        return IF_MISSING.get(op, False)
    if op.is_range:
        a, b = operand
        return {Op.BETWEEN_INCLUSIVE: a <= x <= b, Op.BETWEEN_EXCLUSIVE: a < x < b, Op.NOT_BETWEEN_INCLUSIVE: x < a or x > b, Op.NOT_BETWEEN_EXCLUSIVE: x <= a or x >= b}[op]
    return {Op.EQ: x == operand, Op.NE: x != operand, Op.GT: x > operand, Op.GTE: x >= operand, Op.LT: x < operand, Op.LTE: x <= operand}[op]
