"""A table of rules as SQL text."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import Any

from rulespark.functions.predicates import IF_MISSING, LARGEST, ZERO
from rulespark.model import Column, ColumnType, Op
from rulespark.operators.lifecycle import CompiledRules

SIGNS = {Op.EQ: "=", Op.NE: "<>", Op.GT: ">", Op.GTE: ">=", Op.LT: "<", Op.LTE: "<="}


def literal(value: Any) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, Decimal):
        return f"CAST('{value}' AS DECIMAL(38, 18))"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.astimezone(dt.timezone.utc):%Y-%m-%d %H:%M:%S.%f}Z'"
    if isinstance(value, dt.date):
        return f"DATE '{value}'"
    return str(value)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def operand_text(c: Column) -> str:
    """The input as it is compared; missing inputs of types with a zero count as that."""
    x = quoted(c.name)
    if c.type is ColumnType.STRING:
        return f"nullif(CAST({x} AS STRING), '')"
    if c.type is ColumnType.INTEGER:
        wide = f"CAST({x} AS DOUBLE)"
        whole = f"CASE WHEN isnan({wide}) THEN NULL WHEN {wide} >= {float(LARGEST)!r}D THEN {LARGEST} WHEN {wide} <= {float(-LARGEST)!r}D THEN {-LARGEST - 1} ELSE try_cast({x} AS BIGINT) END"
        return f"coalesce({whole}, 0)"
    x = f"CAST({x} AS {c.type.value.upper()})"
    return f"coalesce({x}, {literal(ZERO[c.type])})" if c.type in ZERO else x


def condition_text(c: Column, operand: Any) -> str:
    """One condition; never null."""
    x = operand_text(c)
    if c.op.is_set:
        real = [ZERO[c.type] if v is None else v for v in operand if v is not None or c.type in ZERO]
        hit = f"{x} IN ({', '.join(map(literal, real))})" if real else "FALSE"
        hit = f"coalesce({hit}, {'TRUE' if None in operand and c.type not in ZERO else 'FALSE'})" if c.type not in ZERO else hit
        if not real and None in operand:
            hit = f"{x} IS NULL"
        return hit if c.op is Op.IN else f"NOT ({hit})"
    if c.op.is_range:
        low, high = map(literal, operand)
        open_, inside = "EXCLUSIVE" in c.op.name, "NOT" not in c.op.name
        a, b, word = (">" if open_ else ">=", "<" if open_ else "<=", "AND") if inside else ("<=" if open_ else "<", ">=" if open_ else ">", "OR")
        made = f"({x} {a} {low} {word} {x} {b} {high})"
    else:
        made = f"{x} {SIGNS[c.op]} {literal(operand)}"
    return made if c.type in ZERO else f"coalesce({made}, {'TRUE' if IF_MISSING.get(c.op) else 'FALSE'})"


def to_sql(rules: CompiledRules, relation: str) -> str:
    """A query over ``relation`` (a table or view that has all tested columns): its columns, rule_id, and the outputs.

    Its CASE expression finds the first rule's number; the outputs are looked up in an inline table."""
    arms = []
    for i, rule in enumerate(rules.rules):
        terms = [condition_text(c, rule.operands[c.name]) for c in rules.inputs if rule.operands[c.name] is not None]
        arms.append(f"WHEN {' AND '.join(terms) if terms else 'TRUE'} THEN {i}")
    kinds = ["STRING" if c.type is ColumnType.DECIMAL else c.type.value.upper() for c in rules.outputs]
    cells = lambda r: [str(r.rule_id) if r.rule_id is None else literal(r.rule_id), *["NULL" if r.outputs[c.name] is None else literal(r.outputs[c.name]) for c in rules.outputs]]
    rows = ", ".join(f"({i}, {', '.join('NULL' if v == 'None' else v for v in cells(r))})" for i, r in enumerate(rules.rules))
    names = ["__n", "rule_id", *[quoted(c.name) for c in rules.outputs]]
    typed = ", ".join(["r.rule_id", *[f"CAST(r.{quoted(c.name)} AS {k}) AS {quoted(c.name)}" for c, k in zip(rules.outputs, kinds, strict=True)]])
    return f"SELECT s.* EXCEPT (__n), {typed} FROM (SELECT *, CASE {' '.join(arms)} END AS __n FROM {relation}) s LEFT JOIN (VALUES {rows}) AS r({', '.join(names)}) ON s.__n = r.__n"
