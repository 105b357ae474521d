"""validate, compile, save and load decision tables."""

from __future__ import annotations

import json
from array import array
from dataclasses import asdict, dataclass, replace
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from rulespark.model import Column, ColumnType, CompileError, LoadError, Metadata, Op, Rule, Schema, operator_of
from rulespark.sources.rules_csv import column_type, operand, output, read_rows

FORMAT_VERSION = 2
FORMATS = ("CSV", "ROWS")


@dataclass(frozen=True)
class ValidationResult:
    issues: tuple[str, ...]

    @property
    def ok(self) -> bool:
        return not self.issues


@dataclass(frozen=True)
class CompileOptions:
    schema: Schema
    kind: str = "PRODUCTION"
    selection: str = "AUTO"
    priority_column: str = "PRIORITY"
    priority_order: str = "desc"

    @classmethod
    def production(cls, schema: Schema) -> CompileOptions:
        return cls(schema)

    @classmethod
    def test_inclusive(cls, schema: Schema) -> CompileOptions:
        return cls(schema, kind="TEST_INCLUSIVE")

    def with_(self, **changes) -> CompileOptions:
        return replace(self, **changes)


def validate(source, schema: Schema) -> ValidationResult:
    """All that is wrong with a table, as text; never raises on its content."""
    issues: list[str] = []
    if source.format not in FORMATS:
        return ValidationResult((f"Unsupported format: {source.format}",))
    try:
        rows = list(read_rows(source))
    except (OSError, UnicodeError) as e:
        return ValidationResult((str(e),))
    if not rows:
        return ValidationResult(("Missing header row",))
    if len(rows) < 2:
        return ValidationResult(("Missing operator row",))
    (_, header), (at, tokens) = rows[0], rows[1]
    if len(header) != len(tokens):
        return ValidationResult((f"Row {at} has {len(tokens)} operators for {len(header)} columns",))
    ops: list[Op | None] = []
    for name, token in zip(header, tokens, strict=True):
        try:
            ops.append(operator_of(token) if token else None)
            if not token:
                issues.append(f"Row {at} has no operator for column {name}")
        except ValueError:
            ops.append(None)
            issues.append(f"Row {at} has an unsupported operator: {token}")
    for name, op in zip(header, ops, strict=True):
        if not name:
            issues.append("Empty column name")
        elif op not in (Op.RULE_ID, Op.PRIORITY) and name not in schema.columns:
            issues.append(f"Column {name} is not declared in the schema")
    issues += [f"Duplicate column name: {x}" for x in sorted({x for x in header if x and header.count(x) > 1})]
    if Op.RULE_ID not in ops:
        issues.append("No RULE_ID column")
    if Op.SET not in ops:
        issues.append("No SET column")
    if issues:
        return ValidationResult(tuple(issues))
    columns = [Column(n, o, column_type(n, o, schema)) for n, o in zip(header, ops, strict=True)]
    for number, cells in rows[2:]:
        if len(cells) != len(header):
            issues.append(f"Row {number} has {len(cells)} cells for {len(header)} columns")
            continue
        for c, cell in zip(columns, cells, strict=True):
            if c.op is Op.RULE_ID and not cell:
                issues.append(f"Row {number} has a blank RULE_ID")
            try:
                output(cell, c) if c.op in (Op.SET, Op.PRIORITY) else operand(cell, c)
            except ValueError as e:
                issues.append(f"Row {number}, column {c.name}: {e}")
        if not any(cell for c, cell in zip(columns, cells, strict=True) if c.op is Op.SET):
            issues.append(f"Row {number} sets no output")
    if len(rows) == 2:
        issues.append("No rules")
    return ValidationResult(tuple(issues))


@dataclass(frozen=True, eq=False)
class CompiledRules:
    """Rules in the order in which they are tried, by column: the distinct values of its cells, and the number of each
    rule's value among them (-1: blank)."""

    columns: tuple[Column, ...]
    table: dict[str, tuple[list, np.ndarray]]
    ids: list
    priorities: np.ndarray
    metadata: Metadata
    schema: Schema
    options: CompileOptions

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def inputs(self) -> list[Column]:
        return [c for c in self.columns if c.op.role == "input" and not c.test_only]

    @property
    def outputs(self) -> list[Column]:
        return [c for c in self.columns if c.op is Op.SET and not c.test_only]

    def cell(self, name: str, rule: int):
        values, which = self.table[name]
        return values[which[rule]] if which[rule] >= 0 else None

    @cached_property
    def rules(self) -> tuple[Rule, ...]:
        """The rules one by one; for tables of moderate size."""
        names = {role: [c.name for c in self.columns if c.op.role == role] for role in ("input", "output")}
        return tuple(Rule(self.ids[i], {n: self.cell(n, i) for n in names["input"]}, {n: self.cell(n, i) for n in names["output"]}, int(self.priorities[i])) for i in range(len(self)))

    def save(self, spark: SparkSession, path: str) -> None:
        """The compiled form in any store that Spark knows: rules as Parquet (a typed column for each operand or bound,
        null for blank), the rest as one JSON document beside it."""
        o = self.options
        columns = [{"name": c.name, "op": c.op.name, "type": c.type.name} for c in self.columns]
        doc = {"format_version": FORMAT_VERSION, "metadata": asdict(self.metadata), "columns": columns, "schema": {k: v.name for k, v in self.schema.columns.items()}, "options": {"kind": o.kind, "selection": o.selection, "priority_column": o.priority_column, "priority_order": o.priority_order}}
        spark.createDataFrame(self.arrow()).write.mode("overwrite").parquet(f"{path}/rules")
        spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    def arrow(self) -> pa.Table:
        """rule_ord, rule_id, priority, and for column i: v<i> (its value), of ranges v<i> and w<i>, of sets v<i> (a list)."""
        names = ["rule_ord", "rule_id", "priority"]
        arrays = [pa.array(np.arange(len(self))), pa.array(self.ids, pa.string()), pa.array(self.priorities)]
        for i, c in enumerate(self.columns):
            if c.op.role == "metadata":
                continue
            values, which = self.table[c.name]
            take, kind = pa.array(np.maximum(which, 0), mask=which < 0), STORED[c.type]
            plain = lambda v: str(v) if isinstance(v, Decimal) else v
            if c.op.is_range:
                parts = {f"{n}{i}": pa.array([plain(v[k]) for v in values], kind) for k, n in enumerate("vw")}
            elif c.op.is_set:
                parts = {f"v{i}": pa.array([list(map(plain, v)) for v in values], pa.list_(kind))}
            else:
                parts = {f"v{i}": pa.array(list(map(plain, values)), kind)}
            names += parts
            arrays += [x.take(take) for x in parts.values()]
        return pa.table(arrays, names)


# Decimals keep their digits as text.
STORED = {
    ColumnType.STRING: pa.string(),
    ColumnType.INTEGER: pa.int64(),
    ColumnType.DECIMAL: pa.string(),
    ColumnType.BOOLEAN: pa.bool_(),
    ColumnType.DATE: pa.date32(),
    ColumnType.TIMESTAMP: pa.timestamp("us", "UTC"),
}


class _Cells:
    """Cells of one column as they are read: each distinct text is parsed once."""

    def __init__(self, column: Column):
        self.column, self.known, self.values, self.which = column, {"": -1}, [], array("i")

    def add(self, text: str, row: int) -> None:
        at = self.known.get(text)
        if at is None:
            c = self.column
            try:
                value = output(text, c) if c.op is Op.SET else operand(text, c)
            except ValueError as e:
                raise CompileError(f"row {row}, column {c.name}: {e}") from e
            at = self.known[text] = len(self.values)
            self.values.append(value)
        self.which.append(at)


def compile_rules(source, options: CompileOptions) -> CompiledRules:
    """Typed rules in their order: by priority (higher first, ties and blanks-as-0 in file order) or as in the file."""
    try:
        rows = read_rows(source)
        header, tokens = (next(rows, (0, None))[1] for _ in range(2))
        if header is None or tokens is None:
            raise CompileError("a table has a header row and an operator row")
        if len(set(header)) != len(header):
            raise CompileError("duplicate column names")
        if len(tokens) < len(header):
            raise CompileError("the operator row is shorter than the header")
        try:
            columns = tuple(Column(n, o := operator_of(t), column_type(n, o, options.schema)) for n, t in zip(header, tokens, strict=False))
        except (ValueError, KeyError) as e:
            raise CompileError(f"operator row: {e}") from e
        at_id = next((i for i, c in reversed(list(enumerate(columns))) if c.op is Op.RULE_ID), None)
        if at_id is None:
            raise CompileError("no RULE_ID column")
        usable = next((i for i, c in enumerate(columns) if c.op is Op.PRIORITY and c.name == options.priority_column), None)
        cells_of = [(i, _Cells(c)) for i, c in enumerate(columns) if c.op.role != "metadata"]
        ids, priorities = [], array("q")
        for number, cells in rows:
            cells = [*cells, *[""] * (len(columns) - len(cells))]
            for i, held in cells_of:
                held.add(cells[i], number)
            ids.append(cells[at_id] or None)
            try:
                priorities.append(int(cells[usable]) if usable is not None and cells[usable] else 0)
            except ValueError as e:
                raise CompileError(f"row {number}, column {options.priority_column}: {e}") from e
    except OSError as e:
        raise CompileError(str(e)) from e
    by_priority = options.selection in ("AUTO", "PRIORITY") and usable is not None
    rank = np.array(priorities, np.int64)
    order = np.argsort(-rank if options.priority_order == "desc" else rank, kind="stable") if by_priority else np.arange(len(ids))
    table = {held.column.name: (held.values, np.array(held.which, np.int32)[order]) for _, held in cells_of}
    names = lambda role: [c.name for c in columns if c.op.role == role]
    meta = Metadata(len(ids), names("input"), names("output"), options.priority_column if usable is not None else None, options.kind, "PRIORITY" if by_priority else "FIRST_MATCH", FORMAT_VERSION)
    return CompiledRules(columns, table, [ids[i] for i in order.tolist()], rank[order], meta, options.schema, options)


@dataclass(frozen=True)
class LoadOptions:
    """``prewarm``: build and broadcast the index when loading; without it, rules are tried by a plain join."""

    prewarm: bool = True

    @classmethod
    def prewarmed(cls) -> LoadOptions:
        return cls()


def load_rules(spark: SparkSession, path: str) -> CompiledRules:
    """Rules in their compiled form, as ``save`` wrote them."""
    try:
        doc = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    except Exception as e:
        raise LoadError(f"can't read {path}: {e}") from e
    if doc.get("format_version") != FORMAT_VERSION:
        raise LoadError(f"unknown format version: {doc.get('format_version')}")
    columns = tuple(Column(c["name"], Op[c["op"]], ColumnType[c["type"]]) for c in doc["columns"])
    schema = Schema.of(**doc["schema"])
    rows = spark.read.parquet(f"{path}/rules").toArrow().sort_by("rule_ord").combine_chunks()
    if rows.num_rows != doc["metadata"]["row_count"]:
        raise LoadError(f"{path} holds {rows.num_rows} rules, not {doc['metadata']['row_count']}")
    table = {}
    for i, c in enumerate(columns):
        if c.op.role != "metadata":
            parts = [rows.column(n).combine_chunks() for n in (f"v{i}", f"w{i}") if n in rows.column_names]
            table[c.name] = _distinct(c, parts)
    return CompiledRules(columns, table, rows.column("rule_id").to_pylist(), rows.column("priority").to_numpy(), Metadata(**doc["metadata"]), schema, CompileOptions(schema, **doc["options"]))


def _distinct(c: Column, parts: list[pa.Array]) -> tuple[list, np.ndarray]:
    """Distinct values of a stored column, in the order of their first rules, and each rule's among them."""
    real = lambda v: Decimal(v) if c.type is ColumnType.DECIMAL and c.op is not Op.SET and v is not None else v
    if c.op.is_range or c.op.is_set:
        cells = parts[0].to_pylist() if c.op.is_set else list(zip(*(p.to_pylist() for p in parts), strict=True))
        known: dict = {}
        blank = (lambda v: v is None) if c.op.is_set else (lambda v: v[0] is None)
        which = np.array([-1 if blank(v) else known.setdefault(tuple(v), len(known)) for v in cells], np.int32)
        return [tuple(map(real, v)) for v in known], which
    coded = parts[0].dictionary_encode()
    return [real(v) for v in coded.dictionary.to_pylist()], coded.indices.fill_null(-1).to_numpy().astype(np.int32)
