"""Rule tables as text: rows of cells cut at commas outside parentheses, and the values of cells."""

from __future__ import annotations

import datetime as dt
import io
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from pathlib import Path
from typing import Any

from rulespark.model import Column, ColumnType, Op

TRUE_WORDS = {"true", "1", "yes"}


@dataclass(frozen=True)
class CsvFile:
    """A file of rules; with a session, in any store that Spark reads."""

    path: str
    spark: Any = field(default=None, compare=False)
    format: str = "CSV"

    @property
    def name(self) -> str:
        return Path(self.path).name

    def open(self):
        if self.spark is None:
            return open(self.path, encoding="utf-8")
        try:
            return io.StringIO(self.spark.read.text(self.path, wholetext=True).first()[0])
        except Exception as e:
            raise OSError(f"can't read {self.path}: {e}") from e


@dataclass(frozen=True)
class CsvText:
    text: str
    name: str = "rules.csv"
    format: str = "CSV"

    def open(self):
        return io.StringIO(self.text)


class Rows:
    """A source that holds rows of cells rather than text: the header, the operators, then the rules."""

    format = "ROWS"

    def __init__(self, rows: Iterable, name: str = "rules"):
        self.name, self._rows = name, rows

    def rows(self) -> Iterator[tuple[int, list[str]]]:
        for number, row in enumerate(self._rows() if callable(self._rows) else self._rows, 1):
            yield number, ["" if cell is None else str(cell).strip() for cell in row]


def frame_rules(df, operators: dict[str, str], order: str | None = None, name: str = "rules") -> Rows:
    """Rules as rows of a DataFrame, such as a database table read over JDBC: a column of text cells for each column of
    the table. ``operators`` gives each its operator, ``order`` the column whose ascending order is that of the rules."""
    columns = list(operators)
    chosen = (df.orderBy(order) if order else df).select(*[df[c].cast("string") for c in columns])

    def rows():
        yield columns
        yield [operators[c] for c in columns]
        for batch in chosen.toArrow().to_batches(10_000):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    return Rows(rows, name)


def json_rules(text: str, name: str = "rules.json") -> Rows:
    """Rules as a JSON object: ``columns`` and ``operators`` (lists of text), ``rules`` (a list of lists of cells)."""
    doc = json.loads(text)
    return Rows([doc["columns"], doc["operators"], *doc["rules"]], name)


def split_cells(line: str, row: int) -> list[str]:
    if "(" not in line and ")" not in line:
        return [cell.strip() for cell in line.split(",")]
    cells, depth, start = [], 0, 0
    for m in re.finditer(r"[(),]", line):
        ch = m[0]
        depth += (ch == "(") - (ch == ")")
        if depth < 0:
            break
        if ch == "," and not depth:
            cells.append(line[start : m.start()].strip())
            start = m.end()
    if depth:
        raise OSError(f"Unbalanced parentheses at row {row}")
    return [*cells, line[start:].strip()]


def read_rows(source) -> Iterator[tuple[int, list[str]]]:
    """(row number from 1, cells) of the lines that aren't blank."""
    if hasattr(source, "rows"):
        yield from source.rows()
        return
    with source.open() as lines:
        for number, line in enumerate(lines, 1):
            if line.strip():
                yield number, split_cells(line.rstrip("\r\n"), number)


def scalar(text: str, kind: ColumnType) -> Any:
    if kind is ColumnType.STRING:
        return text
    if kind is ColumnType.INTEGER:
        return int(text)
    if kind is ColumnType.BOOLEAN:
        return text.lower() in TRUE_WORDS
    if kind is ColumnType.DATE:
        return dt.date.fromisoformat(text)
    if kind is ColumnType.TIMESTAMP:
        at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    try:
        return Decimal(text)
    except InvalidOperation:
        raise ValueError(f"not a decimal: {text}") from None


def inside(text: str) -> str:
    if not (text.startswith("(") and text.endswith(")")):
        raise ValueError(f"not in parentheses: {text}")
    return text[1:-1]


def operand(text: str, column: Column) -> Any:
    """The operand of a cell; None for a blank one. An empty element of a set is None: it stands for a missing input."""
    if not text:
        return None
    if column.op.is_range:
        parts = [p.strip() for p in inside(text).split(",", 1)]
        if len(parts) != 2 or not all(parts):
            raise ValueError(f"a range has two bounds: {text}")
        return tuple(scalar(p, column.type) for p in parts)
    if column.op.is_set:
        parts = [p.strip() for p in inside(text).split(",")]
        while parts and not parts[-1]:
            parts.pop()
        return tuple(dict.fromkeys(scalar(p, column.type) if p else None for p in parts))
    return scalar(text, column.type)


def output(text: str, column: Column) -> Any:
    """The value that a SET cell gives: decimals keep their text; blank: none."""
    if not text:
        return None
    if column.type is ColumnType.DECIMAL:
        scalar(text, column.type)
        return text
    return scalar(text, column.type)


def column_type(name: str, op: Op, schema) -> ColumnType:
    if op is Op.RULE_ID:
        return ColumnType.STRING
    if op is Op.PRIORITY:
        return ColumnType.INTEGER
    return schema.columns[name]
