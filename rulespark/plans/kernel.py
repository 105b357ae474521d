"""Vectorised matching of batches of inputs with many rules.

Operands of a column get ranks: the i-th smallest is 2 * i + 1. An input that equals it has the same code, one between two
operands the even number between theirs, a missing one -1. Every condition is then a comparison of integers, whatever the
type. Rules are kept in a chain of nodes: each node indexes those of its rules that use its key column by the codes of that
column, and hands those that leave it blank to the next node. Candidates are tried in rule order, a few at first, then
more, and only for rows that have no match yet.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import Any

import numpy as np
import pyarrow as pa

from rulespark.functions.predicates import ZERO
from rulespark.model import Column, ColumnType, Op

NONE = np.iinfo(np.int32).max
MISSING = -1
FIRST, GROWTH = 32, 8  # candidates tried at first, and how many times more in each further round
PAIRS = 1 << 20  # rows times candidates compared at a time
INDEXED = 16  # rules from which on a node has a key

COMPARE = {
    Op.EQ: np.equal,
    Op.NE: np.not_equal,
    Op.GT: np.greater,
    Op.GTE: np.greater_equal,
    Op.LT: np.less,
    Op.LTE: np.less_equal,
}


def storable(value: Any, column: Column, kind: str) -> Any:
    """An operand as numbers or text that compare as the type does."""
    if column.type is ColumnType.DATE:
        return (value - ZERO[ColumnType.DATE]).days
    if column.type is ColumnType.TIMESTAMP:
        import datetime as dt

        return (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    if column.type is ColumnType.BOOLEAN:
        return int(value)
    return float(value) if kind == "double" else value


class Operands:
    """The operands of one column: ranks of its points and, by rule, their codes."""

    def __init__(self, column: Column, kind: str, values: list, which: np.ndarray):
        """``values``: the distinct operands; ``which``: their number for each rule, -1 for blank."""
        self.column, self.blank = column, which < 0
        zero = ZERO.get(column.type)
        parts = [v if column.op.is_set or column.op.is_range else (v,) for v in values]
        # an empty element of a set stands for a missing input
        parts = [[zero if x is None else x for x in p] for p in parts]
        plain = [[None if x is None else storable(x, column, kind) for x in p] for p in parts]
        self.points = sorted({x for p in plain for x in p if x is not None})
        rank = {x: 2 * i + 1 for i, x in enumerate(self.points)} | {None: MISSING}
        codes = [sorted({rank[x] for x in p}) if column.op.is_set else [rank[x] for x in p] for p in plain]
        safe = np.maximum(which, 0)
        if column.op.is_set:
            # rules by the codes that their sets hold
            sizes = np.array([len(c) for c in codes] or [0])[safe] * ~self.blank
            rule = np.repeat(np.arange(len(which)), sizes)
            flat = np.array([c for x in which.tolist() if x >= 0 for c in codes[x]], np.int64)
            order = np.lexsort((rule, flat))
            self.code, self.rule = flat[order].astype(np.int32), rule[order].astype(np.int32)
            self.pair = self.code.astype(np.int64) * len(which) + self.rule
        else:
            table = np.array(codes or [[0] * (2 if column.op.is_range else 1)], np.int32)
            self.low, self.high = table[safe, 0], table[safe, -1]

    def nbytes(self) -> int:
        own = sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))
        return own + sum(64 + (len(p) if isinstance(p, str) else 16) for p in self.points)

    def encode(self, x: pa.Array) -> np.ndarray:
        """Codes of inputs that are ready to compare (no nulls where the type has a zero)."""
        null = np.asarray(x.is_null().to_numpy(zero_copy_only=False))
        if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) or pa.types.is_decimal(x.type):
            coded = x.dictionary_encode()
            own = [self._place(v) for v in coded.dictionary.to_pylist()]
            out = np.array([*own, MISSING], np.int32)[np.where(null, len(own), coded.indices.fill_null(0).to_numpy())]
            return out
        if pa.types.is_boolean(x.type) or pa.types.is_date(x.type):
            x = x.cast(pa.int32()).cast(pa.int64()) if pa.types.is_date(x.type) else x.cast(pa.int64())
        elif pa.types.is_timestamp(x.type):
            x = x.cast(pa.timestamp("us", x.type.tz)).cast(pa.int64())
        values = x.fill_null(0).to_numpy(zero_copy_only=False)
        points = np.array(self.points, np.float64 if values.dtype.kind == "f" else np.int64)
        at = np.searchsorted(points, values)
        equal = (at < len(points)) & (points[np.minimum(at, max(0, len(points) - 1))] == values) if len(points) else np.zeros(len(values), bool)
        return np.where(null, MISSING, 2 * at + equal).astype(np.int32)

    def _place(self, value: Any) -> int:
        at = bisect_left(self.points, value)
        return 2 * at + (at < len(self.points) and self.points[at] == value)

    def holds(self, x: np.ndarray, rule: np.ndarray) -> np.ndarray:
        """Whether inputs of codes ``x`` meet the conditions of ``rule``, one by one."""
        op = self.column.op
        if op.is_set:
            ask = x.astype(np.int64) * len(self.blank) + rule
            at = np.minimum(np.searchsorted(self.pair, ask), max(0, len(self.pair) - 1))
            member = self.pair[at] == ask if len(self.pair) else np.zeros(len(x), bool)
            met = member if op is Op.IN else ~member
        elif op.is_range:
            low, high = self.low[rule], self.high[rule]
            met = {
                Op.BETWEEN_INCLUSIVE: lambda: (x >= low) & (x <= high),
                Op.BETWEEN_EXCLUSIVE: lambda: (x > low) & (x < high),
                Op.NOT_BETWEEN_INCLUSIVE: lambda: (x < low) | (x > high),
                Op.NOT_BETWEEN_EXCLUSIVE: lambda: (x <= low) | (x >= high),
            }[op]()
        else:
            met = COMPARE[op](x, self.low[rule])
        return met | self.blank[rule]

    def by_code(self, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and rules, in the order of both, of those of ``rules`` that an equality or membership names."""
        if self.column.op.is_set:
            own = np.zeros(len(self.blank), bool)
            own[rules] = True
            take = own[self.rule]
            return self.code[take], self.rule[take]
        own = rules[~self.blank[rules]]
        order = np.lexsort((own, self.low[own]))
        return self.low[own][order], own[order]


class Node:
    """Some rules, by the codes of a key column; or, without a key, in their order."""

    def __init__(self, rules: np.ndarray, operands: list[Operands], free: set[int]):
        self.rules, self.key, self.rest = rules, None, None
        best = len(rules)
        for i in free if len(rules) >= INDEXED else ():
            if operands[i].column.op in (Op.EQ, Op.IN):
                codes, named = operands[i].by_code(rules)
                left = int(operands[i].blank[rules].sum())
                # candidates that an input has to expect
                cost = left + len(named) / max(1, len(np.unique(codes)))
                if cost < 0.75 * best or (self.key is not None and cost < best):
                    best, self.key = cost, i
        if self.key is not None:
            self.codes, self.named = operands[self.key].by_code(rules)
            blank = rules[operands[self.key].blank[rules]]
            self.rules = None
            self.rest = Node(blank, operands, free - {self.key}) if len(blank) else None

    def candidates(self, codes: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rules, and for each row where its own begin and end among them."""
        if self.key is None:
            return self.rules, np.zeros(len(rows), np.int64), np.full(len(rows), len(self.rules))
        x = codes[self.key][rows]
        return self.named, np.searchsorted(self.codes, x), np.searchsorted(self.codes, x, "right")


class Kernel:
    """Rules ``start`` to ``end`` of a table, ready to match batches."""

    def __init__(self, columns: list, operand_codes: list, start: int, end: int):
        """``columns``: (Column, Spark type of its operands); ``operand_codes``: (distinct operands, number by rule)."""
        self.start, self.n = start, end - start
        self.operands = [Operands(c, kind, values, which[start:end]) for (c, kind), (values, which) in zip(columns, operand_codes, strict=True)]
        # conditions that most rules have come first: they leave the others few pairs
        self.order = sorted(range(len(self.operands)), key=lambda i: int(self.operands[i].blank.sum()))
        self.root = Node(np.arange(self.n, dtype=np.int32), self.operands, set(range(len(self.operands))))

    def nbytes(self) -> int:
        return sum(o.nbytes() for o in self.operands) + 16 * self.n

    def _met(self, codes, row, rule, key):
        """Which pairs of rows and rules meet all conditions."""
        alive = np.arange(len(row))
        for i in self.order:
            if i != key and len(alive):
                alive = alive[self.operands[i].holds(codes[i][row[alive]], rule[alive])]
        return alive

    def first(self, codes: list[np.ndarray], size: int) -> np.ndarray:
        """The order number of each row's first rule; NONE without one."""
        best, node = np.full(size, NONE, np.int64), self.root
        while node is not None:
            rows = np.arange(size)
            rules, begin, end = node.candidates(codes, rows)
            at, step = begin.copy(), FIRST
            while len(rows):
                # no candidate behind the best match so far is of use
                open_ = at < end
                open_[open_] = rules[at[open_]] < best[rows[open_]]
                rows, at, end = rows[open_], at[open_], end[open_]
                for cut in np.array_split(np.arange(len(rows)), -(-len(rows) * step // PAIRS) or 1):
                    count = np.minimum(end[cut] - at[cut], step)
                    to = np.concatenate([[0], np.cumsum(count)])
                    own = np.repeat(np.arange(len(cut)), count)
                    rule = rules[np.arange(to[-1]) - to[own] + at[cut][own]]
                    alive = self._met(codes, rows[cut][own], rule, node.key)
                    np.minimum.at(best, rows[cut][own[alive]], rule[alive])
                at = at + step
                step *= GROWTH
            node = node.rest
        return np.where(best == NONE, NONE, best + self.start)

    def every(self, codes: list[np.ndarray], size: int):
        """(row, order number) of every match, some rows at a time, in order."""
        for lo in range(0, size, max(1, PAIRS // max(1, self.n))):
            block = np.arange(lo, min(size, lo + max(1, PAIRS // max(1, self.n))))
            found_row, found, node = [], [], self.root
            while node is not None:
                rules, begin, end = node.candidates(codes, block)
                to = np.concatenate([[0], np.cumsum(end - begin)])
                own = np.repeat(np.arange(len(block)), end - begin)
                rule = rules[np.arange(to[-1]) - to[own] + begin[own]]
                alive = self._met(codes, block[own], rule, node.key)
                found_row.append(block[own[alive]])
                found.append(rule[alive])
                node = node.rest
            row, rule = np.concatenate(found_row), np.concatenate(found)
            order = np.lexsort((rule, row))
            yield row[order], rule[order] + self.start

    def encode(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """Codes of a batch's input columns __x0, __x1, ..."""
        return [o.encode(batch.column(f"__x{i}")) for i, o in enumerate(self.operands)]

