"""Plans that find the order number of the first matching rule of each row.

- case: one CASE expression; no join, no shuffle, works on streams. For few rules.
- kernel: batches of inputs meet the broadcast rules in numpy; no shuffle, works on streams. For many rules.
- equi: hash join on the most selective EQ or IN column (each row meets its value and the rules that leave the column
  blank), the other conditions as residual. For rules beyond the kernel's size, or on demand.
- nested_loop: broadcast nested-loop join and the least order number. For such tables without a usable key.

Rules are broadcast only in parts of a measured size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespark.functions.predicates import condition, input_value, literal_condition, operand_type
from rulespark.model import Column, ColumnType, EvaluationError, Op
from rulespark.operators.lifecycle import CompiledRules
from rulespark.plans.kernel import NONE, Kernel

CASE_RULES = 64
KERNEL_BYTES = 512 << 20  # of a kernel's arrays; each Python worker holds them
BROADCAST_BYTES = 64 << 20  # of the rules that a join broadcasts at a time

ARROW = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "decimal(38,18)": pa.decimal128(38, 18),
    "boolean": pa.bool_(),
    "date": pa.date32(),
    "timestamp": pa.timestamp("us", "UTC"),
}


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def prepared(rules: CompiledRules, df: DataFrame):
    """Input columns that some rule tests, with what they compare and the operands' Spark type."""
    kinds = {f.name.lower(): (f.name, f.dataType.simpleString()) for f in df.schema.fields}
    out = []
    for c in rules.inputs:
        if (rules.table[c.name][1] >= 0).any():
            name, kind = kinds.get(c.name.lower(), (None, None))
            kind = "decimal" if kind and kind.startswith("decimal") else kind
            out.append((c, input_value(c, F.col(f"`{name}`") if name else None, kind), operand_type(c, kind)))
    return out


def rule_condition(rule, columns):
    terms = [literal_condition(c, x, rule.operands[c.name], kind) for c, x, kind in columns if rule.operands[c.name] is not None]
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def case_order(rules: CompiledRules, df: DataFrame):
    """The order number as one expression; null without a match."""
    columns = prepared(rules, df)
    out = None
    for i, rule in enumerate(rules.rules):
        out = (F if out is None else out).when(rule_condition(rule, columns), F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def number(value, kind: str):
    return float(value) if kind == "double" and value is not None else value


def operand_arrays(c: Column, kind: str, values: list, which: np.ndarray) -> list[pa.Array]:
    """By rule: operand, lower bound or array of elements; then the upper bound, or whether a set has an empty element.
    Null: blank."""
    take = pa.array(np.maximum(which, 0), mask=which < 0)
    if c.op.is_set:
        arrays = pa.array([[number(x, kind) for x in v if x is not None] for v in values], pa.list_(ARROW[kind]))
        return [arrays.take(take), pa.array([None in v for v in values], pa.bool_()).take(take)]
    if c.op.is_range:
        return [pa.array([number(v[k], kind) for v in values], ARROW[kind]).take(take) for k in (0, 1)]
    return [pa.array([number(v, kind) for v in values], ARROW[kind]).take(take), pa.nulls(len(which), ARROW[kind])]


def rules_table(rules: CompiledRules, columns) -> pa.Table:
    """rule_ord and, for input i, a<i> (operand, lower bound or array), b<i> (upper bound), e<i> (a set with an empty
    element); null: blank."""
    names, arrays = ["rule_ord"], [pa.array(np.arange(len(rules), dtype=np.int32))]
    for i, (c, _, kind) in enumerate(columns):
        names += [f"a{i}", f"e{i}" if c.op.is_set else f"b{i}"]
        arrays += operand_arrays(c, kind, *rules.table[c.name])
    return pa.table(arrays, names)


def frame_condition(columns, skip: int = -1):
    terms = []
    for i, (c, _, _) in enumerate(columns):
        if i != skip:
            x, a = F.col(f"__x{i}"), F.col(f"a{i}")
            terms.append(a.isNull() | condition(c, x, a, None if c.op.is_set else F.col(f"b{i}"), F.col(f"e{i}") if c.op.is_set else False))
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def key_column(rules: CompiledRules, columns) -> int | None:
    """The EQ or IN column with which an input has the fewest rules to expect: those that leave it blank, and the others
    by its distinct values."""
    best = None
    for i, (c, _, kind) in enumerate(columns):
        if c.op in (Op.EQ, Op.IN) and kind != "double":
            values, which = rules.table[c.name]
            if c.op is Op.IN and any(None in v for v in values):
                continue
            blank = int((which < 0).sum())
            distinct = len({x for v in values for x in v}) if c.op is Op.IN else len(values)
            cost = blank + (len(rules) - blank) / max(1, distinct)
            if cost < len(rules) and (best is None or cost < best[0]):
                best = (cost, i)
    return best[1] if best else None


def kernel_of(rules: CompiledRules, columns) -> Kernel:
    return Kernel([(c, kind) for c, _, kind in columns], [rules.table[c.name] for c, _, _ in columns], 0, len(rules))


def choose(rules: CompiledRules, df: DataFrame) -> str:
    if len(rules) <= CASE_RULES:
        return "case"
    columns = prepared(rules, df)
    if rules_table(rules, columns).nbytes <= KERNEL_BYTES or df.isStreaming:
        return "kernel"
    return "equi" if key_column(rules, columns) is not None else "nested_loop"


def parts(spark: SparkSession, rules: CompiledRules, columns) -> list[DataFrame]:
    """The rules as frames of at most BROADCAST_BYTES each."""
    whole = rules_table(rules, columns)
    n = max(1, -(-whole.nbytes // BROADCAST_BYTES))
    cuts = np.linspace(0, whole.num_rows, n + 1).astype(int)
    shape = ", ".join(["rule_ord int", *[f"a{i} array<{kind}>, e{i} boolean" if c.op.is_set else f"a{i} {kind}, b{i} {kind}" for i, (c, _, kind) in enumerate(columns)]])
    schema = T.StructType.fromDDL(shape)
    return [spark.createDataFrame(whole.slice(a, b - a), schema) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def by_join(rules: CompiledRules, df: DataFrame, strategy: str, ord_name: str) -> DataFrame:
    """``df`` with the order number of each row's first rule, null without one.

    Only the least number of each row is wanted, so partial aggregation leaves one row an input in each task before the
    shuffle by the row's own number.
    """
    if df.isStreaming:
        raise EvaluationError("streams are scored with the case or kernel strategy, or batch by batch")
    columns = prepared(rules, df)
    key = key_column(rules, columns) if strategy == "equi" else None
    if strategy == "equi" and key is None:
        raise EvaluationError("no EQ or IN column that a hash join could use")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    rows = df.select(row, *[x.alias(f"__x{i}") for i, (_, x, _) in enumerate(columns)], F.monotonically_increasing_id().alias("__id"))
    found = [_met(rows, F.broadcast(frame), columns, key) for frame in parts(df.sparkSession, rules, columns)]
    met = reduce(DataFrame.unionAll, found)
    if "map<" in df.schema.simpleString():  # maps are no grouping keys
        first = met.groupBy("__id").agg(F.min("rule_ord").alias("__ord"), F.first("__row").alias("__row"))
    else:
        first = met.groupBy("__id", "__row").agg(F.min("rule_ord").alias("__ord"))
    return first.select(*[F.col("__row")[c].alias(c) for c in df.columns], F.col("__ord").alias(ord_name))


def _met(rows: DataFrame, frame: DataFrame, columns, key: int | None) -> DataFrame:
    """(__id, __row, rule_ord) of every match; rows without one appear with null."""
    if key is None:
        return rows.join(frame, frame_condition(columns), "left").select("__id", "__row", "rule_ord")
    c = columns[key][0]
    values = F.explode(F.col(f"a{key}")) if c.op is Op.IN else F.col(f"a{key}")
    bound = frame.where(F.col(f"a{key}").isNotNull()).withColumn("__key", values).withColumn("__wild", F.lit(False))
    free = frame.where(F.col(f"a{key}").isNull()).withColumn("__key", F.lit(None)).withColumn("__wild", F.lit(True))
    free = free.withColumn("__key", F.col("__key").cast(bound.schema["__key"].dataType)).select(bound.columns)
    keyed = bound.unionAll(free).withColumn("__rk", F.struct("__wild", "__key")).drop("__wild", "__key")
    x = F.col(f"__x{key}")
    wild = F.struct(F.lit(True).alias("__wild"), F.lit(None).cast(bound.schema["__key"].dataType).alias("__key"))
    rows = rows.withColumn("__k", F.explode(F.array(F.struct(F.lit(False).alias("__wild"), x.cast(bound.schema["__key"].dataType).alias("__key")), wild)))
    met = rows.join(F.broadcast(keyed), F.col("__k").eqNullSafe(F.col("__rk")) & frame_condition(columns, key), "left")
    return met.select("__id", "__row", "rule_ord")


def by_kernel(rules: CompiledRules, df: DataFrame, work, shape: T.StructType, kept: list, shared=None) -> DataFrame:
    """``work(kernel, codes, batch)`` on each batch of ``kept`` columns and codes of the tested ones; yields batches of
    ``shape``."""
    columns = prepared(rules, df)
    if shared is None:
        shared = df.sparkSession.sparkContext.broadcast(kernel_of(rules, columns))

    def run(batches):
        kernel = shared.value
        for batch in batches:
            yield from work(kernel, kernel.encode(batch), batch)

    return df.select(*kept, *[x.alias(f"__x{i}") for i, (_, x, _) in enumerate(columns)]).mapInArrow(run, shape)


def kernel_order(rules: CompiledRules, df: DataFrame, ord_name: str, shared=None) -> DataFrame:
    """As ``by_join``, in numpy on batches."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")

    def work(kernel, codes, batch):
        first = kernel.first(codes, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(first.astype(np.int32), mask=first == NONE)], ["__row", "__ord"])

    shape = T.StructType([T.StructField("__row", df.schema), T.StructField("__ord", T.IntegerType())])
    out = by_kernel(rules, df, work, shape, [row], shared)
    return out.select(*[F.col("__row")[c].alias(c) for c in df.columns], F.col("__ord").alias(ord_name))


def kernel_matches(rules: CompiledRules, df: DataFrame, key: str) -> DataFrame:
    """key, at (from 0), rule_ord of every match."""

    def work(kernel, codes, batch):
        for row, rule in kernel.every(codes, batch.num_rows):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            at = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(rule.astype(np.int32))], [key, "at", "rule_ord"])

    shape = T.StructType([df.schema[key], T.StructField("at", T.IntegerType()), T.StructField("rule_ord", T.IntegerType())])
    return by_kernel(rules, df, work, shape, [F.col(f"`{key}`")])


def output_type(c: Column) -> str:
    return "string" if c.type is ColumnType.DECIMAL else c.type.value
