"""Score DataFrames, single records and base-plus-variant batches with compiled rules."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespark.functions.predicates import holds
from rulespark.model import Decision, EvaluationError
from rulespark.operators.lifecycle import STORED, CompiledRules, LoadOptions, load_rules
from rulespark.plans.strategies import BROADCAST_BYTES, CASE_RULES, by_join, case_order, choose, fresh, kernel_matches, kernel_of, kernel_order, output_type, prepared, rule_condition

STRATEGIES = ("case", "kernel", "equi", "nested_loop")


def outputs_table(rules: CompiledRules) -> pa.Table:
    """rule_ord, rule_id and outputs of all rules; decimals as their text."""
    names, arrays = ["rule_ord", "rule_id"], [pa.array(np.arange(len(rules), dtype=np.int32)), pa.array(rules.ids, pa.string())]
    for c in rules.outputs:
        values, which = rules.table[c.name]
        names.append(c.name)
        arrays.append(pa.array(values, STORED[c.type]).take(pa.array(np.maximum(which, 0), mask=which < 0)))
    return pa.table(arrays, names)


def outputs_schema(rules: CompiledRules) -> T.StructType:
    return T.StructType.fromDDL(", ".join(["rule_ord int", "rule_id string", *[f"`{c.name}` {output_type(c)}" for c in rules.outputs]]))


def with_outputs(rules: CompiledRules, scored: DataFrame, ord_name: str) -> DataFrame:
    """Outputs of the rules of order number ``ord_name`` instead of it; columns of the same names are replaced. No row
    moves: outputs are broadcast, to a join if they are small, else to Python workers that look them up."""
    table, schema = outputs_table(rules), outputs_schema(rules)
    made = {n.lower() for n in table.column_names[1:]}
    kept = [c for c in scored.columns if c.lower() not in made and c != ord_name]
    spark = scored.sparkSession
    if table.nbytes <= BROADCAST_BYTES:
        ours = F.broadcast(spark.createDataFrame(table, schema))
        number = fresh("__rule_ord", scored)
        out = scored.select(*[F.col(f"`{c}`") for c in kept], F.col(ord_name).alias(number)).join(ours.withColumnRenamed("rule_ord", number + "_"), F.col(number) == F.col(number + "_"), "left")
        return out.drop(number, number + "_")
    shared = spark.sparkContext.broadcast(table.drop_columns(["rule_ord"]))

    def look_up(batches):
        for batch in batches:
            found = shared.value.take(batch.column("__ord"))
            yield pa.RecordBatch.from_arrays([batch.column("__row"), *[x.combine_chunks() for x in found.columns]], ["__row", *found.column_names])

    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row")
    given = scored.select(row, F.col(ord_name).alias("__ord"))
    out = given.mapInArrow(look_up, T.StructType([given.schema["__row"], *schema.fields[1:]]))
    return out.select(*[F.col("__row")[c].alias(c) for c in kept], *[F.col(f"`{f.name}`") for f in schema.fields[1:]])


def score(rules: CompiledRules, df: DataFrame, strategy: str | None = None, on_no_match: str = "null", shared=None, null_policy: str = "zero") -> DataFrame:
    """``df`` with rule_id and the outputs of each row's first matching rule; nulls without one.

    ``strategy``: case, kernel, equi or nested_loop (default: chosen by the rules). ``on_no_match='error'``: fail
    instead. ``null_policy='unmatched'``: a row in which an input that some rule tests is null or absent matches no rule.
    Columns of ``df`` that clash with rule_id or an output are replaced.
    """
    strategy = strategy or choose(rules, df)
    name = fresh("__ord", df)
    if strategy == "case":
        scored = df.select(*[F.col(f"`{c}`") for c in df.columns], case_order(rules, df).alias(name))
    elif strategy == "kernel":
        scored = kernel_order(rules, df, name, shared)
    elif strategy in STRATEGIES:
        scored = by_join(rules, df, strategy, name)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    if null_policy == "unmatched":
        have = {c.lower(): c for c in df.columns}
        tested = [have.get(c.name.lower()) for c, _, _ in prepared(rules, df)]
        whole = F.lit(None not in tested)
        for c in filter(None, tested):
            whole = whole & F.col(f"`{c}`").isNotNull()
        scored = scored.withColumn(name, F.when(whole, F.col(name)))
    elif null_policy != "zero":
        raise ValueError(f"unknown null policy: {null_policy}")
    if on_no_match == "error":
        scored = scored.withColumn(name, F.coalesce(name, F.raise_error(F.lit("No matching rule found for input")).cast("int")))
    return with_outputs(rules, scored, name)


def planned_once(df: DataFrame) -> DataFrame:
    """``df`` with its plan run up to the last shuffle, so that every later step finds the same rows in the same partitions.
    Else each step plans anew: a sort samples other bounds, and adaptive execution combines other partitions."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its rows' numbers from 0, in the order of its partitions; counts of partitions are collected."""
    df = planned_once(df)
    local = fresh("__at", df)
    given = df.withColumn(local, F.monotonically_increasing_id())
    counts = {r["p"]: r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    begins, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        begins.append(total)
        total += counts.get(p, 0)
    begin = F.get(F.array(*[F.lit(b).cast("long") for b in begins]), F.shiftright(local, 33).cast("int")) if begins else F.lit(0)
    return given.withColumn(name, begin + F.col(local).bitwiseAND(F.lit((1 << 33) - 1))).drop(local)


def score_bulk(rules: CompiledRules, base: dict[str, Any], variants: DataFrame, ordinal: str | None = None, **options) -> DataFrame:
    """Score ``variants``, each laid over ``base``: a null or absent cell takes the base's value. ``ordinal`` names a
    column for the variants' numbers from 0, by which results can be put back in their order."""
    over = numbered(variants, ordinal) if ordinal else variants
    have = {c.lower() for c in variants.columns}
    kinds = {c.name.lower(): c.type for c in rules.inputs}
    for name, value in base.items():
        v = F.lit(value) if name.lower() not in kinds else F.lit(value).cast(kinds[name.lower()].value)
        over = over.withColumn(name, F.coalesce(F.col(f"`{name}`"), v) if name.lower() in have else v)
    return score(rules, over, **options)


def evaluate(rules: CompiledRules, record: dict[str, Any]) -> Decision:
    """The decision for one record, on the driver; EvaluationError without a match."""
    for rule in rules.rules:
        if all(holds(c, record.get(c.name), rule.operands[c.name]) for c in rules.inputs):
            if rule.rule_id is None:
                raise EvaluationError("the matching rule has no id")
            outputs = {c.name: v for c in rules.outputs if (v := rule.outputs[c.name]) is not None}
            return Decision(rule.rule_id, outputs, tuple(c.name for c in rules.inputs if rule.operands[c.name] is not None))
    raise EvaluationError("No matching rule found for input")


def evaluate_bulk(rules: CompiledRules, base: dict[str, Any], variants: list[dict[str, Any]]) -> list[Decision]:
    """Decisions in the order of the variants; EvaluationError if one has none."""
    return [evaluate(rules, {**base, **v}) for v in variants]


def match_all(rules: CompiledRules, df: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """key, rank (from 1), rule_id of every rule that matches each row, best first; the first ``k`` if given."""
    if len(rules) <= CASE_RULES:
        columns = prepared(rules, df)
        hits = F.array_compact(F.array(*[F.when(rule_condition(r, columns), F.lit(i)) for i, r in enumerate(rules.rules)]))
        flat = df.select(F.col(f"`{key}`"), F.posexplode(hits).alias("at", "rule_ord"))
    else:
        flat = kernel_matches(rules, df, key)
    flat = flat.where(F.col("at") < k) if k else flat
    found = with_outputs(rules, flat.withColumnRenamed("rule_ord", "__ord"), "__ord")
    return found.select(F.col(f"`{key}`"), (F.col("at") + 1).alias("rank"), "rule_id")


def rule_hits(rules: CompiledRules, df: DataFrame) -> DataFrame:
    """rule_id and how many rows it decides; rules without any have 0."""
    got = score(rules, df).groupBy("rule_id").agg(F.count("*").alias("n"))
    ids = df.sparkSession.createDataFrame(outputs_table(rules).select(["rule_id"])).distinct()
    return ids.join(got, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("hits"))


class LoadedRules:
    """Rules ready to score: their index stays broadcast until ``close``. A context manager."""

    def __init__(self, spark: SparkSession, rules: CompiledRules, options: LoadOptions | None = None):
        self.spark, self.rules, self.options = spark, rules, options or LoadOptions()
        self._shared: dict = {}
        self.closed = False

    @property
    def metadata(self):
        return self.rules.metadata

    def score(self, df: DataFrame, **options) -> DataFrame:
        if self.closed:
            raise EvaluationError("these rules are closed")
        if not self.options.prewarm:
            return score(self.rules, df, strategy="case" if len(self.rules) <= CASE_RULES else "nested_loop", **options)
        strategy = choose(self.rules, df)
        if strategy != "kernel":
            return score(self.rules, df, strategy=strategy, **options)
        columns = prepared(self.rules, df)
        # operands are stored by the inputs' types, so there is an index for each
        key = tuple((c.name, kind) for c, _, kind in columns)
        if key not in self._shared:
            self._shared[key] = self.spark.sparkContext.broadcast(kernel_of(self.rules, columns))
        return score(self.rules, df, strategy="kernel", shared=self._shared[key], **options)

    def evaluate(self, record: dict[str, Any]) -> Decision:
        return evaluate(self.rules, record)

    def evaluate_bulk(self, base: dict[str, Any], variants: list[dict[str, Any]]) -> list[Decision]:
        return evaluate_bulk(self.rules, base, variants)

    def close(self) -> None:
        """Release the index on all executors; again does nothing."""
        for shared in self._shared.values():
            shared.destroy()
        self._shared.clear()
        self.closed = True

    def __enter__(self) -> LoadedRules:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def load(spark: SparkSession, path: str, options: LoadOptions | None = None) -> LoadedRules:
    return LoadedRules(spark, load_rules(spark, path), options)


def activate(spark: SparkSession, base: str, version: str, rules: CompiledRules | None = None) -> None:
    """Make a version of the rules under ``base`` the active one; ``rules``, if given, are saved as that version first."""
    if rules is not None:
        rules.save(spark, f"{base}/{version}")
    load_rules(spark, f"{base}/{version}")  # fails here rather than when used
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/_active")


def active(spark: SparkSession, base: str, options: LoadOptions | None = None) -> LoadedRules:
    return load(spark, f"{base}/{spark.read.text(f'{base}/_active').first()[0]}", options)
