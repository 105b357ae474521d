"""Scoring of streams: stateless, with any number of rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from rulespark.operators.lifecycle import CompiledRules
from rulespark.operators.score import score
from rulespark.plans.strategies import CASE_RULES


def score_stream(rules: CompiledRules, stream: DataFrame) -> DataFrame:
    """A scored stream, to be written in append mode; no state, no watermark."""
    return score(rules, stream, strategy="case" if len(rules) <= CASE_RULES else "kernel")


def write_scored(rules: CompiledRules, stream: DataFrame, sink: Callable[[DataFrame, int], None]):
    """A stream writer that gives each scored micro-batch to ``sink``."""
    return score_stream(rules, stream).writeStream.foreachBatch(sink)
