"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is fitted from confirmed toxic documents (P) and unlabelled ones (U). With class
prior pi its risk is pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1)); while the second part is below zero, the step
goes against it instead, so the model can't fit U beyond what P explains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import fold, ship, table
from .wordhash import U, lists, slices, words

FIT_TOXIC = 4000  # confirmed toxic documents that the model is fitted on, at most
FIT_UNLABELLED = 12_000  # unlabelled documents, at most
BITS = 20
KEPT = 4000  # words that take part, picked by how much commoner they are in P than in U
STEPS = 400
THRESHOLD = 0.7


def word_slots(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None):
    """Distinct slots of the words of each row, and each row's range of them; only slots that are ``wanted``."""
    h, ranges, _, _ = words(data, offs)
    slot = (h >> U(64 - BITS)).astype(np.int64)
    key = np.repeat(np.arange(len(ranges) - 1), np.diff(ranges)) << BITS | slot
    key = np.unique(key if wanted is None else key[wanted[slot]])
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(len(ranges)))


def _slots(batches):
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column("text")):
            slot, ranges = word_slots(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("kind").slice(lo, hi - lo), lists(slot.astype(np.int32), ranges)], ["kind", "slots"])


def risk_step(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the non-negative risk by the outputs for P and U, and the risk of the negative part."""
    sp, su = 1 / (1 + np.exp(-g_p)), 1 / (1 + np.exp(-g_u))
    soft = lambda t: np.logaddexp(0, t)
    negative = soft(g_u).mean() - prior * soft(g_p).mean()
    dp_pos = -prior * (1 - sp) / len(g_p)
    dp_neg, du_neg = -prior * sp / len(g_p), su / len(g_u)
    if negative >= 0:
        return dp_pos + dp_neg, du_neg, negative
    return -dp_neg, -du_neg, negative


class Sparse:
    """Rows of slots, each with value 1."""

    def __init__(self, slot: np.ndarray, ranges: np.ndarray):
        self.slot, self.row, self.n = slot, np.repeat(np.arange(len(ranges) - 1), np.diff(ranges)), len(ranges) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.slot], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.slot, weights=g[self.row], minlength=size)


def fit(slots: np.ndarray, ranges: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS) -> dict:
    """Weights by slot (zero where a word takes no part) and bias, from rows of slots; ``positive`` marks P."""
    rows = np.repeat(np.arange(len(positive)), np.diff(ranges))
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    size = 1 << BITS
    c_p = np.bincount(slots[positive[rows]], minlength=size)
    c_u = np.bincount(slots[~positive[rows]], minlength=size)
    a, b = (c_p + 0.5) / (n_p + 1), (c_u + 0.5) / (n_u + 1)
    z = (np.log(a) - np.log(b)) / np.sqrt(1 / (c_p + 0.5) + 1 / (c_u + 0.5))
    kept = np.flatnonzero((c_p + c_u >= 3) & (np.abs(z) > 3))
    kept = kept[np.argsort(-np.abs(z[kept]), kind="stable")[:KEPT]]
    place = np.full(size, -1, np.int64)
    place[kept] = np.arange(len(kept))
    own = place[slots]
    part = lambda mark: Sparse(own[(own >= 0) & mark[rows]], np.concatenate([[0], np.cumsum(np.bincount(rows[(own >= 0) & mark[rows]], minlength=len(mark))[mark])]))
    P, N = part(positive), part(~positive)
    w, bias = np.zeros(len(kept)), np.log(prior / (1 - prior))
    m1, m2, t1, t2 = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0.9, 0.99
    for step in range(1, steps + 1):
        dp, du, _ = risk_step(P.dot(w) + bias, N.dot(w) + bias, prior)
        g = np.append(P.back(dp, len(kept)) + N.back(du, len(kept)) + 1e-5 * w, dp.sum() + du.sum())
        m1, m2 = t1 * m1 + (1 - t1) * g, t2 * m2 + (1 - t2) * g * g
        move = 0.1 * (m1 / (1 - t1**step)) / (np.sqrt(m2 / (1 - t2**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(size, np.float32)
    weights[kept] = w
    return {"weights": weights, "bias": float(bias)}


def fit_on(docs: DataFrame, labels: DataFrame, learn) -> dict | None:
    """The model of the documents where ``learn`` holds; None without a confirmed toxic one."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    stats = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not stats["toxic"]:
        return None
    prior = float(np.clip(stats["toxic"] / stats["n"], 0.005, 0.9))
    rows = docs.where(learn & F.col("text").isNotNull())
    order = [F.xxhash64(F.lit(7), "doc_id"), F.col("doc_id")]
    ids_p = marks.where("toxic = 1").select("doc_id").orderBy(*order).limit(FIT_TOXIC)
    ids_u = rows.select("doc_id").distinct().orderBy(*order).limit(FIT_UNLABELLED)
    # one row of each id, so repeated ids don't widen the sample
    pick = lambda ids, kind: rows.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.lit(kind).alias("kind"), "text")
    sample = pick(ids_p, 1).unionAll(pick(ids_u, 0)).mapInArrow(_slots, "kind int, slots array<int>").toArrow()
    if not sample.num_rows:
        return None
    kind = sample.column("kind").to_numpy()
    column = sample.column("slots").combine_chunks()
    ranges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return fit(column.flatten().to_numpy().astype(np.int64), ranges, kind == 1, prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs``, learned from the labels of the documents where ``learn``
    holds (default: crc32(doc_id as text) mod 3 is not 1).

    Null and empty texts get the score of a text without telling words. An empty table gives no rows. Without any toxic label all scores are 0.
    Repeated rows are scored each; a document labelled twice counts as toxic if one label says so.
    """
    spark = docs.sparkSession
    ship(spark)
    model = fit_on(docs.select("doc_id", "text"), labels, fold("doc_id", 3) != 1 if learn is None else learn)
    # read by the plan that is returned, so it stays until the session ends
    model = spark.sparkContext.broadcast(model or {"weights": np.zeros(1 << BITS, np.float32), "bias": -np.inf})

    def run(batches):
        weights, bias = model.value["weights"], model.value["bias"]
        wanted = weights != 0
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                slot, ranges = word_slots(data, offs, wanted)
                g = Sparse(slot, ranges).dot(weights.astype(np.float64)) + bias
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(g, -700, 700))) * np.isfinite(g))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
