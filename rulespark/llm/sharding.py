"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows of equal text form a group that stays whole. Groups are dealt by hash into blocks of bounded size; every block
runs differencing on its own, which leaves one partial partition (a sum per bin) with a small spread. The partial
partitions of FAN blocks at a time are then combined by the same rule in tasks, and those of FAN such again, until FAN at
most are left for the driver.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import hot, meet
from .runtime import bounded, scratch, ship, shuffle_width, small_enough, staged, table
from .wordhash import U, _C, _powers, mix, signed, slices

SHARDS = 40
GROUPS_PER_BLOCK = 50_000
ROWS_PER_CELL = 50_000
FAN = 1000  # partial partitions that one task, or the driver, combines


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of bin sums), the two of largest spread first, one's largest bins with the
    other's smallest. Returns, for each row and each of its bins, the bin of the final partition, and the final sums."""
    n, k = parts.shape
    if n == 0:
        return np.zeros((0, k), np.int32), np.zeros(k, np.int64)
    sums = [row for row in parts]
    heap = [(-int(row.max() - row.min()), i) for i, row in enumerate(sums)]
    heapq.heapify(heap)
    tree: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        oa, ob = np.argsort(sums[a], kind="stable")[::-1], np.argsort(sums[b], kind="stable")
        new = sums[a][oa] + sums[b][ob]
        tree.append((a, b, oa, ob))
        sums[a] = sums[b] = None
        sums.append(new)
        heapq.heappush(heap, (int(new.min() - new.max()), len(sums) - 1))
    where: list = [None] * len(sums)
    where[-1] = np.arange(k, dtype=np.int32)
    for i in range(len(tree) - 1, -1, -1):
        a, b, oa, ob = tree[i]
        own = where[n + i]
        where[n + i] = None
        wa, wb = np.empty(k, np.int32), np.empty(k, np.int32)
        wa[oa], wb[ob] = own, own
        where[a], where[b] = wa, wb
    return np.stack(where[:n]), sums[-1]


def _facts(batches):
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column("text")):
            rows = batch.slice(lo, hi - lo)
            up, down = _powers(len(data))
            total = np.zeros(len(data) + 1, U)
            np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
            size = np.diff(offs)
            body = (total[offs[1:]] - total[offs[:-1]]) * down[offs[:-1]]
            null = np.asarray(rows.column("text").is_null().to_numpy(zero_copy_only=False))
            key = mix(body + size.astype(U) * _C[2] + null.astype(U) * _C[5])
            mem = memoryview(np.ascontiguousarray(data))
            crc = np.array([zlib.crc32(mem[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.where(null, 0, size) + 16), pa.array(crc), pa.array(signed(key))], ["doc_id", "size", "text_crc32", "group_key"])


def text_facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32 (null: 0) and a 64-bit key of the text per row; null isn't empty."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_facts, "doc_id long, size long, text_crc32 long, group_key long")


def _plan_blocks(shards: int):
    def plan(pdf):
        pdf = pdf.sort_values("group_key", kind="stable")
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf["bytes"].to_numpy()
        where, sums = difference(parts)
        out = pdf[["block", "group_key"]].copy()
        out["bin"] = where[:, 0]
        out["sum"] = sums[where[:, 0]]
        return out

    return plan


def sums_of(rows, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order, and the sums of their bins, from rows (node, bin, sum)."""
    node, bin_, total = (rows.column(c).to_numpy() for c in ("node", "bin", "sum"))
    nodes, at = np.unique(node, return_inverse=True)
    sums = np.zeros((len(nodes), shards), np.int64)
    sums[at, bin_] = total
    return nodes, sums


def _combine(shards: int):
    def combine(rows: pa.Table) -> pa.Table:
        nodes, sums = sums_of(rows, shards)
        where, total = difference(sums)
        to = where.ravel()
        return pa.table({"node": pa.array(np.repeat(nodes, shards).astype(np.int32)), "bin": pa.array(np.tile(np.arange(shards, dtype=np.int32), len(nodes))), "parent": pa.array(np.repeat(nodes // FAN, shards).astype(np.int32)), "to": pa.array(to.astype(np.int32)), "sum": pa.array(total[to])})

    return combine


def combined(sums: DataFrame, shards: int) -> DataFrame:
    """block, bin, shard: where the bins of all blocks go. ``sums``: node, bin, sum of the blocks."""
    spark = sums.sparkSession
    level, at = sums, sums.select(F.col("node").alias("block"), "bin", "node", F.col("bin").alias("to"))
    while not small_enough(level.select("node").distinct(), FAN):
        out = staged(level.groupBy(F.expr(f"node div {FAN}")).applyInArrow(_combine(shards), "node int, bin int, parent int, to int, sum long"), "combined")
        step = out.select("node", F.col("bin").alias("to"), "parent", F.col("to").alias("next"))
        at = at.join(step, ["node", "to"]).select("block", "bin", F.col("parent").alias("node"), F.col("next").alias("to"))
        level = out.select(F.col("parent").alias("node"), F.col("to").alias("bin"), "sum").distinct()
    nodes, left = sums_of(level.toArrow().combine_chunks(), shards)  # FAN x shards rows at most
    where, _ = difference(left)
    final = spark.createDataFrame([(int(b), k, int(where[i, k])) for i, b in enumerate(nodes) for k in range(shards)], "node int, to int, shard int")
    return at.join(F.broadcast(final), ["node", "to"]).select("block", "bin", "shard")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, groups_per_block: int = GROUPS_PER_BLOCK) -> DataFrame:
    """Every row of ``docs`` with its size, text_crc32, shard and slot (0.. in its shard, without gaps).

    Equal texts share a shard, so a group larger than total/shards sets that shard's size; the rest stays even.
    Null texts form one group of size 16 a row. Ties in size are broken by the text's hash. Repeated rows get a slot each;
    null ids are kept. An empty table gives no rows.
    """
    with scratch() as keep:
        facts = staged(text_facts(docs).withColumn("turn", F.monotonically_increasing_id()), "facts")
        groups = facts.groupBy("group_key").agg(F.sum("size").alias("bytes"))
        n_blocks = max(1, -(-facts.count() // groups_per_block))
        groups = groups.withColumn("block", F.pmod(F.xxhash64("group_key"), F.lit(n_blocks)).cast("int"))
        bins = staged(groups.groupBy("block").applyInPandas(_plan_blocks(shards), "block int, group_key long, bin int, sum long"), "bins")
        sums = staged(bins.groupBy(F.col("block").alias("node"), "bin").agg(F.max("sum").alias("sum")), "sums")
        where = bins.join(bounded(combined(sums, shards)), ["block", "bin"]).select("group_key", "shard")
        placed = staged(meet(facts, where, hot(facts, "group_key"), "group_key", "turn"), "placed")
        return with_slots(keep(placed), shards)


def with_slots(placed: DataFrame, shards: int) -> DataFrame:
    """Number the rows of each shard of a staged table. A shard is cut by a hash of its rows' numbers (turn) into cells;
    counts of cells give where each begins, so no task orders a whole shard, and repeated rows don't share a cell."""
    largest = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    cells = max(1, -(-largest // ROWS_PER_CELL), min(8, shuffle_width(placed.sparkSession) // shards + 1))
    most = placed.withColumn("cell", F.pmod(F.xxhash64("turn"), F.lit(cells)).cast("int"))
    begins = most.groupBy("shard", "cell").count().withColumn("begin", F.expr("sum(count) over (partition by shard order by cell) - count"))
    rank = F.expr("row_number() over (partition by shard, cell order by turn) - 1")
    return most.withColumn("r", rank).join(begins, ["shard", "cell"]).withColumn("slot", F.col("begin") + F.col("r"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
