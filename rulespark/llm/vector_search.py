"""Nearest neighbours by inverted lists and an adaptive dimension scan.

Vectors are normalised, randomly rotated and dealt to inverted lists. A scan reads a list in blocks of columns and
after each block drops the candidates whose partial distance says, by a hypothesis test on rotated vectors, that the
full distance exceeds the k-th best so far. What survives is measured exactly, on the original vectors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import ship, staged, table

FIT_SAMPLE = 20_000  # vectors the lists are fitted on, at most
MAX_LISTS = 2048  # lists: as many as the square root of twice the vectors, but each with SAMPLE_ROWS of the sample
SAMPLE_ROWS = 8
TRIED = 400  # sample vectors whose true neighbours tell how many lists to probe
WANTED = 0.97  # share of their true neighbours that the probed lists must hold
MIN_PROBES = 4
BLOCK_ROWS = 8192  # rows scanned by one task group: neighbouring lists together, larger lists split
COLUMNS = 16  # columns read between two tests
EPSILON = 2.1  # of the test: sqrt(D/d) * partial > (1 + eps/sqrt(d)) * bound


def usable(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is not null or empty, holds finite numbers only and isn't zero."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which changes no cosine, so squares of tiny and huge numbers stay in range."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -exponent)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(x, -(-len(x) // 4096))])
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.diff(near[order], prepend=-1))
        c = c.copy()
        c[near[order][starts]] = np.add.reduceat(x[order], starts)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_lists(df: DataFrame, n: int, k: int) -> tuple[np.ndarray, int]:
    """Centroids of a sample of FIT_SAMPLE vectors at most, in the rotated space, and how many lists a query probes: the
    fewest whose lists hold WANTED of the true ``k`` nearest (in the sample) of TRIED sample vectors."""
    sample = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_SAMPLE).select("v").toArrow()
    x = unit(matrix(sample.column("v")))
    lists = int(min(MAX_LISTS, max(1, round((2 * n) ** 0.5)), max(1, len(x) // SAMPLE_ROWS)))
    x = x @ rotation(x.shape[1])
    centroids = kmeans(x, lists)
    home = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(x, -(-len(x) // 4096))])
    needed = []
    for q in range(min(TRIED, len(x))):
        near = x @ x[q]
        near[q] = -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)] if len(x) > 1 else np.zeros(0, int)
        order = np.empty(lists, np.int64)
        order[np.argsort(-(centroids @ x[q]), kind="stable")] = np.arange(lists)
        needed += (order[home[best]] + 1).tolist()
    probes = int(np.quantile(needed, WANTED, method="higher")) if needed else lists
    return centroids, min(lists, max(MIN_PROBES, probes))


def scan(cand: np.ndarray, query: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
    """Candidates (row numbers) that may be among the ``k`` nearest of the query: rotated unit vectors, column block by
    column block. ``skip``: rows left out (the query's own)."""
    n, dim = cand.shape
    alive = np.flatnonzero(~skip)
    if len(alive) <= k:
        return alive
    # the bound: k-th best full distance among the k nearest by the first block
    part = ((cand[alive, :COLUMNS] - query[:COLUMNS]) ** 2).sum(1)
    seeds = alive[np.argpartition(part, k - 1)[:k]]
    bound = ((cand[seeds] - query) ** 2).sum(1).max()
    d = COLUMNS
    while True:
        if d >= dim:
            return alive[part <= bound * (1 + 1e-9) + 1e-12]
        keep = part * (dim / d) <= (1 + EPSILON / np.sqrt(d)) ** 2 * bound
        keep |= part <= 1e-12
        alive, part = alive[keep], part[keep]
        step = slice(d, min(dim, d + COLUMNS))
        part = part + ((cand[alive, step] - query[step]) ** 2).sum(1)
        d = min(dim, d + COLUMNS)
        if d < dim and len(alive) > k:
            best = alive[np.argpartition(part, k - 1)[:k]]
            bound = min(bound, ((cand[best] - query) ** 2).sum(1).max())


def _dealer(centroids: np.ndarray, probes: int, buckets: int):
    """Lists of each vector and the bucket of lists they are in: the nearest list, or for queries the ``probes``
    nearest, one row for each bucket that holds some of them."""
    rot = rotation(centroids.shape[1])
    bucket = np.arange(len(centroids)) * buckets // len(centroids)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = unit(matrix(batch.column("v"))) @ rot @ centroids.T
            if not probes:
                lists = near.argmax(1)
                row, ends, home = np.arange(len(near)), np.arange(len(near) + 1), bucket[lists]
            else:
                lists = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :probes], axis=1).ravel()
                key = np.repeat(np.arange(len(near)), probes) * buckets + bucket[lists]
                starts = np.flatnonzero(np.diff(key, prepend=-1))
                row, ends, home = key[starts] // buckets, np.append(starts, len(key)), key[starts] % buckets
            rows = batch.take(pa.array(row))
            column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(lists.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("v"), column, pa.array(home.astype(np.int32))], ["vec_id", "v", "lists", "bucket"])

    return deal


def _searcher(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, x = left.column("vec_id").to_numpy(), matrix(left.column("v"))
            qids, qx = right.column("query_id").to_numpy(), matrix(right.column("v"))
            rot = rotation(x.shape[1])
            rx, rq = unit(x) @ rot, unit(qx) @ rot
            x, qx = scaled(x), scaled(qx)
            norm, qnorm = np.sqrt((x * x).sum(1)), np.sqrt((qx * qx).sum(1))
            home = left.column("lists").combine_chunks().flatten().to_numpy()
            probed = right.column("lists").combine_chunks()
            wanted = np.zeros(home.max() + 2, bool)
            for i in range(len(qids)):
                wanted[:] = False
                lists = probed[i].values.to_numpy()
                wanted[lists[lists < len(wanted)]] = True
                found = scan(rx, rq[i], k, ~wanted[home] | (ids == qids[i]))
                score = (x[found] * qx[i]).sum(1) / (norm[found] * qnorm[i])
                top = found[order := np.lexsort((ids[found], -score))[:k]]
                out[0] += [int(qids[i])] * len(top)
                out[1] += ids[top].tolist()
                out[2] += score[order].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return search


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The ``k`` nearest by cosine of each vector whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Null ids and unusable vectors (see ``usable``) take no part. Vectors of different lengths have no cosine: each length
    is searched by itself. Repeated ids: a query skips all rows of its own id; a candidate id counts once, by its best
    score. Ties go to the smaller id. An empty table gives no rows. The index holds every row; its lists are fitted on
    FIT_SAMPLE rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where(F.col(vec_id).isNotNull()), "v")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()  # a row for each length
    found = [search(rows.where(F.size("v") == r["dim"]), r["count"], every, k) for r in sizes]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = reduce(DataFrame.unionAll, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, n: int, every: int, k: int) -> DataFrame:
    """query_id, vec_id, score of the nearest found of ``rows`` (vec_id, v; vectors of one length, ``n`` of them)."""
    centroids, probes = fit_lists(rows, n, k)
    buckets = int(min(len(centroids), max(1, -(-n // BLOCK_ROWS))))
    schema = "vec_id long, v array<double>, lists array<int>, bucket int"
    dealt = staged(rows.mapInArrow(_dealer(centroids, 0, buckets), schema).withColumn("turn", F.monotonically_increasing_id()), "lists")
    blocks = dealt.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))  # MAX_LISTS rows at most
    cand = dealt.join(F.broadcast(blocks), "bucket").withColumn("block", F.pmod(F.xxhash64("turn"), F.col("blocks")).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).mapInArrow(_dealer(centroids, probes, buckets), schema)
    queries = queries.join(F.broadcast(blocks), "bucket").select(F.col("vec_id").alias("query_id"), "v", "lists", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return cand.select("bucket", "block", "vec_id", "v", "lists").groupBy("bucket", "block").cogroup(queries.groupBy("bucket", "block")).applyInArrow(_searcher(k), "query_id long, vec_id long, score double")


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
