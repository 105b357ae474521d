"""Near-duplicate documents by DartMinHash and banded joining.

A document is a weighted set: its five-word shingles, weighted by how often they occur. Darts fall on each unit of
weight as a Poisson process along the rank axis, seeded by the shingle alone, so equal parts of two documents catch
equal darts. Of the darts below a rank that fits the document's weight, each of K coordinates keeps the earliest; two
documents agree in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .runtime import scratch, ship, small_enough, staged, table
from .wordhash import U, _C, digests, lists, mix, occurrences, release, shingles, signed, slices, words

SHINGLE = 5
SIMILARITY = 0.8
K, ROWS = 64, 4  # coordinates, and how many make a band: 16 bands find a pair of similarity 0.8 with 0.9998
BROADCAST_IDS = 200_000
CELL = 4_000_000  # elements of a bucket that one task compares
PART = 400_000  # elements of smaller buckets that are compared together
STEP = 2_000_000  # elements or counts looked up at a time
MANY, DENSE = 256, 8  # rows of a bucket with a matrix of its own; it holds elements of more than one in DENSE of them
MEMBER = 100  # elements that a member counts for besides its own
HEAVY = 1000  # a bucket of more than one in HEAVY of all rows is heavy: there are fewer than HEAVY of these
SALTS = 64  # tasks that the rows of a heavy bucket are spread over


def dart_minhash(e: np.ndarray, ranges: np.ndarray, k: int = K) -> np.ndarray:
    """(rows, k) coordinates of rows of distinct element hashes; a row of none has zeros."""
    n = np.diff(ranges)
    out = np.zeros((len(n), k), U)
    darts = k * np.log(k) + 2 * k  # expected of each row: leaves no coordinate empty with probability exp(-exp(-2))
    todo, reach = np.flatnonzero(n > 0), 1.0
    while len(todo):
        count = n[todo]
        row = np.repeat(np.arange(len(todo)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + ranges[todo][row]
        x, limit = e[at], (reach * darts / count)[row]
        best, who = np.full(len(todo) * k, np.inf), np.zeros(len(todo) * k, U)
        rank, turn = np.zeros(len(x)), 0
        # most elements have no dart: sort those out by comparing hashes, before any logarithm
        least = (np.exp(-reach * darts / count) * 2.0**53).astype(U)[row]
        while len(x):
            throw = mix(x + U((2 * turn + 1) * int(_C[4]) & (1 << 64) - 1))
            if turn == 0:
                hit = (throw >> U(11)) >= least
                x, row, limit, rank, throw = x[hit], row[hit], limit[hit], rank[hit], throw[hit]
            rank = rank - np.log(((throw >> U(11)).astype(np.float64) + 0.5) / 2.0**53)
            hit = rank <= limit
            x, row, limit, rank, throw = x[hit], row[hit], limit[hit], rank[hit], throw[hit]
            dart = mix(throw ^ _C[6])
            cell = row * k + (dart % U(k)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            won = rank == best[cell]
            who[cell[won]] = dart[won]
            turn += 1
        filled = np.isfinite(best).reshape(-1, k).all(1)
        out[todo[filled]] = who.reshape(-1, k)[filled]
        todo, reach = todo[~filled], reach * 2
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), -1, rows)
    acc = np.arange(1, parts.shape[1] + 1, dtype=U) * _C[5]
    for j in range(rows):
        acc = mix(acc + parts[:, :, j] * _C[j])
    return acc


def elements(data: np.ndarray, offs: np.ndarray):
    """Digests of rows' words, their shingles made distinct by occurrence, and each row's range of these."""
    h, ranges, _, _ = words(data, offs)
    s, own = shingles(h, ranges, SHINGLE)
    return digests(h, ranges), occurrences(s, own), own


def _sketch(batches):
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column("text")):
            key, e, own = elements(data, offs)
            b = bands(dart_minhash(e, own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(signed(key)), pa.array(np.diff(own)), lists(signed(b.ravel()), np.arange(len(b) + 1) * b.shape[1])], ["doc_id", "text_hash", "key", "n", "bands"])


def _sets(batches):
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column("text")):
            key, e, own = elements(data, offs)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), lists((e >> U(32)).astype(np.uint32).view(np.int32), own)], ["key", "items"])


def similar_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b; a staged table) of at least that Jaccard similarity of their ``sets`` (key, items). A key of
    many pairs is spread over tasks."""
    x, y = (sets.select(F.col("key").alias(c), F.col("items").alias(i)) for c, i in (("a", "x"), ("b", "y")))
    both = meet(meet(pairs, x, hot(pairs, "a"), "a", "b"), y, hot(pairs, "b"), "b", "a")
    # the sets are of distinct elements; 32 bits of a hash may still repeat
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def shared_buckets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bucket and size of the buckets of ``rows`` that hold more than one, and the heavy ones of these."""
    sizes = staged(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return sizes, sizes.where(F.col("size") > total / HEAVY).select("bucket")


def meet(rows: DataFrame, side: DataFrame, heavy: DataFrame, on: str = "bucket", spread: str = "key", how: str = "inner") -> DataFrame:
    """Join of ``rows`` and ``side`` (few rows for each value) on a column. Rows of ``heavy`` values, and of null, are
    spread by another column over SALTS tasks, each with a copy of the value's rows of ``side``."""
    marks = F.broadcast(heavy.select(on, F.lit(True).alias("heavy")))
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    salted = rows.join(marks, on, "left").withColumn("salt", F.when(F.col("heavy") | F.col(on).isNull(), salt).otherwise(0)).drop("heavy")
    copies = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    other = side.join(marks, on, "left").withColumn("salt", F.explode(copies)).drop("heavy")
    return salted.join(other, [on, "salt"], how).drop("salt")


def leader_pairs(rows: DataFrame, heavy: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of every member of a bucket with the bucket's two leaders: the member that shares most buckets with
    others (in a group of edited copies, what they were copied from) and one picked by a hash, another in every bucket.
    ``rows``: bucket, key, n, weight."""
    me = F.struct("key", "n")
    lead = rows.groupBy("bucket").agg(F.max_by(me, F.struct("weight", "key")).alias("first"), F.max_by(me, F.xxhash64("key", "bucket")).alias("second"))
    met = meet(rows, lead.select("bucket", F.explode(F.array("first", "second")).alias("l")), heavy).where("key <> l.key")
    return ordered(met, similarity)


def ordered(met: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) with a < b of rows (key, n, l), less those whose sizes rule the similarity out."""
    near = met.where(F.least("n", "l.n") >= similarity * F.greatest("n", "l.n"))
    return near.select(F.least("key", "l.key").alias("a"), F.greatest("key", "l.key").alias("b")).distinct()


def apart(rows: DataFrame, heavy: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, key, n, root of the members of buckets that hold several components."""
    rows = rows.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = staged(rows.select("bucket", "key", F.col("n").cast("long").alias("n"), "root"), "rooted")
    several = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return staged(meet(rows, several, heavy), "apart")


def hot(rows: DataFrame, on: str) -> DataFrame:
    """Values of more than one in HEAVY of the rows of a staged table."""
    return rows.groupBy(on).agg(F.count("*").alias("size")).where(F.col("size") > rows.count() / HEAVY).select(on)


def joining_links(bucket: np.ndarray, root: np.ndarray, items: np.ndarray, ranges: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows, of one bucket and of different roots, that join all similar rows: no two similar rows of a bucket
    stay in different components.

    A row's elements have one order, rare ones first; those that only one root of the bucket holds don't count. Similar
    rows share one of the first (counted - similarity * size + 1) elements of both, so rows meet by these alone, and a
    row is compared exactly with those it meets that are of another component by then.
    """
    n = np.diff(ranges)
    rows = np.repeat(np.arange(len(n)), n)
    _, home = np.unique(bucket, return_inverse=True)
    _, comp = np.unique(root, return_inverse=True)
    # elements are told apart by bucket, so all buckets are worked through at once
    _, e, df = np.unique(mix(items.astype(np.int64).view(U) + mix(home.astype(U) + U(1))[rows]), return_inverse=True, return_counts=True)
    low, high = np.full(len(df), len(n)), np.full(len(df), -1)
    np.minimum.at(low, e, comp[rows])
    np.maximum.at(high, e, comp[rows])
    counted = np.flatnonzero((low < high)[e])
    order = counted[np.lexsort((e[counted], df[e[counted]], rows[counted]))]
    of = rows[order]
    have = np.bincount(of, minlength=len(n))
    begin = np.concatenate([[0], np.cumsum(have)])[:-1]
    length = np.maximum(0, have - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)
    head = np.arange(len(order)) - begin[of] < length[of]
    he, hr = e[order[head]], of[head]
    by = np.argsort(he, kind="stable")
    he, hr = he[by], hr[by]
    first, last = np.searchsorted(he, np.arange(len(df) + 1))[:-1], np.searchsorted(he, np.arange(len(df)), "right")
    # the largest component of a bucket waits for the others to ask
    pair, count = np.unique(home * len(n) + comp, return_counts=True)
    most = np.zeros(home.max() + 1, np.int64)
    at = np.lexsort((count, pair // len(n)))
    most[pair[at] // len(n)] = pair[at] % len(n)
    asks = comp != most[home]
    own = np.split(e[order[head]], np.cumsum(np.bincount(of[head], minlength=len(n)))[:-1])
    label, mark, links = comp.copy(), np.zeros(len(df), bool), []
    for x in np.flatnonzero(asks & (length > 0)).tolist():
        met = [hr[first[k] : last[k]] for k in own[x].tolist() if last[k] - first[k] > 1]
        if not met:
            continue
        y = np.unique(np.concatenate(met))
        y = y[(label[y] != label[x]) & (~asks[y] | (y < x)) & (np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x]))]
        if not len(y):
            continue
        mark[e[ranges[x] : ranges[x + 1]]] = True
        for some in np.array_split(y, -(-int(n[y].sum()) // STEP)):
            size = n[some]
            turns = np.cumsum(size) - size
            common = np.add.reduceat(mark[e[np.arange(size.sum()) + np.repeat(ranges[some] - turns, size)]], turns, dtype=np.int64)
            for z in some[common >= similarity * (n[x] + size - common) - 1e-9].tolist():
                if label[x] != label[z]:
                    label[label == label[z]] = label[x]
                    links.append((x, z))
        mark[e[ranges[x] : ranges[x + 1]]] = False
    return links


def joining_links_dense(root: np.ndarray, items: np.ndarray, ranges: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """As ``joining_links``, for one bucket of many rows: common elements are counted by a product of matrices, rare ones
    by the rows that hold them."""
    n = np.diff(ranges)
    m = len(n)
    rows = np.repeat(np.arange(m), n)
    _, comp = np.unique(root, return_inverse=True)
    _, e, df = np.unique(items, return_inverse=True, return_counts=True)
    common = df > m / DENSE
    column = np.cumsum(common) - 1
    matrix = np.zeros((m, max(1, int(common.sum()))), np.float32)
    matrix[rows[common[e]], column[e[common[e]]]] = 1
    rare = np.flatnonzero((~common & (df > 1))[e])
    by = rare[np.argsort(e[rare], kind="stable")]
    held = rows[by]
    first, last = np.searchsorted(e[by], np.arange(len(df))), np.searchsorted(e[by], np.arange(len(df)), "right")
    asks = np.flatnonzero(comp != np.bincount(comp).argmax())
    label, links, part = comp.copy(), [], similarity / (1 + similarity)
    for block in np.array_split(asks, -(-len(asks) * m // STEP) or 1):
        for x, s in zip(block.tolist(), matrix[block] @ matrix.T, strict=True):
            met = [held[first[k] : last[k]] for k in e[ranges[x] : ranges[x + 1]].tolist() if last[k] > first[k]]
            if met:
                s += np.bincount(np.concatenate(met), minlength=m)
            near = (s >= part * (n[x] + n) - 1e-4) & (label != label[x])
            for z in np.flatnonzero(near).tolist() if near.any() else ():
                if label[x] != label[z]:
                    label[label == label[z]] = label[x]
                    links.append((x, z))
    return links


def _joiner(similarity: float):
    """Links of buckets that come one after another: whole buckets of about PART elements at a time, or one larger."""

    def run(batches):
        held, mass = [], 0
        for batch in batches:
            held.append(batch)
            mass += len(batch.column("items").flatten()) + MEMBER * batch.num_rows
            if mass > PART:
                whole = pa.Table.from_batches(held)
                bucket = whole.column("bucket").to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if cut:
                    yield from links_of(whole.slice(0, cut))
                    held = whole.slice(cut).to_batches()
                    mass = sum(len(b.column("items").flatten()) + MEMBER * b.num_rows for b in held)
        if held:
            yield from links_of(pa.Table.from_batches(held))
        release()

    def links_of(rows):
        rows = rows.combine_chunks()
        column = rows.column("items").combine_chunks()
        ranges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        key = rows.column("key").to_numpy()
        bucket, root, items = rows.column("bucket").to_numpy(), rows.column("root").to_numpy(), column.flatten().to_numpy()
        # runs of small buckets together, each bucket of many rows by itself
        starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        ends = np.append(starts[1:], len(bucket))
        many = ends - starts >= MANY
        cuts = np.unique(np.concatenate([[0, len(bucket)], starts[many], ends[many]]))
        alone, links = set(starts[many].tolist()), []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = items[ranges[lo] : ranges[hi]], ranges[lo : hi + 1] - ranges[lo], similarity
            found = joining_links_dense(root[lo:hi], *own) if lo in alone else joining_links(bucket[lo:hi], root[lo:hi], *own)
            links += [(lo + x, lo + y) for x, y in found]
        if links:
            a, b = key[[x for x, _ in links]], key[[y for _, y in links]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _finer(level: int):
    """The same members in buckets that K further coordinates split, again in bands."""

    def run(batches):
        for batch in batches:
            column = batch.column("items")
            ranges = column.offsets.to_numpy() - column.offsets.to_numpy()[0]
            e = mix(column.flatten().to_numpy().astype(np.int64).view(U) + U(level + 1) * _C[1])
            b = bands(dart_minhash(e, ranges.astype(np.int64)))
            inside = mix(b + mix(batch.column("bucket").to_numpy().view(U))[:, None])
            row = pa.array(np.repeat(np.arange(len(b)), b.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(signed(inside.ravel())), *[batch.column(c).take(row) for c in ("key", "n", "root")]], ["bucket", "key", "n", "root"])

    return run


def linked(rows: DataFrame, heavy: DataFrame, load_sets, similarity: float, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """links (a, b) and roots (node, root) of ``rows`` (bucket, key, n, weight, size), members of shared buckets.

    First, members meet the leaders of their buckets, which joins large groups of copies without their pairs. Members of
    buckets that still hold several components then meet inside a task for each bucket: exactly, but only links that join
    components are made. A bucket of more than ``cell`` elements is split by bands of further coordinates first.
    ``load_sets`` gives the sets (key, items) of pairs.
    """
    pairs = staged(leader_pairs(rows, heavy, similarity), "pairs")
    links = staged(similar_links(pairs, load_sets(pairs), similarity), "links")
    roots = components(links)
    # of two or fewer members, all have met
    rest = apart(rows.where("size > 2"), heavy, roots)
    sets = load_sets(rest.select(F.col("key").alias("a"), F.col("key").alias("b")))
    found, level = [links], 0
    while True:
        mass = rest.groupBy("bucket").agg(F.sum(F.col("n") + MEMBER).alias("mass"))
        large = staged(mass.where(F.col("mass") > cell).select("bucket"), "large")
        none = large.isEmpty()
        small = rest if none else rest.join(large, "bucket", "left_anti")
        small = small.join(sets, "key").select("bucket", "key", "root", "items").repartition("bucket").sortWithinPartitions("bucket")
        found.append(staged(small.mapInArrow(_joiner(similarity), "a long, b long").distinct(), "links"))
        if none:
            break
        level += 1
        more = meet(rest, large, hot(rest, "bucket")).join(sets, "key").select("bucket", "key", "n", "root", "items")
        finer = staged(more.mapInArrow(_finer(level), "bucket long, key long, n long, root long"), "finer")
        several = finer.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
        rest = staged(meet(finer, several, hot(finer, "bucket")), "apart")
    links = staged(reduce(DataFrame.unionAll, found), "links")
    return links, components(links)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", hashes: bool = False) -> DataFrame:
    """doc_id, class_id, links_compared, keep of each row of ``docs``.

    class_id is the smallest doc_id of the rows whose texts are linked: of equal words, or of a weighted Jaccard
    similarity of five-word shingles of at least ``similarity``, over any number of links. links_compared counts the different
    texts that a text was compared with and found similar to: leaders, and texts left apart by them, not all similar
    texts. keep is true for one row of each class, the one with the smallest doc_id
    (null ids last; of repeated rows, one). Texts of fewer than five words are one shingle. Null texts and texts
    without words are never linked to any and are all kept, with their own id as class. ``hashes`` adds
    text_hash (xxhash64 of the text), which tells rows of one id, or of none, apart. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    with scratch() as keep:
        return keep(staged(_near_duplicates(docs, similarity, doc_id, text).select("doc_id", "class_id", "links_compared", "keep", *(["text_hash"] if hashes else [])), "near_duplicates"))


def _near_duplicates(docs: DataFrame, similarity: float, doc_id: str, text: str) -> DataFrame:
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    plain = plain.withColumn("text_hash", F.xxhash64("text"))
    sketch = staged(plain.mapInArrow(_sketch, "doc_id long, text_hash long, key long, n long, bands array<long>"), "sketch")
    full = sketch.where("n > 0")
    copied = staged(full.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "copied")
    copied = copied.where(F.col("size") > (copied.agg(F.sum("size")).first()[0] or 0) / HEAVY)
    reps = full.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = reps.select("key", "n", F.explode("bands").alias("bucket"))
    sizes, heavy = shared_buckets(rows)
    rows = staged(meet(rows, sizes, heavy), "shared")  # read twice below
    weight = rows.groupBy("key").agg(F.sum("size").alias("weight"))
    rows = staged(rows.join(weight, "key").select("bucket", "key", "n", "weight", "size"), "buckets")

    def load_sets(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        ids = staged(reps.join(wanted, "key").select("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id")), "wanted")
        small = small_enough(ids, BROADCAST_IDS)
        side = lambda c: F.broadcast(ids.select(c).distinct()) if small else ids.select(c).distinct()
        texts = plain.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).join(side("id"), "id", "left_semi").select("text")
        sets = texts.mapInArrow(_sets, "key long, items array<int>").join(side("key"), "key", "left_semi")
        return staged(sets.dropDuplicates(["key"]), "sets")

    links, roots = linked(rows, heavy, load_sets, similarity)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links_compared"))
    label = reps.select("key", "doc_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = label.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    label = label.join(least, "root").join(degree, "key", "left").select("key", "root", "class_id", F.coalesce("links_compared", F.lit(0)).alias("links_compared"))
    out = sketch.select("doc_id", "text_hash", F.when(F.col("n") > 0, F.col("key")).alias("key"), F.monotonically_increasing_id().alias("turn"))
    out = meet(out, label, copied, "key", "turn", "left")
    out = staged(out, "labelled")
    kept = out.where("key IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "turn"))["turn"].alias("turn"))
    out = out.join(kept.select("turn", F.lit(True).alias("kept")), "turn", "left")
    keep = F.col("key").isNull() | F.coalesce("kept", F.lit(False))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links_compared", F.lit(0)).alias("links_compared"), keep.alias("keep"), "text_hash")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
