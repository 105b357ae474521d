"""Runs of words that several documents share, wherever lines break.

The lowest of each WIDTH hashes of SEED words is kept (winnowing, over each text alone), so two texts that share RUN words
keep one alike. Seeds of several texts are met with their first holder only; seeds that overlap, on both sides alike, make
a run, which is then extended word by word. No pairs of documents are made, and equal texts are handled as one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import HEAVY, SHINGLE, SIMILARITY, hot, meet
from .runtime import dropped, small_enough, staged
from .wordhash import lists, release, shingles, signed, slices, words

SEED, WIDTH = 12, 13
RUN = SEED + WIDTH - 1  # shared runs of so many words hold a seed
EDGE = WIDTH - 1  # words by which a run may go on beyond its seeds, at most
LEAST = 20  # words of a text's stretch of runs, beside each other or overlapping, that is reported
ROWS = 500  # texts whose runs are held as Python objects at a time
BROADCAST_IDS = 200_000


def seeds(h: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word in the row, hash) of the winnowed seeds of rows of at least RUN words."""
    s, own = shingles(h, ranges, SEED)
    row = np.repeat(np.arange(len(own) - 1), np.diff(own))
    # the lowest of so many places from each on, the last of equal ones: a window is two that overlap
    best, place, width = s, np.arange(len(s)), 1
    while width < WIDTH and len(best):
        step = min(width, WIDTH - width)
        later = best[step:] <= best[:-step]
        best, place = np.where(later, best[step:], best[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    place = place[np.arange(len(place)) + WIDTH <= own[1:][row[: len(place)]]]
    place = place[np.diff(place, prepend=-1) != 0]  # they rise
    return row[place], place - own[row[place]], s[place]


def once(batches):
    """Rows of texts that this task hasn't met before."""
    seen: set[int] = set()
    for batch in batches:
        take = []
        for i, t in enumerate(batch.column("text_hash").to_pylist()):
            if t not in seen:
                seen.add(t)
                take.append(i)
        if take:
            yield batch.take(pa.array(take))


def _seeds(batches):
    for batch in once(batches):
        for lo, hi, data, offs in slices(batch.column("text")):
            h, ranges, _, _ = words(data, offs)
            row, at, s = seeds(h, ranges)
            yield pa.RecordBatch.from_arrays([batch.column("text_hash").slice(lo, hi - lo).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(signed(s))], ["text_hash", "at", "seed"])


def chains(at: np.ndarray, f_text: np.ndarray, f_at: np.ndarray):
    """First and last of the seeds, in an order that is returned too, that overlap the next on the same diagonal."""
    order = np.lexsort((at, f_at - at, f_text))
    at, f_text, f_at = at[order], f_text[order], f_at[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > SEED) | (np.diff(f_at - at) != 0) | (f_text[1:] != f_text[:-1])
    first = np.flatnonzero(new)
    return order[first], order[np.append(first[1:], len(at)) - 1]


def _chains(batches):
    names = ["text_hash", "at", "last", "f_doc", "f_text", "f_at"]
    for batch in batches:
        flat, turns = batch.column("own").flatten(), batch.column("own").offsets.to_numpy()
        at, f_doc, f_text, f_at = (flat.field(c).to_numpy() for c in ("at", "f_doc", "f_text", "f_at"))
        parts = []
        for i, (lo, hi) in enumerate(zip(turns[:-1] - turns[0], turns[1:] - turns[0], strict=True)):
            first, last = chains(at[lo:hi], f_text[lo:hi], f_at[lo:hi])
            parts.append((np.full(len(first), i), first + lo, last + lo))
        row, first, last = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([batch.column("text_hash").take(pa.array(row)), pa.array(at[first]), pa.array(at[last] + np.int32(SEED)), pa.array(f_doc[first]), pa.array(f_text[first]), pa.array(f_at[first])], names)


def _edges(batches):
    """What stands around stretches of words: hashes of the EDGE words before and behind, and the bytes where each of
    these words begins or ends. A text comes once."""
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column("text")):
            h, ranges, starts, ends = words(data, offs)
            own = batch.slice(lo, hi - lo)
            asked = own.column("asked")
            row = np.repeat(np.arange(hi - lo), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            at, last = (flat.field(c).to_numpy() for c in ("at", "last"))
            sides = [flat.field(c) for c in ("of_run", "of_first")]
            first, end = at + ranges[:-1][row], last + ranges[:-1][row]
            before, behind = np.minimum(at, EDGE), np.minimum(ranges[1:][row] - end, EDGE)
            code = signed(h).astype(np.int32) if len(h) else np.zeros(0, np.int32)

            def walk(count, begin, step, values):
                """Lists of the ``count`` values from ``begin`` on."""
                to = np.concatenate([[0], np.cumsum(count)])
                j = np.arange(to[-1]) - np.repeat(to[:-1], count)
                return lists(values[np.repeat(begin, count) + step * j].astype(np.int32), to)

            begins, stops = starts - offs[np.searchsorted(offs, starts, "right") - 1], ends - offs[np.searchsorted(offs, starts, "right") - 1]
            yield pa.RecordBatch.from_arrays([own.column("text_hash").take(pa.array(row)), pa.array(at), pa.array(last), walk(before, first - 1, -1, code), walk(behind, end, 1, code), walk(before + 1, first, -1, begins), walk(behind + 1, end - 1, 1, stops), *sides], ["text_hash", "at", "last", "before", "behind", "begins", "ends", "of_run", "of_first"])


def joined(runs: list, similarity: float):
    """Runs (at, begin, end, n, f_doc, f_text, f_at) in order, those of one first text joined over edited words as long as
    the joined spans of both texts surely reach the similarity: Jaccard of SHINGLE-word shingles, of which only those
    inside the runs count as common."""
    out, common = [], 0
    for run in runs:
        at, _, end, n, _, text, f_at = run
        inside = n - SHINGLE + 1
        if out and out[-1][5] == text:
            last_at, begin, last_end, last_n, doc, _, last_f = out[-1]
            size, f_size = at + n - last_at, f_at + n - last_f
            # words that both runs hold, in either text; shingles within them count once
            twice = max(0, last_run[0] - at, last_run[1] - f_at)
            both = common + inside - max(0, twice - SHINGLE + 1) if twice < n else 0
            if f_at > last_run[2] and size > last_n and both >= similarity * (size + f_size - 2 * (SHINGLE - 1) - both):
                out[-1], common, last_run = (last_at, begin, max(end, last_end), size, doc, text, last_f), both, (at + n, f_at + n, f_at)
                continue
        out.append(run)
        common, last_run = inside, (at + n, f_at + n, f_at)
    return out


def long_stretches(runs: list) -> list:
    """Those of runs (at, begin, end, n, ...) in order whose stretch has LEAST words: runs that overlap or stand beside
    each other, with at most one word between, are a stretch."""
    out, own, first, last = [], [], 0, -2
    for run in [*runs, (1 << 62, 0, 0, 0)]:
        if run[0] > last + 1:
            if last - first >= LEAST:
                out += own
            own, first = [], run[0]
        own.append(run)
        last = max(last, run[0] + run[3])
    return out


def few(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)
        release()


def uncovered(runs: list) -> list:
    """Those of runs (at, begin, end, n, f_doc, ...), in the order of first documents and then length, that no run to an
    earlier document covers: seeds at a run's edges may be told by later holders."""
    out, group, starts, ends = [], [], [], []  # starts, ends: stretches of earlier documents, none inside another
    for run in sorted(runs, key=lambda r: (r[4], -r[3], r[0])):
        if group and group[-1][4] != run[4]:
            for at, end in ((r[0], r[0] + r[3]) for r in group):
                lo = hi = bisect_left(starts, at)
                if not lo or ends[lo - 1] < end:
                    while hi < len(ends) and ends[hi] <= end:
                        hi += 1
                    if lo == len(starts) or starts[lo] != at or hi > lo:
                        starts[lo:hi], ends[lo:hi] = [at], [end]
            group = []
        k = bisect_right(starts, run[0]) - 1
        if k < 0 or ends[k] < run[0] + run[3]:
            out.append(run)
            group.append(run)
    return sorted(out, key=lambda r: (r[0], -r[3], r[5]))


RUN_NAMES = ["home", "text_hash", "at", "begin", "end", "n", "f_doc", "f_text", "f_at", "f_last"]
RUN_KINDS = [pa.bool_(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _runs(batches, similarity: float):
    """Runs of each text; and, as homes, where they lie in their first texts: there begin and end are the first text's."""
    fields = ("at", "begin", "end", "n", "f_doc", "f_text", "f_at", "f_last", "f_begin", "f_end")
    for batch in few(batches):
        out = []
        for text, own in zip(batch.column("text_hash").to_pylist(), batch.column("own").to_pylist(), strict=True):
            kept = long_stretches(uncovered({tuple(r[c] for c in fields) for r in own}))
            out += [(True, text, r[0], r[8], r[9], r[3], r[4], r[5], r[6], r[7]) for r in kept if r[3] >= LEAST]
            out += [(False, text, *r, None) for r in joined([r[:7] for r in kept], similarity)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(RUN_KINDS)], RUN_NAMES)


def _homes(batches):
    """Stretches of the first texts that runs lie in: overlapping ones are one."""
    names = ["text_hash", "home", "home_end", "begin", "end", "first_doc"]
    for batch in few(batches):
        out = []
        for text, own in zip(batch.column("f_text").to_pylist(), batch.column("own").to_pylist(), strict=True):
            for s in sorted(own, key=lambda s: (s["at"], s["last"])):
                if out and out[-1][0] == text and s["at"] < out[-1][2]:
                    if s["last"] > out[-1][2]:
                        out[-1][2], out[-1][4] = s["last"], s["end"]
                else:
                    out.append([text, s["at"], s["last"], s["begin"], s["end"], s["f_doc"]])
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


def alike(a: str, b: str):
    """How many elements two arrays have alike from their first on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(same))


def common_runs(plain: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, begin, end, n, passage, first_doc for each row of ``plain`` (doc_id, text, text_hash; no null
    ids) and each run of words that another document holds too, in stretches of at least LEAST words. first_doc is the smallest doc_id that holds the run's seeds; passage is one for all runs
    that lie in the same stretch of it. Runs of an edited copy are joined, with the edited words, where the ``joined``
    spans are similar. Copies of a whole text are not compared with each other here."""
    texts = staged(plain.groupBy("text_hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "texts")
    found = staged(plain.mapInArrow(_seeds, "text_hash long, at int, seed long"), "seeds")
    shared = staged(found.groupBy("seed").agg(F.count("*").alias("size")).where("size > 1"), "shared_seeds")
    total = shared.agg(F.sum("size")).first()[0] or 0
    heavy = shared.where(F.col("size") > total / HEAVY).select("seed")
    held = staged(meet(found, shared.select("seed"), heavy, "seed", "text_hash").join(texts, "text_hash"), "held")
    dropped(found)
    first = held.groupBy("seed").agg(F.min(F.struct("low", "text_hash", "at")).alias("f"), F.max("text_hash").alias("other"), F.min("text_hash").alias("one")).where("one < other")
    first = first.select("seed", F.col("f.low").alias("f_doc"), F.col("f.text_hash").alias("f_text"), F.col("f.at").alias("f_at"))
    spots = meet(held, first, heavy, "seed", "text_hash").where("text_hash <> f_text AND high > f_doc")
    own = spots.groupBy("text_hash").agg(F.collect_set(F.struct("at", "f_doc", "f_text", "f_at")).alias("own"))
    spot = lambda text, at, last: F.xxhash64(text, at, last)
    runs = own.mapInArrow(_chains, "text_hash long, at int, last int, f_doc long, f_text long, f_at int").withColumn("f_last", F.expr("f_at + last - at"))
    runs = staged(runs.select("*", spot("text_hash", "at", "last").alias("spot"), spot("f_text", "f_at", "f_last").alias("f_spot")), "chains")
    dropped(held)
    # the words around both ends of each run, in its text and in the first; of equal texts one is read
    sides = runs.selectExpr("text_hash", "at", "last", "true AS of_run").unionAll(runs.selectExpr("f_text", "f_at", "f_last", "false"))
    asked = sides.groupBy("text_hash", "at", "last").agg(F.bool_or("of_run").alias("of_run"), F.bool_or(~F.col("of_run")).alias("of_first"))
    asked = asked.groupBy("text_hash").agg(F.collect_list(F.struct("at", "last", "of_run", "of_first")).alias("asked"))
    asked = staged(asked.join(texts.select("text_hash", F.col("low").alias("doc_id")), "text_hash"), "asked")
    rows, row = plain.select("doc_id", "text_hash", "text"), ["doc_id", "text_hash"]
    ids = asked.select(row)
    if small_enough(ids, BROADCAST_IDS):
        rows = rows.join(F.broadcast(ids), row, "left_semi")
    rows = rows.dropDuplicates(row).join(asked, row).select("text_hash", "text", "asked")
    edges = rows.mapInArrow(_edges, "text_hash long, at int, last int, before array<int>, behind array<int>, begins array<int>, ends array<int>, of_run boolean, of_first boolean")
    edges = staged(edges.withColumn("spot", spot("text_hash", "at", "last")).drop("text_hash", "at", "last"), "edges")
    dropped(asked)
    names = ("before", "behind", "begins", "ends")
    ours = edges.where("of_run").select("spot", *names)
    theirs = edges.where("of_first").select(F.col("spot").alias("f_spot"), *[F.col(c).alias("f_" + c) for c in names])
    both = meet(runs.join(ours, "spot"), theirs, hot(runs, "f_spot"), "f_spot", "spot")
    both = both.select("*", alike("before", "f_before").alias("l"), alike("behind", "f_behind").alias("r"))
    both = staged(both.selectExpr("text_hash", "at - l AS at", "begins[l] AS begin", "ends[r] AS end", "last - at + l + r AS n", "f_doc", "f_text", "f_at - l AS f_at", "f_last + r AS f_last", "f_begins[l] AS f_begin", "f_ends[r] AS f_end"), "extended")
    dropped(edges)
    own = both.groupBy("text_hash").agg(F.collect_list(F.struct("at", "begin", "end", "n", "f_doc", "f_text", "f_at", "f_last", "f_begin", "f_end")).alias("own"))
    told = own.mapInArrow(partial(_runs, similarity=similarity), "home boolean, text_hash long, at int, begin int, end int, n int, f_doc long, f_text long, f_at int, f_last int")
    told = staged(told, "runs")
    dropped(both)
    runs = told.where("NOT home").select("text_hash", "begin", "end", "n", F.col("f_doc").alias("first_doc"), F.col("f_text").alias("first_text"), F.col("f_at").alias("first_at"))
    # the stretches of the first documents that runs lie in; as many a text as it has words, at most
    homes = told.where("home").groupBy("f_text", "f_at").agg(F.max(F.struct("f_last", "end")).alias("far"), F.min("begin").alias("begin"), F.min("f_doc").alias("f_doc"))
    homes = homes.groupBy("f_text").agg(F.collect_list(F.struct(F.col("f_at").alias("at"), F.col("far.f_last").alias("last"), "begin", F.col("far.end").alias("end"), "f_doc")).alias("own"))
    homes = staged(homes.mapInArrow(_homes, "text_hash long, home int, home_end int, begin int, end int, first_doc long"), "homes")
    at_home = homes.groupBy(F.col("text_hash").alias("first_text")).agg(F.collect_list(F.struct("home", "home_end")).alias("homes"))
    runs = meet(runs, at_home, hot(runs, "first_text"), "first_text", "text_hash", "left")
    home = F.expr("coalesce(get(filter(homes, h -> first_at >= h.home AND first_at < h.home_end), 0).home, first_at)")
    runs = runs.select("text_hash", "begin", "end", "n", F.xxhash64("first_text", home).alias("passage"), "first_doc", F.lit(False).alias("own"))
    homes = homes.select("text_hash", "begin", "end", F.expr("home_end - home AS n"), F.xxhash64("text_hash", "home").alias("passage"), "first_doc", F.lit(True).alias("own"))
    docs = staged(plain.select("doc_id", "text_hash"), "rows")
    out = meet(docs, staged(runs.unionAll(homes), "spans"), hot(docs, "text_hash"), "text_hash", "doc_id")
    # a first text's stretches stand for its first document; copies of its text are no runs
    return out.where("own = (doc_id = first_doc)").drop("own")
