"""Repeated passages by paragraph MinHash banding.

A paragraph is a line of at least LEAST words, or shorter lines beside each other that together hold as many.
Paragraphs that share a band of MinHash values are compared by the exact Jaccard similarity of their five-word shingles,
and linked ones form components. Of a component that spans documents, the occurrences in the document of the smallest id
stay. Runs of words that documents share inside paragraphs or across their borders are added by ``common_runs``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common_runs import common_runs
from .near_dup import HEAVY, SHINGLE, SIMILARITY, bands, linked, meet, shared_buckets
from .runtime import scratch, ship, small_enough, staged, table
from .wordhash import U, _C, digests, lists, mix, occurrences, release, shingles, signed, slices, words

LEAST = 20  # words of a paragraph, where its document has so many
BANDS, ROWS = 8, 3  # find a pair of similarity 0.8 with 0.997
BAND_NAMES = [f"band{k}" for k in range(BANDS)]
NO_ID = 2**63 - 1
BROADCAST_IDS = 200_000


def min_hashes(e: np.ndarray, ranges: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) minima of k hashes of the elements of each row; no row may be empty."""
    out = np.empty((len(ranges) - 1, k), U)
    for j in range(k):
        out[:, j] = np.minimum.reduceat(mix(e ^ U((j + 1) * int(_C[7]) & (1 << 64) - 1)), ranges[:-1])
    return out


def line_offsets(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.union1d(offs, np.flatnonzero(data == 10) + 1)


def paragraph_lines(n: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """First and last line of each paragraph, from lines' words and rows: a line of LEAST words is one by itself; shorter
    lines beside each other are joined until they hold as many. What is left over is a paragraph if it is all of its
    row; else it counts only as part of the runs that ``common_runs`` finds."""
    out: list[tuple[int, int]] = []
    own, first, held, last = -1, -1, 0, -1  # row; first line, words and last line of the short lines at hand
    for i, (size, r) in enumerate(zip([*n.tolist(), 1], [*row.tolist(), -2], strict=True)):
        if r != own:
            if held and not (out and row[out[-1][1]] == own):
                out.append((first, last))
            own, held = r, 0
        if not size:
            continue
        if size >= LEAST:
            out.append((i, i))
            held = 0
            continue
        first, held, last = (first if held else i), held + size, i
        if held >= LEAST:
            out.append((first, i))
            held = 0
    return out


def units(data: np.ndarray, offs: np.ndarray, want_bands: bool = True):
    """Paragraphs: (row, first byte, end byte, words, key, of several lines), their bands, and their sets; and, of rows
    that have words beside their paragraphs, all words: (row, first byte, end byte, words, key)."""
    at = line_offsets(data, offs)
    h, ranges, starts, ends = words(data, at)
    line_row = np.searchsorted(offs, at[:-1], "right") - 1
    lines = np.array(paragraph_lines(np.diff(ranges), line_row), np.int64).reshape(-1, 2)
    # words of a paragraph stand side by side
    first, last = ranges[:-1][lines[:, 0]], ranges[1:][lines[:, 1]]
    own = np.concatenate([[0], np.cumsum(last - first)])
    by_row = np.searchsorted(starts, offs)
    beside = np.flatnonzero(np.diff(by_row) > np.bincount(line_row[lines[:, 0]], weights=last - first, minlength=len(offs) - 1))
    whole = (beside, starts[by_row[beside]], ends[by_row[beside + 1] - 1], np.diff(by_row)[beside], digests(h, by_row)[beside])
    h = h[np.arange(own[-1]) + np.repeat(first - own[:-1], last - first)]
    several = lines[:, 0] < lines[:, 1]
    facts = (line_row[lines[:, 0]], starts[first], ends[last - 1], last - first, digests(h, own), several)
    s, out = shingles(h, own, SHINGLE)
    e = occurrences(s, out)
    return facts, (bands(min_hashes(e, out, BANDS * ROWS), ROWS) if want_bands and len(lines) else np.zeros((0, BANDS), U)), e, out, whole


def _units(batches):
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column("text")):
            paragraphs, b, _, _, whole = units(data, offs)
            # a whole text has no bands: it is found by its wording alone
            row, begin, end, n, key = (np.concatenate(x) for x in zip(paragraphs[:5], whole, strict=True))
            several = np.append(paragraphs[5], np.zeros(len(whole[0]), bool))
            none = np.arange(len(row)) >= len(b)
            columns = [pa.array(np.append(signed(np.ascontiguousarray(x)), np.zeros(len(whole[0]), np.int64)), mask=none) for x in b.T]
            ids, texts = (batch.column(c).slice(lo, hi - lo).take(pa.array(row)) for c in ("doc_id", "text_hash"))
            base = offs[row]
            yield pa.RecordBatch.from_arrays([ids, texts, pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(key)), pa.array(several), *columns], ["doc_id", "text_hash", "begin", "end", "n", "key", "several", *BAND_NAMES])


def _paragraph_sets(batches):
    for batch in batches:
        for _, _, data, offs in slices(batch.column("text")):
            (_, _, _, _, key, _), _, e, own, _ = units(data, offs, want_bands=False)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), lists((e >> U(32)).astype(np.uint32).view(np.int32), own)], ["key", "items"])


def repeats(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Occurrences of passages that more than one document holds: doc_id, begin, end (bytes of the UTF-8 text), n_words,
    passage (id of the component), first_doc, text_hash (xxhash64 of the text, telling rows of one id apart), removed,
    kind.

    Occurrences in the document of the smallest id (first_doc) are not removed, all others are. kind is ``wording`` for
    paragraphs, and whole texts, that stand in another document word for word, ``linked`` for those in a component of several wordings,
    ``run`` for runs of words inside or across paragraphs (common_runs). A paragraph of several lines of which a run
    to an earlier document covers that similarity's share is not reported besides. Rows of one doc_id are one document; rows of
    null id count together as one document after all others. Null and empty texts hold no passages. Repeated rows are
    reported each. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    with scratch() as keep:
        return keep(staged(_repeats(docs, similarity, doc_id, text), "repeats"))


def _repeats(docs: DataFrame, similarity: float, doc_id: str, text: str) -> DataFrame:
    plain = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))
    plain = plain.withColumn("text_hash", F.xxhash64("text"))
    with scratch() as keep:
        spans = keep(staged(paragraph_repeats(plain, similarity), "paragraph_repeats"))
    with scratch() as keep:
        runs = keep(staged(common_runs(plain, similarity), "common_runs"))
    # a paragraph of several lines may stand, broken otherwise, in an earlier document: then the run tells of it
    told = runs.where("doc_id <> first_doc").select("doc_id", "text_hash", "begin", "end", "first_doc").distinct()
    told = told.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("begin", "end", "first_doc")).alias("told"))
    of_lines = spans.where("several").join(told, ["doc_id", "text_hash"], "left")
    most = f"least(t.end, end) - greatest(t.begin, begin) >= {similarity} * (end - begin)"
    of_lines = of_lines.where(f"told IS NULL OR NOT exists(told, t -> t.first_doc < first_doc AND {most})")
    out = spans.where("NOT several").unionByName(of_lines.drop("told")).drop("several").unionByName(runs.withColumn("kind", F.lit("run")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), "begin", "end", F.col("n").alias("n_words"), "passage", real("first_doc").alias("first_doc"), "text_hash", (F.col("doc_id") != F.col("first_doc")).alias("removed"), "kind")


def paragraph_repeats(plain: DataFrame, similarity: float) -> DataFrame:
    """doc_id, text_hash, begin, end, n, passage, first_doc, kind, several (of more than one line) of the paragraphs of
    ``plain`` (doc_id, text, text_hash; no null ids) that several documents hold, alike or similar."""
    found = staged(plain.mapInArrow(_units, "doc_id long, text_hash long, begin int, end int, n int, key long, several boolean, " + ", ".join(f"{b} long" for b in BAND_NAMES)), "units")
    # one row for each wording; it has bands, and a holder, if it stands as a paragraph anywhere
    paragraph = F.col(BAND_NAMES[0]).isNotNull()
    reps = found.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min(F.when(paragraph, F.col("doc_id"))).alias("holder"), F.max("doc_id").alias("high"), F.max("n").alias("n"), *[F.max(b).alias(b) for b in BAND_NAMES], F.count("*").alias("times"))
    reps = staged(reps, "paragraphs")
    rows = reps.where(paragraph).select("key", "n", F.explode(F.array(*BAND_NAMES)).alias("bucket"))
    sizes, heavy = shared_buckets(rows)
    rows = staged(meet(rows, sizes, heavy), "shared")  # read twice below
    rows = staged(rows.join(rows.groupBy("key").agg(F.sum("size").alias("weight")), "key").select("bucket", "key", "n", "weight", "size"), "buckets")

    def load_sets(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        ids = staged(reps.join(wanted, "key").select("key", F.col("holder").alias("doc_id")), "wanted")
        small = small_enough(ids, BROADCAST_IDS)
        side = lambda c: F.broadcast(ids.select(c).distinct()) if small else ids.select(c).distinct()
        texts = plain.join(side("doc_id"), "doc_id", "left_semi").select("text")
        sets = texts.mapInArrow(_paragraph_sets, "key long, items array<int>").join(side("key"), "key", "left_semi")
        return staged(sets.dropDuplicates(["key"]), "sets")

    _, roots = linked(rows, heavy, load_sets, similarity)
    # wordings that more than one document holds, alone or through a component
    held = reps.select("key", F.col("doc_id").alias("low"), "high", "times").join(roots.withColumnRenamed("node", "key"), "key", "left")
    alone = held.where("root IS NULL AND low < high").selectExpr("key", "key AS passage", "low AS first_doc", "'wording' AS kind", "times")
    many = held.where("root IS NOT NULL")
    spans = many.groupBy(F.col("root").alias("passage")).agg(F.min("low").alias("first_doc"), F.max("high").alias("high")).where("first_doc < high").drop("high")
    chosen = alone.unionByName(many.withColumnRenamed("root", "passage").join(spans, "passage").selectExpr("key", "passage", "first_doc", "'linked' AS kind", "times"))
    chosen = staged(chosen, "passages")
    common = chosen.where(F.col("times") > (chosen.agg(F.sum("times")).first()[0] or 0) / HEAVY).select("key")
    return meet(found.select("doc_id", "text_hash", "begin", "end", "n", "key", "several"), chosen.drop("times"), common, "key", "text_hash").drop("key")


def _cut_out(batches):
    for batch in batches:
        texts, spans = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()
        made = []
        for text, own in zip(texts, spans, strict=True):
            if text is not None and own:
                kept, at = [], 0
                for s in sorted(own, key=lambda s: (s["begin"], s["end"])):
                    if s["begin"] > at:
                        kept.append(text[at : s["begin"]])
                    at = max(at, s["end"])
                text = b"".join([*kept, text[at:]])
            made.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.binary()).cast(pa.string())], ["row", "text"])
    release()


def remove_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text and any columns) without the removed passages; every row stays, n_chars (if there) is
    counted anew. Repeated rows lose the same passages; rows of one id but other texts, null ids too, each their own.
    Null texts stay null. Columns of any names are passed through; an empty table gives no rows."""
    ship(docs.sparkSession)
    gone = repeats(docs, similarity).where("removed").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(row, docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("hash"), docs["text"].cast("string").alias("text"))
    met = rows.join(gone, rows["id"].eqNullSafe(gone["doc_id"]) & (rows["hash"] == gone["text_hash"]), "left").select("row", "text", "spans")
    cut = met.mapInArrow(_cut_out, T.StructType([met.schema["row"], met.schema["text"]]))
    put = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[(put[c] if c in put else F.col("row")[c]).alias(c) for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
