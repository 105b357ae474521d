"""Benchmark decontamination by winnowing, in DataFrame operations only.

A document and an item that share WINDOW words share, in that span, the same minimum of its GRAM-word hashes; keeping
the minimum of each run of WINDOW - GRAM + 1 hashes on both sides therefore finds every such pair. Fingerprints meet
in an equi-join; hits are then extended to exact windows by comparing words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import hot, meet
from .runtime import scratch, small_enough, staged, table

WINDOW = 10
GRAM = 7
#: Separators between words: all ASCII but digits and letters (after lower-casing).
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_PRINTS = 2_000_000
BROADCAST_HITS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_words(text):
    """Words of a text after lower-casing A-Z; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), "")


def folded_words(text):
    """As many words at the same places, lower-cased in full: equal wherever ``exact_words`` are, and cheaper."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def bound(value, body):
    """``body`` of ``value`` worked out once: the optimizer cannot copy it into each place where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prints(w, shorts: list[int]):
    """Winnowed hashes of the words ``w``. ``shorts``: lengths of items under WINDOW words; hashes of all runs of such
    lengths are kept too, as winnowing only promises spans of WINDOW words."""

    def runs(n: int, *salt):
        each = lambda i: F.xxhash64(*salt, *[F.get(w, i + j) for j in range(n)])
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), each)).otherwise(F.array().cast("array<bigint>"))

    def lowest(g, span: int = 1):
        # minima of runs of WINDOW - GRAM + 1 hashes, from minima of shorter runs; at the end of a text they cover fewer
        step = min(span, WINDOW - GRAM + 1 - span)
        if not step:
            return F.array_distinct(g)
        return bound(F.zip_with(g, F.slice(g, F.lit(step + 1), F.size(g)), lambda a, b: F.least(a, b)), lambda m: lowest(m, span + step))

    parts = [bound(runs(GRAM), lambda g: lowest(g)), *[runs(n, F.lit(n)) for n in shorts]]
    return parts[0] if len(parts) == 1 else F.array_distinct(F.concat(*parts))


def windows(w, n):
    """struct(at, n, win) of all runs of ``n`` words of ``w``."""
    each = lambda i: F.struct(i.alias("at"), n.cast("int").alias("n"), F.array_join(F.slice(w, i + 1, n), " ").alias("win"))
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), each)).otherwise(F.array().cast("array<struct<at:int,n:int,win:string>>"))


def item_windows(bench: DataFrame, item_id: str, text: str) -> DataFrame:
    """win, n and the items that hold it, for each window of the items."""
    own = lambda w: F.when(F.size(w) > 0, windows(w, F.least(F.size(w), F.lit(WINDOW))))
    flat = bench.select(F.col(item_id).cast("string").alias("item"), F.explode_outer(bound(exact_words(F.col(text)), own)).alias("x")).where("x IS NOT NULL")
    return flat.groupBy("x.win", "x.n").agg(F.collect_set("item").alias("items"))


def text_key(text):
    """What stands for a text: 128 bits of hash."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def contamination(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, keep_at (the
    positions of hit words), and key (``text_key``).

    Null texts have no words. A null item id takes part in hits but is not counted as an item. Rows that repeat are
    judged one by one; rows of one doc_id with different texts too. No items, or none with words: nothing is hit. An
    empty table gives no rows.
    """
    with scratch() as keep:
        return keep(staged(_contamination(docs, bench, doc_id, text, item_id, item_text), "contamination"))


def _contamination(docs: DataFrame, bench: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    wins = staged(item_windows(bench, item_id, item_text), "windows")
    shorts = sorted(r["n"] for r in wins.where(F.col("n") < WINDOW).select("n").distinct().collect())  # WINDOW - 1 numbers at most
    # fingerprints of the items
    own = bench.select(F.explode_outer(bound(folded_words(F.col(item_text)), lambda w: prints(w, shorts))).alias("print")).dropna().distinct()
    own = staged(own, "prints")
    own = F.broadcast(own) if small_enough(own, BROADCAST_PRINTS) else own
    # a text's key stands for it: rows of equal texts are judged once
    key = text_key(F.col("text"))
    seen = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), prints(w, shorts).alias("prints"))
    base = staged(rows.select("doc_id", key.alias("key"), bound(folded_words(F.col("text")), seen).alias("s")).select("doc_id", "key", "s.*"), "fingerprints")
    found = base.select("doc_id", "key", F.explode_outer("prints").alias("print")).join(own, "print", "left_semi")
    found = staged(found.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "hits")
    near = F.broadcast(found) if small_enough(found, BROADCAST_HITS) else found
    # exact windows of the texts that share a fingerprint; one text of each key
    lengths = sorted({*shorts, WINDOW})
    every = lambda w: F.concat(*[windows(w, F.lit(n)) for n in lengths])
    near = near.select(F.col("key").alias("__key"), F.col("doc_id").alias("__id"))
    texts = rows.withColumn("key", key).join(near, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").dropDuplicates(["key"])
    runs = texts.select("key", F.explode_outer(bound(exact_words(F.col("text")), every)).alias("x")).select("key", "x.*")
    wide = F.broadcast(wins) if small_enough(wins, BROADCAST_HITS) else wins
    met = runs.join(wide, ["win", "n"])
    spots = met.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(at, at + n - 1)")))).alias("keep_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    judged = staged(spots, "spots")
    out = base.select("doc_id", "key", "n_words")
    if small_enough(judged, BROADCAST_HITS // 20):
        out = out.join(F.broadcast(judged), "key", "left")
    else:
        # rows of a common text are spread over tasks
        out = meet(out.withColumn("turn", F.monotonically_increasing_id()), judged, hot(base, "key"), "key", "turn", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce(F.size("keep_at"), F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.coalesce(F.size("keep_at") > 0, F.lit(False)).alias("contaminated"), "keep_at", "key")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("keep_at", "key")


SQL = r"""
WITH dw AS (SELECT rowid_, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rowid_, * FROM documents)),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ii AS (SELECT item_id, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM ii)),
lens AS (SELECT DISTINCT n FROM wins),
runs AS (SELECT rowid_, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rowid_, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens)),
met AS (SELECT rowid_, i, runs.n, item FROM runs JOIN wins ON runs.n = wins.n AND runs.win = wins.win),
hits AS (SELECT rowid_, count(DISTINCT p) AS n_hit FROM (SELECT rowid_, unnest(range(i, i + n)) AS p FROM met) GROUP BY rowid_),
its AS (SELECT rowid_, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY rowid_)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (rowid_) LEFT JOIN its USING (rowid_)
"""
