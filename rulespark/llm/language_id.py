"""Language of texts: script ranges narrow the candidates of each word, hashed letter n-grams score them, and Viterbi
with a penalty on switches labels spans of one language.

The Viterbi recursion of a long text is cut into blocks of words. All blocks of a batch advance together, from every
possible entry language; the blocks' transfer tables are then chained, which gives the exact path of the whole text.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import fold, ship, table
from .wordhash import LOWER, U, _C, mix, slices, words

FIT_DOCS = 1500  # documents per language that the model is fitted on, at most; whole texts
BITS = 16  # of each feature table
PART_DOCS = 1000
PENALTY = 8.0  # nats for a switch of language
BLOCK = 64
SCALE = 0.5  # features of a word overlap
ALPHA = (0.5, 0.1, 0.1)  # added to the counts of pairs, triples and words
HELD_LANGUAGES = 16  # whose counts a counting task holds at a time

# Code-point ranges of scripts; letters elsewhere are of script 0.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
}
N_SCRIPTS = len(SCRIPTS) + 1
SLOTS = 3 << BITS


@cache
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 1 for a letter, 2 for a mark that goes with letters, else 0; and its script."""
    kind, script = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    kind[:] = [{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)]
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            script[low : high + 1] = number
    return kind, script


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind (see ``code_points``) of the character that each byte of UTF-8 text belongs to, and, at its first byte, its
    script."""
    kinds, scripts = code_points()
    kind, script = kinds[data], scripts[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        kind[data >= 128] = 0
        head = data[lead].astype(np.int32)
        for size, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
            at = lead[(head >= low) & (head < high)]
            c = data[at].astype(np.int32) & bits
            for j in range(1, size):
                c = c << 6 | data[at + j] & 0x3F
            script[at] = scripts[c]
            for j in range(size):
                kind[at + j] = kinds[c]
    return kind, script


def features(data: np.ndarray, offs: np.ndarray):
    """Word of each feature, its slot in the table, words' ranges by row, script and bytes of each word, and whether each
    row has a letter.

    Features of a word: the word itself, and its pairs and triples of bytes with a blank on both sides.
    """
    kind, script = letters(data)
    mask = kind > 0
    h, ranges, starts, ends = words(data, offs, mask=mask)
    n = ends - starts
    low = np.where(mask, LOWER[data], 32).astype(U)
    padded = np.concatenate([np.array([32, 32], U), low, np.array([32, 32], U)])
    row = np.repeat(np.arange(len(n)), n + 1)
    begin = np.cumsum(n + 1) - (n + 1)
    at = np.arange(len(row)) - begin[row] + starts[row]  # the byte that a pair or triple ends at; the last: the blank behind
    last = at == ends[row]
    first = at == starts[row]
    c = np.where(last, U(32), padded[at + 2])
    b = np.where(first, U(32), padded[at + 1])
    a = np.where(first | (at == starts[row] + 1), U(32), padded[at])
    top = U(64 - BITS)
    pair = mix((b << U(8) | c) + _C[2]) >> top
    triple = mix((a << U(16) | b << U(8) | c) + _C[3]) >> top
    size = 1 << BITS
    held = np.concatenate([[0], np.cumsum(kind == 1)])
    has_letter = held[offs[1:]] > held[offs[:-1]]
    return row, begin, pair.astype(np.int64), triple.astype(np.int64) + size, (h >> top).astype(np.int64) + 2 * size, ranges, script[starts], n, has_letter


def _counts(batches):
    """(lang, slot, count): how often each feature occurs; slots from SLOTS on: bytes of words of each script."""
    held: dict[str, np.ndarray] = {}

    def emitted():
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "slot", "count"])
        held.clear()

    for batch in batches:
        langs = batch.column("lang").cast(pa.string()).to_pylist()
        for lang in sorted(set(langs)):
            if lang not in held and len(held) == HELD_LANGUAGES:
                yield from emitted()
            own = held.setdefault(lang, np.zeros(SLOTS + N_SCRIPTS, np.int64))
            for _, _, data, offs in slices(batch.column("text").take(pa.array(np.flatnonzero([x == lang for x in langs])))):
                _, _, pair, triple, word, _, script, n, _ = features(data, offs)
                own[:SLOTS] += np.bincount(np.concatenate([pair, triple, word]), minlength=SLOTS)
                own[SLOTS:] += np.bincount(script, weights=n, minlength=N_SCRIPTS).astype(np.int64)
    yield from emitted()


def _logs(rows: pa.Table) -> pa.Table:
    """Log-probabilities of a language's features, and its bytes by script."""
    c = np.zeros(SLOTS + N_SCRIPTS)
    c[rows.column("slot").to_numpy()] = rows.column("count").to_numpy()
    parts = [part + alpha for part, alpha in zip(np.split(c[:SLOTS], 3), ALPHA, strict=True)]
    logs = np.concatenate([np.log(part / part.sum()) for part in parts]).astype(np.float32)
    return pa.table({"lang": rows.column("lang").slice(0, 1), "logs": pa.array([logs.tobytes()], pa.binary()), "scripts": pa.array([c[SLOTS:].tolist()], pa.list_(pa.float64()))})


def model_of(rows: DataFrame) -> dict | None:
    """Log-probability tables of each language of ``rows`` (lang, text), and which scripts it uses; None without rows.
    Executors count; a table of fixed size for each language comes to the driver."""
    counts = rows.mapInArrow(_counts, "lang string, slot int, count long").groupBy("lang", "slot").agg(F.sum("count").alias("count"))
    made = counts.groupBy("lang").applyInArrow(_logs, "lang string, logs binary, scripts array<double>").toArrow().sort_by("lang")
    if not made.num_rows:
        return None
    logs = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in made.column("logs")], axis=1)
    scripts = np.array(made.column("scripts").to_pylist()).T
    allowed = scripts >= 0.005 * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True  # a script that no language uses rules nothing out
    return {"names": made.column("lang").to_pylist(), "logs": logs, "allowed": allowed}


def word_scores(model: dict, data: np.ndarray, offs: np.ndarray):
    """Scores of each word for each language, words' ranges by row, bytes of each word, and whether rows have letters."""
    row, begin, pair, triple, word, ranges, script, n, has_letter = features(data, offs)
    logs = model["logs"]
    if not len(n):
        return np.zeros((0, logs.shape[1]), np.float32), ranges, n, has_letter
    score = np.add.reduceat(logs[pair] + logs[triple], begin, axis=0) + logs[word]
    score = SCALE * (score - score.max(1, keepdims=True))
    np.maximum(score, -20, out=score)  # one odd word isn't worth more than a few switches
    score[~model["allowed"][script]] = -40
    return score, ranges, n, has_letter


def viterbi(score: np.ndarray, ranges: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on the best path of each row."""
    n_words, L = score.shape
    m = np.diff(ranges)
    if L == 1 or not n_words:
        return np.zeros(n_words, np.int16)
    per_row = -(-m // BLOCK)
    first = np.concatenate([[0], np.cumsum(per_row)])
    blocks = int(first[-1])
    row = np.repeat(np.arange(len(m)), m)
    place = np.arange(n_words) - ranges[row]
    block, step = first[row] + place // BLOCK, place % BLOCK
    S = np.zeros((BLOCK, blocks, L), np.float32)  # words behind a row's end score 0: no reason to switch
    S[step, block] = score
    # transfer tables: best score of leaving each block in l when entered in s
    T = np.full((blocks, L, L), -1e9, np.float32)
    T[:, np.arange(L), np.arange(L)] = 0
    for t in range(BLOCK):
        T = S[t][:, None, :] + np.maximum(T, T.max(2, keepdims=True) - penalty)
    # chain the blocks of each row
    entry = np.zeros((blocks, L), np.float32)
    order = np.argsort(-per_row, kind="stable")
    counts = per_row[order]
    for j in range(int(per_row.max()) - 1):
        live = first[order[: np.searchsorted(-counts, -(j + 1), "left")]] + j
        v = (entry[live][:, :, None] + T[live]).max(1)
        entry[live + 1] = v - v.max(1, keepdims=True)
    # forward again from the true entries, keeping what a step back needs
    V = entry
    stay, best = np.empty((BLOCK, blocks, L), bool), np.empty((BLOCK, blocks), np.int16)
    for t in range(BLOCK):
        top = V.max(1)
        best[t] = V.argmax(1)
        stay[t] = V >= (top - penalty)[:, None]
        V = S[t] + np.maximum(V, (top - penalty)[:, None])
    # where each exit comes from, then the exits of all blocks from the last back
    ids = np.arange(blocks)
    came = np.tile(np.arange(L, dtype=np.int16), (blocks, 1))
    for t in range(BLOCK - 1, -1, -1):
        came = np.where(stay[t][ids[:, None], came], came, best[t][:, None])
    leave = V.argmax(1).astype(np.int16)
    for j in range(int(per_row.max()) - 2, -1, -1):
        live = first[order[: np.searchsorted(-counts, -(j + 1), "left")]] + j
        leave[live] = came[live + 1, leave[live + 1]]
    path = np.empty((BLOCK, blocks), np.int16)
    state = leave
    for t in range(BLOCK - 1, -1, -1):
        path[t] = state
        state = np.where(stay[t][ids, state], state, best[t])
    return path[step, block]


def judge(model: dict, col) -> tuple[list, np.ndarray, list, np.ndarray]:
    """Language, score and spans (language, bytes of letters) of each text, and whether it has a letter."""
    names, L = model["names"], len(model["names"])
    langs: list = [None] * len(col)
    scores, lettered = np.zeros(len(col)), np.zeros(len(col), bool)
    spans: list = [[] for _ in range(len(col))]
    for lo, hi, data, offs in slices(col, max(1 << 15, (1 << 21) // max(4, L))):
        score, ranges, n, has_letter = word_scores(model, data, offs)
        path = viterbi(score, ranges)
        row = np.repeat(np.arange(hi - lo), np.diff(ranges))
        held = np.bincount(row * L + path, weights=n, minlength=(hi - lo) * L).reshape(-1, L)
        total = held.sum(1)
        top = held.argmax(1)
        cut = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0)) if len(path) else np.zeros(0, int)
        if len(cut):
            for r, lang, size in zip(row[cut].tolist(), path[cut].tolist(), np.add.reduceat(n, cut).tolist(), strict=True):
                spans[lo + r].append((names[lang], size))
        lettered[lo:hi] = has_letter
        for i in range(hi - lo):
            if has_letter[i]:
                langs[lo + i], scores[lo + i] = names[top[i]], held[i, top[i]] / total[i]
            else:
                langs[lo + i] = "und"
                spans[lo + i] = []
    return langs, scores, spans, lettered


def fit_on(docs: DataFrame, learn, fit_docs: int = FIT_DOCS) -> dict | None:
    """The model of the labelled rows where ``learn`` holds: FIT_DOCS documents of each language at most, picked by
    the hash of their ids; one row of each id. None without any."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64(F.lit(5), "doc_id"))
    # parts of at most PART_DOCS: Spark then drops what lies beyond before the shuffle, so a hot language costs no task more
    parts = -(-fit_docs // PART_DOCS)
    part = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(parts))
    ids = rows.select("doc_id", "lang", "h", part.alias("part")).withColumn("r", F.expr("row_number() over (partition by lang, part order by h, doc_id)"))
    ids = ids.where(F.col("r") <= fit_docs // parts).select("doc_id").distinct()
    return model_of(rows.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("lang", "text"))


def identify(docs: DataFrame, learn=None, extra: tuple[str, ...] = (), rows: DataFrame | None = None) -> DataFrame:
    """doc_id, lang_pred, score, spans, has_letter of each row of ``rows`` (default: ``docs``), learned from the rows of ``docs``
    where ``learn`` holds (default: crc32(doc_id as text) mod 5 is not 0).

    ``und`` with score 0 where the text is null or has no letter (has_letter tells), and ``und`` everywhere if no row
    teaches a language. An empty table gives no rows. Ties go
    to the language first in order. Repeated rows are judged each. Score: the share of the letters' bytes that the
    predicted language holds. Columns named in ``extra`` are passed through.
    """
    spark = docs.sparkSession
    ship(spark)
    model = fit_on(docs.select("doc_id", "text", "lang"), fold("doc_id", 5) != 0 if learn is None else learn)
    if model is None:
        model = {"names": ["und"], "logs": np.zeros((SLOTS, 1), np.float32), "allowed": np.ones((N_SCRIPTS, 1), bool)}
    model = spark.sparkContext.broadcast(model)
    rows = docs if rows is None else rows
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), *[c for c in extra if c != "text"])
    span = pa.list_(pa.struct([("lang", pa.string()), ("bytes", pa.int64())]))
    made = T.StructType.fromDDL("lang_pred string, score double, spans array<struct<lang: string, bytes: bigint>>, has_letter boolean")
    shape = T.StructType([*[rows.schema[c] for c in ("doc_id", *extra)], *made])

    def run(batches):
        for batch in batches:
            langs, scores, spans, lettered = judge(model.value, batch.column("text"))
            made = pa.array([[{"lang": a, "bytes": b} for a, b in x] for x in spans], span)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *extra)], pa.array(langs, pa.string()), pa.array(scores), made, pa.array(lettered)], ["doc_id", *extra, "lang_pred", "score", "spans", "has_letter"])

    return rows.mapInArrow(run, shape)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
