"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = (1 - u) * P(class | history) * P(cell | class, history) * count(word) / count(cell) for words of the
training texts; u, the Good-Turing mass, goes to all others as one event. Both factors are softmaxes over weights of
hashed features of the history: the word before and the two words before (n-grams), the word two and three before (skips);
for cells, the word before and the one two before, each with the class. Classes are clusters of words by their endings
and neighbours; the commonest words of a class are cells of their own, the others share cells by their endings.

Counts cover all training texts. Weights start from counts of features with classes and cells over all training tokens.
Then come ROUNDS steps of gradient descent: each sums the gradients of a share of the documents over all tasks, and all
tasks go on from the same new weights, so the model doesn't depend on how the documents are dealt out. The tables have a row
for each TOKENS_A_ROW training tokens. A bounded table of the commonest words is broadcast; tokens of all other words
meet the full count table in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import fold, scratch, ship, staged, table
from .wordhash import SOLID, U, _C, lists, mix, signed, slices, words

HEAD = 1 << 18  # commonest words that every worker knows
CLASSES, CELLS, SHARED = 32, 32, 8  # classes, cells of each, and how many of these are shared
SUFFIX_BITS = 10
TOKENS_A_ROW, MIN_ROWS, MAX_ROWS = 2048, 1 << 10, 1 << 18  # rows of each table, a power of 2: 34 MB at most
ROW_TOKENS = 256  # tokens that a training task reads for each row of the tables it sends, at least
ROUNDS = 3
RATE, CLIP, LIMIT = 0.5, 0.5, 10.0  # of a step; of a weight
PRIOR = 20.0  # tokens that the prior of a row counts for
START = (0.6, 0.3, 0.3, 0.2), (0.6, 0.3)  # weight of each feature's counts at the start: of classes, of cells
BATCH = 2048  # tokens whose sums fit a core's cache
FLUSH = 1_000_000  # distinct words that a counting task holds
END = np.array([0x5851F42D4C957F2D], U)  # hash of the token that ends a text


def tokens(data: np.ndarray, offs: np.ndarray):
    """Hash and suffix slot of all tokens of rows, an end after each row's words, and rows' ranges."""
    h, ranges, starts, ends = words(data, offs, SOLID)
    rows = np.arange(len(offs) - 1)
    out = np.concatenate([[0], ranges[1:] + rows + 1])
    all_h, sfx = np.empty(out[-1], U), np.zeros(out[-1], np.int64)
    place = np.arange(len(h)) + np.repeat(rows, np.diff(ranges))
    all_h[place] = h
    low = data | np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0)) if len(data) else data
    if len(h):
        tail = low[ends - 1].astype(U) | np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(U) << U(8)
        sfx[place] = (mix(tail + _C[2]) >> U(64 - SUFFIX_BITS)).astype(np.int64)
    all_h[out[1:] - 1] = END
    return all_h, sfx, out


def before(x: np.ndarray, ranges: np.ndarray, back: int, fill: int) -> np.ndarray:
    """What stands ``back`` places before each token of its row."""
    out = np.full(len(x), fill, x.dtype)
    out[back:] = x[:-back] if back < len(x) else x[:0]
    for j in range(back):
        at = ranges[:-1] + j
        out[at[at < ranges[1:]]] = fill
    return out


def _count(batches):
    """(kind, key, suffix, count): 0 for words, 1 for pairs of neighbouring suffix slots."""
    size = 1 << SUFFIX_BITS
    held, pairs = [np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)], np.zeros(size * size, np.int64)

    def merge(parts):
        h, s, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return [keys, s[first], np.bincount(inverse, weights=c, minlength=len(keys)).astype(np.int64)]

    def emit(kind, key, sfx, count):
        for lo in range(0, len(key), 1 << 17):
            cut = slice(lo, lo + (1 << 17))
            n = len(key[cut])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(key[cut]), pa.array(sfx[cut].astype(np.int32)), pa.array(count[cut])], ["kind", "key", "sfx", "c"])

    for batch in batches:
        for _, _, data, offs in slices(batch.column("text")):
            h, sfx, ranges = tokens(data, offs)
            keys, first, counts = np.unique(h, return_index=True, return_counts=True)
            held = merge([held, [keys, sfx[first], counts]])
            pairs += np.bincount(before(sfx, ranges, 1, 0) * size + sfx, minlength=size * size)
            if len(held[0]) > FLUSH:
                yield from emit(0, signed(held[0]), held[1], held[2])
                held = [x[:0] for x in held]
    yield from emit(0, signed(held[0]), held[1], held[2])
    at = np.flatnonzero(pairs)
    yield from emit(1, at, np.zeros(len(at), np.int64), pairs[at])


def suffix_classes(pairs: np.ndarray, classes: int, rounds: int = 15) -> np.ndarray:
    """A class for each suffix slot: spherical k-means over the slots' neighbours on both sides."""
    x = np.concatenate([np.log1p(pairs), np.log1p(pairs.T)], axis=1)
    x -= x.mean(0)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.maximum(norm, 1e-9)
    mass = pairs.sum(0)
    centre = x[np.argsort(-mass, kind="stable")[:classes]]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        for k in range(len(centre)):
            own = near == k
            if own.any():
                centre[k] = (x[own] * np.sqrt(mass[own] + 1)[:, None]).sum(0)
        centre = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return near


class Model:
    """What workers need: the head words (sorted hashes, counts, cells), classes of suffix slots, and weights. A place is
    class * CELLS + cell."""

    def __init__(self, head_h, head_c, head_sfx, slot_class, by_slot, n, v, unseen):
        order = np.argsort(head_h, kind="stable")
        self.keys, self.counts = head_h[order], head_c[order]
        # hashes are even: the first bits tell where to look, to a few places
        self.bits = max(1, len(order).bit_length() + 1)
        self.begin = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=U) << U(64 - self.bits)).astype(np.int32)
        slot = np.arange(len(slot_class))
        # words without a cell of their own share one by their endings
        self.slot_place = slot_class * CELLS + CELLS - 1 - (mix(slot.astype(U) + _C[3]) >> U(40)).astype(np.int64) % SHARED
        total = np.bincount(self.slot_place, weights=by_slot, minlength=CLASSES * CELLS)
        place = self.slot_place[head_sfx]
        cls = place // CELLS
        rank = np.empty(len(cls), np.int64)  # in its class, the commonest first
        by = np.lexsort((head_h, -head_c, cls))
        rank[by] = np.arange(len(by)) - np.searchsorted(cls[by], cls[by])
        own = rank < CELLS - SHARED
        np.subtract.at(total, place[own], head_c[own])
        place[own] = cls[own] * CELLS + rank[own]
        np.add.at(total, place[own], head_c[own])
        self.places = place[order]
        self.n, self.v, self.unseen = n, v, unseen
        total = np.maximum(total, 0).reshape(CLASSES, CELLS)
        self.log_total = np.log10(np.maximum(total, 1)).ravel()
        whole = total.sum(1)
        self.p_class = (whole + 1e-6) / (whole + 1e-6).sum()
        self.p_cell = (total + 1e-9) / (total + 1e-9).sum(1, keepdims=True)
        self.bias = np.log(self.p_class).astype(np.float32), np.log(self.p_cell).astype(np.float32)
        self.rows = int(min(MAX_ROWS, max(MIN_ROWS, 1 << int(max(1, n // TOKENS_A_ROW)).bit_length())))
        self.weights = np.zeros((self.rows, CLASSES), np.float32), np.zeros((self.rows, CELLS), np.float32)

    def describe(self, h: np.ndarray, sfx: np.ndarray):
        """Place and count (0: not a head word) of tokens."""
        at = np.minimum(self.begin[h >> U(64 - self.bits)], len(self.keys) - 1)
        key = self.keys[at]
        known = key == h
        low = np.flatnonzero(key < h)
        while len(low):
            at[low] += 1
            low = low[at[low] < len(self.keys)]
            key = self.keys[at[low]]
            known[low] = key == h[low]
            low = low[key < h[low]]
        at = np.minimum(at, len(self.keys) - 1)
        return np.where(known, self.places[at], self.slot_place[sfx]), np.where(known, self.counts[at], 0)

    def slots(self, h: np.ndarray, place: np.ndarray, ranges: np.ndarray) -> tuple[list, list]:
        """Rows of the weights that each token's history switches on: for its class, for its cell. Each feature has its
        own part of a table."""
        one, two, three = (before(h, ranges, k, 0) for k in (1, 2, 3))
        cls = (place // CELLS).astype(U)
        of_class = [one, mix(one + two * _C[1]), two + _C[2], three + _C[3]]
        of_cell = [mix(one + _C[4]) + cls, mix(two + _C[5]) + cls]
        part = lambda xs: [((mix(x) >> U(32)) % U(self.rows // len(xs))).astype(np.int32) + k * (self.rows // len(xs)) for k, x in enumerate(xs)]
        return part(of_class), part(of_cell)

    def factor(self, which: int, slots: list, place: np.ndarray, spread: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each token's class (0) or of its cell in the class (1). ``spread`` (values x tokens), if
        given, takes the probabilities of all classes or cells."""
        w, out, ones = self.weights[which], np.empty(len(place)), np.ones(self.weights[which].shape[1], np.float32)
        target = place % CELLS if which else place // CELLS
        for lo in range(0, len(place), BATCH):
            cut = slice(lo, lo + BATCH)
            z = w.take(slots[0][cut], axis=0)
            for s in slots[1:]:
                z += w.take(s[cut], axis=0)
            z += self.bias[1].take(place[cut] // CELLS, axis=0) if which else self.bias[0]
            out[cut] = z[np.arange(len(z)), target[cut]]
            np.exp(z, out=z)  # weights are clipped: no overflow
            total = z @ ones
            out[cut] -= np.log(total)
            if spread is not None:
                z *= (1 / total)[:, None]
                spread[:, cut] = z.T
        return out

    def start(self, counts: tuple[np.ndarray, np.ndarray]) -> None:
        """Weights from counts of rows with classes and cells: log-ratios to the prior, shrunk."""
        self.seen = counts
        prior = self.p_class[None, :], self._cell_prior(counts[1])
        for w, c, p, scale in zip(self.weights, counts, prior, START, strict=True):
            n = c.sum(1, keepdims=True)
            feature = np.repeat(scale, self.rows // len(scale))[:, None]
            w[:] = np.clip(feature * np.log((c + PRIOR * p) / ((n + PRIOR) * p)), -LIMIT, LIMIT)

    def _cell_prior(self, counts: np.ndarray) -> np.ndarray:
        """A row of cells is of several classes at times, by collision: its prior is the mean over all."""
        mean = self.p_class @ self.p_cell
        return np.maximum(mean, 1e-6)[None, :]

    def step(self, gradients: tuple[np.ndarray, np.ndarray], share: float) -> None:
        """One step along the gradients of a share of the tokens, scaled by the curvature that the counts tell."""
        for w, g, c in zip(self.weights, gradients, self.seen, strict=True):
            n = c.sum(1, keepdims=True)
            curve = share * (c + PRIOR * (c.sum(0) + 1) / (c.sum() + c.shape[1])) * n / (n + PRIOR) + 2
            w += (RATE * np.clip(g / curve, -CLIP, CLIP)).astype(np.float32)
            np.clip(w, -LIMIT, LIMIT, out=w)


def summed(parts: DataFrame, rows: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Sums of both tables' rows over all tasks, and of the tokens seen."""
    blocks = parts.repartition("block").mapInArrow(_add, "tab int, row int, seen long, vals binary").toArrow()
    out = np.zeros((rows, CLASSES), np.float32), np.zeros((rows, CELLS), np.float32)
    for batch in blocks.to_batches():
        tab, row, vals = unpacked(batch)
        for k, x in enumerate(out):
            x[row[tab == k]] = vals[tab == k]
    return out, int(blocks.column("seen").to_numpy().sum())


def unpacked(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table, row and values of the rows of tables in a batch."""
    tab = batch.column("tab").to_numpy()
    real = np.flatnonzero(tab >= 0)
    vals = np.frombuffer(b"".join(batch.column("vals").take(pa.array(real)).to_pylist()), np.float32).reshape(len(real), CLASSES)
    return tab[real], batch.column("row").to_numpy()[real], vals


def _emitted(tables, seen: int):
    """The rows of both tables that aren't zero, a batch for every few thousand; and a row of the tokens seen."""
    names = ["block", "tab", "row", "seen", "vals"]
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([seen], pa.int64()), pa.array([b""], pa.binary())], names)
    for tab, x in enumerate(tables):
        rows = np.flatnonzero(x.any(1))
        for lo in range(0, len(rows), 8192):
            own = rows[lo : lo + 8192]
            width = 4 * x.shape[1]
            vals = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, (len(own) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x[own], np.float32))])
            yield pa.RecordBatch.from_arrays([pa.array((own >> 6).astype(np.int32)), pa.array(np.full(len(own), tab, np.int32)), pa.array(own.astype(np.int32)), pa.array(np.zeros(len(own), np.int64)), vals], names)


def _add(batches):
    """Sums of rows over tasks: rows of one block of 64 meet in one task."""
    index: dict[int, int] = {}  # place of a row in the sums, by table and row
    sums, seen = np.zeros((0, CLASSES)), 0
    for batch in batches:
        seen += int(batch.column("seen").to_numpy().sum())
        tab, row, vals = unpacked(batch)
        if not len(tab):
            continue
        key = tab.astype(np.int64) << 32 | row
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        at = np.array([index.setdefault(k, len(index)) for k in key[order[first]].tolist()])
        if len(index) > len(sums):
            sums = np.concatenate([sums, np.zeros((2 * len(index) - len(sums), CLASSES))])
        sums[at] += np.add.reduceat(vals[order], first, axis=0, dtype=np.float64)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([seen], pa.int64()), pa.array([b""], pa.binary())], ["tab", "row", "seen", "vals"])
    if index:
        keys = np.array(list(index))
        data = [x.tobytes() for x in sums[: len(index)].astype(np.float32)]
        yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array(keys.astype(np.int32)), pa.array(np.zeros(len(keys), np.int64)), pa.array(data, pa.binary())], ["tab", "row", "seen", "vals"])


def _start_counts(shared):
    """Counts of rows with the classes and cells of their tokens."""

    def count(batches):
        model = shared.value
        sums, seen = [np.zeros(model.rows * k, np.int64) for k in (CLASSES, CELLS)], 0
        for batch in batches:
            for _, _, data, offs in slices(batch.column("text")):
                h, sfx, ranges = tokens(data, offs)
                place, _ = model.describe(h, sfx)
                seen += len(h)
                for x, slots, target, width in zip(sums, model.slots(h, place, ranges), (place // CELLS, place % CELLS), (CLASSES, CELLS), strict=True):
                    for s in slots:
                        np.add.at(x, s * np.int64(width) + target, 1)
        yield from _emitted([x.reshape(model.rows, -1) for x in sums], seen)

    return count


def _gradients(shared):
    """Sums over tokens of (target - probability) for each row that their histories switch on. The tables are large:
    only a feature's part of a column is made anew at a time."""

    def train(batches):
        model = shared.value
        sums, seen = [np.zeros(w.shape[::-1]) for w in model.weights], 0
        for batch in batches:
            for _, _, data, offs in slices(batch.column("text"), 1 << 20):
                h, sfx, ranges = tokens(data, offs)
                place, _ = model.describe(h, sfx)
                seen += len(h)
                spread = np.empty((CLASSES, len(h)))
                for which, (x, slots) in enumerate(zip(sums, model.slots(h, place, ranges), strict=True)):
                    model.factor(which, slots, place, spread)
                    spread[place % CELLS if which else place // CELLS, np.arange(len(h))] -= 1
                    size = model.rows // len(slots)
                    for part, s in enumerate(slots):
                        s = s.astype(np.intp) - part * size
                        for k, own in enumerate(spread):
                            x[k, part * size : (part + 1) * size] -= np.bincount(s, weights=own, minlength=size)
        yield from _emitted([x.T for x in sums], seen)

    return train


def _score(shared):
    def score(batches):
        from pyspark import TaskContext

        model = shared.value
        row, task = 0, TaskContext.get().partitionId()
        base_of = lambda c: np.log10((c + 0.5) / (model.n + 0.5 * (model.v + 1)))
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                h, sfx, ranges = tokens(data, offs)
                place, c = model.describe(h, sfx)
                of_class, of_cell = model.slots(h, place, ranges)
                part = (model.factor(0, of_class, place) + model.factor(1, of_cell, place)) / np.log(10)
                part += np.log10(1 - model.unseen) - model.log_total[place]
                head = c > 0
                whole = np.where(head, part + np.log10(np.maximum(c, 1)), 0)
                per = lambda x: np.add.reduceat(x, ranges[:-1])  # noqa: B023, E731
                rest = np.concatenate([[0], np.cumsum(per((~head).astype(np.int64)))])
                n = hi - lo
                ids = task * (1 << 40) + row + np.arange(n)
                row += n
                tail = pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.StructArray.from_arrays([pa.array(signed(h[~head])), pa.array(part[~head])], ["key", "part"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(ids), pa.array(np.diff(ranges).astype(np.int64)), pa.array(per(head.astype(np.int64))), pa.array(per(np.where(head, base_of(c), 0))), pa.array(per(whole)), tail], ["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "tail"])

    return score


def fit(docs: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model of all texts of ``docs`` and the table of word counts (key, c); None without texts."""
    spark = docs.sparkSession
    counts = docs.mapInArrow(_count, "kind int, key long, sfx int, c long")
    counts = staged(counts.groupBy("kind", "key").agg(F.sum("c").alias("c"), F.min("sfx").alias("sfx")), "counts")
    vocabulary = counts.where("kind = 0")
    stats = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once")).first()
    if not stats["n"]:
        return None, vocabulary
    head = vocabulary.orderBy(F.desc("c"), "key").limit(HEAD).select("key", "c", "sfx").toArrow()  # HEAD rows at most
    size = 1 << SUFFIX_BITS
    pairs = counts.where("kind = 1").select("key", "c").toArrow()  # size * size rows at most
    matrix = np.zeros(size * size)
    matrix[pairs.column("key").to_numpy()] = pairs.column("c").to_numpy()
    slot_class = suffix_classes(matrix.reshape(size, size), CLASSES)
    by_slot = np.zeros(size)
    for r in vocabulary.groupBy("sfx").agg(F.sum("c").alias("c")).collect():  # size rows at most
        by_slot[r["sfx"]] = r["c"]
    key, c, sfx = (head.column(x).to_numpy() for x in ("key", "c", "sfx"))
    unseen = float(np.clip(stats["once"] / stats["n"], 1 / (stats["n"] + 1), 0.5))
    model = Model(key.view(U), c, sfx, slot_class, by_slot, stats["n"], stats["v"], unseen)
    # fewer, larger tasks: each sends whole tables
    tasks = max(1, stats["n"] // (ROW_TOKENS * model.rows))

    def over(rows: DataFrame, work) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        shared = spark.sparkContext.broadcast(model)
        try:
            return summed(rows.coalesce(tasks).mapInArrow(work(shared), "block int, tab int, row int, seen long, vals binary"), model.rows)
        finally:
            shared.destroy()

    model.start(over(docs, _start_counts)[0])
    for turn in range(ROUNDS):
        gradients, seen = over(docs.where(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(ROUNDS)) == turn), _gradients)
        if seen:
            model.step(gradients, seen / model.n)
    model.seen = None
    return model, vocabulary


def score_texts(docs: DataFrame, learn=None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``, learned from the rows where
    ``learn`` holds (default: crc32(doc_id as text) mod 5 is not 1).

    A null text counts as empty: one token, the end. Repeated rows are scored each and learned from each. If no row
    teaches, every token is unknown and both scores are 0. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    with scratch() as keep:
        return keep(staged(_score_texts(docs, learn), "lm_scores"))


def _score_texts(docs: DataFrame, learn) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model, vocabulary = fit(rows.where(fold("doc_id", 5) != 1 if learn is None else learn).select("text"))
    if model is None:
        none = np.zeros(1, np.int64)
        model = Model(np.zeros(1, U), none, none, np.zeros(1 << SUFFIX_BITS, np.int64), np.zeros(1 << SUFFIX_BITS), 0, 0, 1 - 1e-12)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = staged(rows.mapInArrow(_score(shared), f"doc_id {kind}, row long, n_tokens long, n_known long, base_score double, score double, tail array<struct<key: bigint, part: double>>"), "scored")
    shared.destroy()
    # words beyond the head: counted per text first, then met with the full table
    tail = scored.select("row", F.explode("tail").alias("t")).groupBy("row", F.col("t.key").alias("key")).agg(F.count("*").alias("times"), F.sum("t.part").alias("part"))
    met = tail.join(vocabulary.select("key", "c"), "key", "left")
    v, n = float(model.v), float(model.n)
    unknown = float(np.log10(model.unseen)) if n else 0.0
    count = F.coalesce("c", F.lit(0))
    base = F.col("times") * F.log10((count + 0.5) / F.lit(n + 0.5 * (v + 1)))
    own = F.when(F.col("c").isNull(), F.col("times") * F.lit(unknown)).otherwise(F.col("part") + F.col("times") * F.log10(F.col("c")))
    more = met.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("k"), F.sum(base).alias("b"), F.sum(own).alias("s"))
    out = scored.drop("tail").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), plus("base_score", "b").alias("base_score"), plus("score", "s").alias("score"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
