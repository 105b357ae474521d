"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Open bins are counted by the room they have left. A piece goes where the sum of the squared counts becomes smallest:
that keeps many different gaps open, so later pieces find one that fits them exactly.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import scratch, ship, staged, table

LENGTH = 4096
END_ID = 1
PIECES_PER_BLOCK = 40_000
TURNS = 8  # of packing, at most
CACHE_WORDS = 250_000  # tokenised words that a worker remembers

_kept: dict = {}


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Letters that NFC leaves alone and that lower-case one to one: plain ones and those of U+00C0 to U+017F.
_LATIN = "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and ord(c) != 0x130)
_EASY = re.compile(f"[!-~{_LATIN}]+")
# How a tokenizer splits text for which the short way below is right.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRETOKENIZERS = [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: The same splitting pattern, for such text in lower case.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z{_LATIN}0-9]+")


def _byte_symbols() -> dict[int, str]:
    """Byte-level BPE's symbol for each character of U+00C0 to U+017F: its UTF-8 bytes, unprintable ones from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {ord(c): "".join(symbol[b] for b in c.encode()) for c in _LATIN}


def splits_at_blanks(path: str) -> bool:
    """Whether a tokenizer file normalises and splits text as the fixed values above say, so runs without white space
    may be encoded one by one."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    plain = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    model = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
    return plain and model and spec["normalizer"] == {"type": "Sequence", "normalizers": _NORMALIZERS} and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": _PRETOKENIZERS}


class _Encoded(dict):
    """Token ids, as little-endian bytes, of runs of text without ASCII white space; token boundaries fall on these.

    Most runs consist of plain Latin letters, digits and marks: they are split here and each part goes to the
    tokenizer's model once. All others, and those that could hold a special token, go through the whole tokenizer. So do
    whole texts where the tokenizer isn't one that ``splits_at_blanks``.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.short_way = splits_at_blanks(path)
        self.symbols = _byte_symbols()

    def __missing__(self, raw: bytes) -> bytes:
        run = raw.decode()
        if _EASY.fullmatch(run) and "<|" not in run:
            low = run.lower()
            parts = _PARTS.findall(low)
            if len(parts) == 1 and low == run:
                out = packed_ids([t.id for t in self.model.tokenize(run if run.isascii() else run.translate(self.symbols))])
            else:
                # parts are runs by themselves, and mostly known as such
                out = b"".join([self[part.encode()] for part in parts])
        else:
            out = np.array(self.whole.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        self[raw] = out
        return out

    def text(self, text: bytes) -> bytes:
        if not self.short_way:
            return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def tokenizer_cache(path: str) -> _Encoded:
    if path not in _kept:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _kept[path] = _Encoded(path)
    return _kept[path]


def _cutter(path: str, length: int):
    def cut(batches):
        cache = tokenizer_cache(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, piece, start, size, crc = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                raw = cache.text(text or b"") + end
                for k, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at : at + 4 * length]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def tokenised_pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of at most ``length`` ids of each row: doc_id, piece, start, length, ids_crc32. Null counts as empty: one
    piece of the end id alone."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cutter(path, length), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of ``sizes``, placed from the largest down (ties in order)."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    count = np.zeros(length + 1, np.int64)  # open bins by room left; 0: full bins, which don't count
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        # change of the sum when a bin of room r takes the piece: r loses one, r - s gains one
        gain = 2 * (count[: length + 1 - s] - count[s:]) + 2
        gain[0] = 1 - 2 * count[s]  # filled to the brim: nothing gains
        gain[count[s:] == 0] = np.iinfo(np.int64).max
        gain_new = 2 * count[length - s] + 1 if s < length else 0
        k = int(gain.argmin())
        if gain[k] <= gain_new:
            r = k + s
            b = open_bins[r].pop()
            count[r] -= 1
        else:
            r, b = length, made
            made += 1
        bins[i], offsets[i] = b, length - r
        if r > s:
            count[r - s] += 1
            open_bins[r - s].append(b)
    return bins, offsets


def _packer(length: int, final: bool):
    full = length if final else length - length // 16

    def pack(pieces: pa.Table) -> pa.Table:
        sizes = pieces.column("length").to_numpy()
        bins, offsets = sum_of_squares(sizes, length)
        held = np.bincount(bins, weights=sizes, minlength=1)
        for name, values in (("bin", bins), ("offset", offsets), ("done", final | (held[bins] >= full))):
            pieces = pieces.append_column(name, pa.array(values))
        return pieces

    return pack


def pack(pieces: DataFrame, length: int = LENGTH, per_block: int = PIECES_PER_BLOCK) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces get a number of their own and are dealt by it into blocks that are packed side by side. Bins that stay emptier
    than 15/16 are opened again and their pieces packed once more, in far fewer blocks, so blocks cost next to no room. A
    sequence's id is made of the turn, the block (below 2**24) and the bin in it (below 2**31, the rows that Arrow
    holds), so no two share one. An empty table gives no rows; repeated rows are packed each; null ids are kept.
    """
    with scratch() as keep:
        plain = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
        shape = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, block long, bin long, offset long, done boolean"
        left = staged(pieces.withColumn("row", F.monotonically_increasing_id()).select(*plain), "pieces")
        parts = []
        for turn in range(TURNS):
            blocks = max(1, -(-left.count() // per_block))
            final = blocks == 1 or turn == TURNS - 1
            dealt = left.select(*plain, F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(blocks)).alias("block"))
            out = staged(dealt.groupBy("block").applyInArrow(_packer(length, final), shape), "packed")
            number = F.lit(turn).cast("long") * F.lit(1 << 56) + F.col("block") * F.lit(1 << 32) + F.col("bin")
            parts.append(keep(out).where("done").select(*plain[1:], number.alias("sequence_id"), "offset"))
            if final:
                break
            left = out.where("NOT done")
        return reduce(DataFrame.unionAll, parts)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(tokenised_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
