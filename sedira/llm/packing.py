"""Packing documents into sequences of a fixed number of tokens, by non-negative least squares.

Documents become token ids and an end id; longer ones are cut into pieces of `length` tokens. The histogram of piece
lengths (at most `length` numbers) is all that the driver sees. Patterns are the multisets of one to three piece lengths
that fill a sequence exactly; non-negative least squares fits how often each pattern should be used to the histogram, the
counts are rounded down and never above what is left, and the residual is packed by best fit, longest first, whole
counts of a length at a time. Pieces are then numbered within their length, and the number says the sequence and offset.

Cases: null and empty texts are one piece that holds the end id only; repeated rows are packed as often as they occur;
very long texts are cut but never shortened; an empty table gives no rows. Of the input only doc_id and text are read, so no
other column can clash.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedira.llm.common import gapless, lean, read, release, Scratch

LENGTH = 2048
END = 0
#: White space to str.split() but not to the tokenizer, letters whose lower case depends on their place, and what special tokens begin with (fixed values).
_ODD = re.compile(r"[\x1c-\x1f\u03a3\u0130]|<\|")
#: A full stop or comma that ends a chunk after a letter or digit.
_MARK = re.compile(r"(?<=[^\W_])([.,])(?=\s|\Z)")
_PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Chunks whose ids a worker remembers, in each of two generations; a bound of memory, not of what is encoded.
CACHE_CHUNKS = 300_000


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the bytes of the letters 80 to FF: a printable byte as itself, the others from 256 on in order."""
    own = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    other = [b for b in range(256) if b not in own]
    as_char = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}
    return {c: "".join(as_char[b] for b in chr(c).encode()) for c in range(128, 256)}


_BYTES = _byte_letters()
#: The steps of the tokenizers whose texts may be encoded chunk by chunk (fixed values, from such a tokenizer's file).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_ENCODERS: dict[str, Encoder] = {}


def by_chunks(tokenizer_json: dict) -> bool:
    """Whether what `Encoder` takes for granted is true of a tokenizer: its own steps say so."""
    model = tokenizer_json["model"]
    return (
        tokenizer_json["normalizer"] == _NORMALIZER
        and tokenizer_json["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _LEVEL]}
        and model["type"] == "BPE"
        and not model["dropout"]
        and not model["continuing_subword_prefix"]
        and not model.get("ignore_merges")
        and all(t["content"].startswith("<|") for t in tokenizer_json["added_tokens"])
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Chunks(dict):
    """Ids of a chunk, found when first asked for; two generations bound the memory."""

    def __init__(self, tokenizer):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if _PLAIN.fullmatch(chunk):  # normal form, lower case, one piece: only the merges are left to do
                ids = array("I", [t.id for t in self.model.tokenize(chunk.translate(_BYTES))]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    A tokenizer that folds case, drops white space and lets no token cross it, nor one go from a letter or digit to a
    following full stop or comma, gives a text the ids of its chunks between such places, which are looked up in a cache.
    Texts on whose chunks the two notions of white space, case or special tokens could differ, or that are not in normal
    form (a letter may become a letter and a mark), are encoded whole; so is every text if the tokenizer's steps are others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_chunks = by_chunks(json.load(f))
        self.chunks = _Chunks(self.tokenizer)

    def encode(self, text: str) -> bytes:
        if not self.by_chunks or _ODD.search(text) or not unicodedata.is_normalized("NFC", text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.chunks) > CACHE_CHUNKS:
            old = self.chunks
            self.chunks = _Chunks(self.tokenizer)
            self.chunks.old = dict(old)
        return b"".join(map(self.chunks.__getitem__, _MARK.sub(r" \1", text.lower()).split()))


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and its token ids as bytes if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail, step = _encoder(tokenizer), np.array([end], "<u4").tobytes(), 4 * length
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encoder.encode(text or "") + tail
                    for k, o in enumerate(range(0, len(ids), step)):
                        p = ids[o : o + step]
                        rows.append((doc, k, o // 4, len(p) // 4, zlib.crc32(p), p if with_ids else None))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        encoder.chunks.old.clear()  # the worker lives on, perhaps for other work
        release()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# ---- the fit, over a histogram of at most `length` numbers ----------------------------------------------------------


def patterns(present: np.ndarray, length: int, slack: int = 0) -> np.ndarray:
    """Multisets of one, two or three of the present lengths that add up to `length`, or to at most `slack` less, as rows padded with 0; ascending."""
    present = np.sort(present)
    out = [np.stack([np.zeros((n := present[present >= length - slack]).size, np.int64)] * 2 + [n], 1)]

    def with_third(x: int, rows: np.ndarray) -> np.ndarray:
        """(x, b, c) with b of `rows`, c at least b, and the sum within the slack."""
        lo = np.maximum(np.searchsorted(present, length - slack - x - rows, "left"), np.searchsorted(present, rows, "left"))
        n = np.maximum(np.searchsorted(present, length - x - rows, "right") - lo, 0)
        c = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.stack([np.full(len(c), x), np.repeat(rows, n), present[c]], 1)

    out.append(with_third(0, present[present <= length // 2]))
    for x in present[present <= length // 3]:
        out.append(with_third(int(x), present[(present >= x) & (present <= (length - x) // 2)]))
    return np.concatenate(out)


def fit(counts: np.ndarray, pats: np.ndarray, rounds: int = 800) -> np.ndarray:
    """Non-negative least squares, min |W (A x - counts)| with column p of A holding pattern p, by multiplicative updates on the sparse A. W weighs lengths by their size: a long piece that is left over costs a sequence, short ones fill gaps."""
    size = len(counts)
    weight = (np.arange(size) / size) ** 2

    def through(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(pats[:, k], x, size) for k in range(3)) * weight

    back = lambda y: y[pats[:, 0]] + y[pats[:, 1]] + y[pats[:, 2]]
    target = counts * weight
    want = back(target)
    x = np.full(len(pats), counts[1:].sum() / max(1, 3 * len(pats)))
    before = np.inf
    for k in range(rounds):
        y = through(x)
        if k % 50 == 49:
            now = float((np.square(y - target) / np.maximum(weight, 1e-9)).sum())
            if now > before * 0.99:
                break
            before = now
        x *= want / np.maximum(back(y), 1e-12)
    return x


#: Patterns that are fitted at most: the slack is the widest of 0, 1, 2, 4, ... that stays within.
PATTERNS = 400_000


def strategy(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths in a sequence): a packing of the whole histogram. Patterns with a piece of over half a sequence, which must have one to itself, are used first."""
    left = np.zeros(length + 1, np.int64)
    for k, n in histogram.items():
        left[k] = n
    plan: list[tuple[int, tuple[int, ...]]] = []
    pats = patterns(np.flatnonzero(left), length)
    for slack in (1, 2, 4, 8, 16, 32):
        if len(pats) * 3 > PATTERNS:
            break
        pats = patterns(np.flatnonzero(left), length, slack)
    if len(pats):
        x = np.floor(fit(left, pats) + 1e-6).astype(np.int64)
        used = np.flatnonzero(x)
        for p in used[np.lexsort((-x[used], pats[used, 2] <= length // 2))]:
            parts, need = np.unique(pats[p][pats[p] > 0], return_counts=True)
            if n := int(min(x[p], (left[parts] // need).min())):
                left[parts] -= n * need
                plan.append((n, tuple(int(v) for v in np.repeat(parts, need))))
    return plan + _best_fit(left, length)


def _best_fit(left: np.ndarray, length: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first, on what is left: open sequences are kept by room, as counts of equal contents; pieces of one length go to the least room that holds them, as many at once as there are such sequences."""
    import bisect

    rooms: list[int] = []
    open_: dict[int, list[list]] = {}

    def put(n: int, inside: tuple[int, ...], room: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append([n, inside])

    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        while n:
            k = bisect.bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                group = open_[room][-1]
                take = min(n, group[0])
                group[0] -= take
                inside = group[1]
                if not group[0]:
                    open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[k]
            else:
                per = min(n, length // size)
                take, inside, room = n // per, (size,) * (per - 1), length - size * (per - 1)
                put(take, inside + (size,), room - size)
                n -= take * per
                continue
            put(take, inside + (size,), room - size)
            n -= take
    return [(g[0], g[1]) for groups in open_.values() for g in groups]


def _slots(plan: list[tuple[int, tuple[int, ...]]], length: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first number, last number, first sequence, places in each sequence, offset of the first place, length): which numbers of a length go where. A few rows a pattern."""
    next_, seq, out = np.zeros(length + 1, np.int64), 0, []
    for n, inside in plan:
        offset = 0
        for size, per in zip(*np.unique(inside, return_counts=True)):
            first = int(next_[size])
            next_[size] += n * per
            out.append((int(size), first, first + int(n * per) - 1, seq, int(per), offset))
            offset += int(size * per)
        seq += n
    return out


def pack(cut: DataFrame, scratch: Scratch, length: int = LENGTH, rows_per_task: int = 1 << 17) -> DataFrame:
    """`cut` (a written table of pieces with `length`) with sequence_id and offset.

    A length can hold any share of all pieces, so the pieces of a length are numbered in hashed buckets of some
    rows_per_task rows. The table of slots has some rows a pattern, whose number depends on `length` alone; it is looked
    up by a binary search.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `length` rows
    slots = _slots(strategy(histogram, length), length)
    n = sum(histogram.values())
    buckets = max(8, n // rows_per_task)
    numbered = gapless(cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))), ["length"], "_bucket", ["doc_id", "piece"], "_k").drop("_bucket")
    if not slots:
        return numbered.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("_k")
    table = np.array(sorted(slots), np.int64)
    base = int(max(n, 1)) + 1
    table[:, 1:3] += table[:, :1] * base  # one sorted key: length, then number
    shared = spark.sparkContext.broadcast(table)

    names = [c for c in numbered.columns if c != "_k"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            s, k = b.column("length").to_numpy(), b.column("_k").to_numpy()
            row = t[np.searchsorted(t[:, 1], s * base + k, "right") - 1]
            at = s * base + k - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(row[:, 3] + at // row[:, 4]), pa.array(row[:, 5] + at % row[:, 4] * s)], [*names, "sequence_id", "offset"])

    kind = T.StructType([*(numbered.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(lean(place), kind)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, scratch: Scratch | None = None, with_ids: bool = False) -> DataFrame:
    """Documents to packed pieces; with_ids keeps each piece's token ids (bytes of 32-bit numbers) for a writer of sequences."""
    scratch = scratch or Scratch(docs.sparkSession)
    return pack(scratch.keep(pieces(docs, tokenizer, length, end, with_ids), "pieces"), scratch, length)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents", spread=True), default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
