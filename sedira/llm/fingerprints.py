"""Document fingerprints by winnowing.

Every run of k code points is hashed; of each window of w consecutive hashes the least is kept, the rightmost among equal
ones, with its position. Two texts that share any passage of w + k - 1 code points therefore share a kept hash, whatever
stands around the passage.

A fingerprint is text: for every kept hash 8 hexadecimal digits of the hash and 8 of its position, in the order of the
text. Likeness is the Jaccard similarity of the sets of hashes (1 for two empty ones).

Cases: null is empty; a text of fewer than k code points has one hash, of all of it, and an empty one none; texts of any
length are taken whole; equal texts have equal fingerprints; `fingerprints` keeps the input's columns in a struct. For
`with_next`: rows are ordered by doc_id, null last, and equal ids by a hash of the text, then by the text; one document
alone is its own next; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedira.llm.common import below, lean, mix, parts, read, Scratch

K, W = 16, 64
#: Ranges of doc_id whose first ids are broadcast at most; rows of a range on average.
BROADCAST, ROWS = 1 << 20, 4096
_LOW = np.uint64(0xFFFFFFFF)
_MUL = 0x9E3779B97F4A7C15


def _grams(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k code points, by joining runs of half the length."""
    h = mix(points.astype(np.uint64) + np.uint64(1))
    have, power, out, done = 1, _MUL, None, 0
    while True:
        if k & have:
            if out is None:
                out, done = h, have
            else:
                n = len(points) - done - have + 1
                out = out[:n] * np.uint64(power) + h[done : done + n]
                done += have
        if have * 2 > k:
            break
        n = len(h) - have
        h = h[:n] * np.uint64(power) + h[have : have + n]
        have, power = have * 2, power * power % (1 << 64)
    return mix(out)


def winnow(points: np.ndarray, k: int = K, w: int = W, at: int = 0) -> np.ndarray:
    """Kept hashes as sorted 64-bit numbers: the hash's 32 bits, then 2**32 - 1 - position, so that the least of a window is the least hash, rightmost. `at` is the position of the first code point."""
    if not len(points):
        return np.zeros(0, np.uint64)
    if len(points) < k:
        k = len(points)
    h = _grams(points, k)
    c = (h & ~_LOW) | (_LOW - np.arange(at, at + len(h), dtype=np.uint64))
    have = 1
    w = min(w, len(c))
    while have * 2 <= w:
        c = np.minimum(c[:-have], c[have:])
        have *= 2
    if have < w:
        c = np.minimum(c[: len(c) - (w - have)], c[w - have :])
    return np.unique(c[np.concatenate([[True], c[1:] != c[:-1]])])


def written(kept: np.ndarray) -> str:
    position = (_LOW - (kept & _LOW)).astype(np.uint64)
    order = np.argsort(position, kind="stable")
    return ((kept >> np.uint64(32) << np.uint64(32)) | position)[order].astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a >> np.uint64(32)), np.unique(b >> np.uint64(32))
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc (struct of the input's columns) and fingerprint: no exchange, one pass."""

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: written(winnow(_points(t or ""), k, w)), na_action=None)

    return docs.select(F.struct("*").alias("doc"), of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("fingerprint"))


def _cuts(docs: DataFrame) -> list[tuple[float, float]]:
    """Starts of ranges after the first, by doc_id (null: infinity) and, where an id or null has many rows, by the hash of the text as a number from 0 to 1."""
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
    n = max(parts(docs.sparkSession), -(-total["n"] // ROWS))
    at = docs.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 and total["ids"] else []
    ids, times = np.unique(np.array(at, float), return_counts=True)
    cuts = [(float(i), j / int(m)) for i, m in zip(ids, times) for j in range(m)]
    nulls = total["n"] - total["ids"]
    ways = max(1, math.ceil(nulls * n / max(1, total["n"])))
    return cuts + [(math.inf, j / ways) for j in range(ways) if nulls]


def with_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are exchanged once, to ranges of doc_id cut at approximate quantiles, each a partition of its own; the document
    that follows a range is sent there as well, which is one more row a range.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = _cuts(docs)
    many = any(b > 0 for _, b in cuts)  # else ids alone say where a range starts, and no text is read for that
    docs = docs.withColumn("frac", F.pmod(F.xxhash64("text"), F.lit(1 << 52)) / float(1 << 52))
    start = F.col("frac") if many else F.lit(0.0)
    first_keys, second_keys = (np.array([c[j] for c in cuts]) for j in (0, 1))

    @F.pandas_udf("int")
    def range_of(ids, frac):
        import pandas as pd

        a = np.where(ids.isna(), math.inf, ids.fillna(0).to_numpy(float))
        return pd.Series(below(a, frac.to_numpy(), first_keys, second_keys).astype(np.int32))

    rows = docs.withColumn("part", range_of("doc_id", start))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", start.alias("frac"))
    first = docs.select(key.alias("key"), range_of("doc_id", start).alias("part")).groupBy("part").agg(F.min("key").alias("key"))
    circle = Window.orderBy("part")  # one row a range
    whole = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select(F.col("part").alias("own"), F.col("key.doc_id").alias("first_id"), F.col("key.frac").alias("first_frac"), F.coalesce(F.lag("part").over(circle), F.max("part").over(whole)).alias("part"))
    first = scratch.keep(first, "first")
    first = F.broadcast(first) if first.count() <= BROADCAST else first  # a few numbers a range
    same = docs["doc_id"].eqNullSafe(first["first_id"])
    same = same & (docs["frac"] == first["first_frac"]) if many else same
    heads = docs.join(first, same).groupBy(first["part"], docs["doc_id"]).agg(F.min(F.struct("frac", "text")).alias("head")).select("part", "doc_id", "head.*")
    fed = rows.select("part", F.lit(0).alias("follows"), "doc_id", "frac", "text").unionByName(heads.select("part", F.lit(1).alias("follows"), "doc_id", "frac", "text"))
    fed = fed.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "follows", F.col("doc_id").asc_nulls_last(), "frac", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None
        for batch in batches:
            out = []
            for part, follows, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "follows", "doc_id", "text"))):
                text = text or ""
                points = _points(text)
                kept = winnow(points, k, w)
                if before is not None and before[0] == part:
                    out.append(_edited(before[1:], text, points, kept, k, w))
                before = (part, doc, text, points, kept)
                if follows:
                    before = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return fed.mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _edited(own: tuple, next_text: str, next_points: np.ndarray, next_kept: np.ndarray, k: int, w: int) -> tuple:
    doc, text, points, kept = own
    n = len(points)
    m = n // 4
    text = text[: n - m] + next_text[:m]
    edited = np.concatenate([points[: n - m], next_points[:m]])
    tail = max(0, n - m - (w + k - 2))  # windows that end before the edit keep what they kept
    if tail and len(edited) - tail >= w + k - 1:
        same = points[: tail + w + k - 2]
        kept_edited = np.unique(np.concatenate([winnow(same, k, w), winnow(edited[tail:], k, w, tail)]))
    else:
        kept_edited = winnow(edited, k, w)
    return doc, n, hashlib.sha256(text.encode()).hexdigest(), written(kept), written(kept_edited), likeness(kept, kept_edited), likeness(kept, next_kept)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(read(spark, sf_dir, "documents"))
