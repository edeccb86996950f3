"""Sharding by histogram sort.

Documents are ordered by (hash of the text, hash of the id and of the row's number among rows equal in both), so that equal
texts are neighbours and a group of copies of any size, also of one repeated row, can still be cut. Probes for every boundary are counted exactly: each partition adds up the bytes between
neighbouring probes, the sums of all partitions meet in the driver (a few hundred numbers a boundary), and the interval
that holds a boundary is probed again until the count below the chosen probe is within tolerance. Where the tolerance
allows it, a boundary is put between two groups of equal texts. Then the rows are exchanged once.

Cases: a null text is empty (0 bytes, crc32 0), and a group with the empty texts; repeated rows may be parted, like other
equal texts, where a boundary needs it; a table of one document, or of none, leaves shards empty; `shard` keeps the
input's columns in a struct, so that no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedira.llm.common import below, copy_numbers, fetch, lean, parts, read, Scratch

SHARDS = 24
OVERHEAD = 8
#: Of a shard's even part, which a boundary may be off.
TOLERANCE = 0.005
PROBES = 64
_TOP = (1 << 64) - 1
Key = tuple[int, int]


def keyed(docs: DataFrame) -> DataFrame:
    """doc, shard_size, shard_crc and the key (shard_h, shard_i) of each row of doc, doc_id, text, shard_nth."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("shard_size"),
        F.crc32(F.encode(text, "UTF-8")).alias("shard_crc"),
        F.xxhash64(text).alias("shard_h"),
        F.xxhash64(F.lit(5), F.col("doc_id"), F.col("shard_nth")).alias("shard_i"),
    )


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _histogram(rows: DataFrame, probes: list[Key]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows between neighbouring probes; len(probes) + 1 numbers each."""
    ph, pi = (np.array([p[k] for p in probes], np.uint64) for k in (0, 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(ph) + 1), np.int64)
        for b in batches:
            at = below(_unsigned(b, "shard_h"), _unsigned(b, "shard_i"), ph, pi)
            size = b.column("shard_size").to_numpy()
            np.add.at(total[0], at, size)
            total[1] += np.bincount(at, minlength=len(ph) + 1)
        full = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[0][full]), pa.array(total[1][full])], ["bin", "bytes", "n"])

    out = np.zeros((2, len(ph) + 1), np.int64)
    found = rows.select("shard_h", "shard_i", "shard_size").mapInArrow(lean(count), "bin long, bytes long, n long")
    for r in found.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect():  # a row a bin
        out[:, r["bin"]] = r["bytes"], r["n"]
    return out[0], out[1]


def _between(lo: Key, hi: Key, n: int) -> list[Key]:
    """Evenly spaced keys in (lo, hi): of the text's hash, or of the id's hash within one text."""
    a, b = (lo[0] << 64) + lo[1], (hi[0] << 64) + hi[1]
    keys = {a + (b - a) * k // (n + 1) for k in range(1, n + 1)}
    wide = hi[0] - lo[0] > 1
    return sorted({((k >> 64) + (1 if k & _TOP else 0), 0) if wide else (k >> 64, k & _TOP) for k in keys if a < k < b})


def _from_sample(rows: DataFrame, shards: int, most: int = 4096) -> list[Key]:
    """The first probes: the keys of `most` rows with the least hash of the id, and within a text that makes up much of them, evenly spaced hashes of ids. Counts are exact whatever is probed; good probes save turns."""
    found = fetch(rows.select("shard_h").orderBy("shard_i").limit(max(most, 64 * shards)))["shard_h"].astype(np.int64)
    h, n = np.unique(found.view(np.uint64) ^ np.uint64(1 << 63), return_counts=True)
    out = {(int(x), 0) for x in h}
    for x, k in zip(h.tolist(), n.tolist()):
        if k * shards * 8 > len(found):
            out |= {(x, _TOP * j // (4 * k)) for j in range(4 * k)} | {(x + 1, 0)}
    return sorted(k for k in out if k[0] <= _TOP) or [(1 << 63, 0)]


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[Key]:
    """shards - 1 keys; what is at or above the k-th, and below the next, is shard k."""
    if shards < 2:
        return []
    lo: list[Key] = [(0, 0)] * (shards - 1)
    hi: list[Key] = [(1 << 64, 0)] * (shards - 1)
    best: list[tuple[float, Key]] = [(float("inf"), (_TOP, _TOP))] * (shards - 1)
    first = _from_sample(rows, shards)
    turn = 0
    while True:  # each turn divides the intervals by the number of probes, until all are within tolerance or no key is left between
        ask = first if not turn else sorted({p for k in range(shards - 1) if best[k][0] > slack for p in _between(lo[k], hi[k], probes)})
        ask = [p for p in ask if p[0] <= _TOP]
        turn += 1
        if not ask:
            break
        size, _ = _histogram(rows, ask)
        total = int(size.sum())
        slack = tolerance * total / shards
        below = np.cumsum(size)[:-1]
        for k in range(shards - 1):
            want = total * (k + 1) / shards
            near = int(np.argmin(np.abs(below - want)))
            # of the probes within tolerance, one between two texts is preferred
            ok = [j for j in np.flatnonzero(np.abs(below - want) <= slack) if ask[j][1] == 0]
            near = ok[0] if ok else near
            if (off := abs(below[near] - want)) < best[k][0]:
                best[k] = (off, ask[near])
            under, over = np.flatnonzero(below <= want), np.flatnonzero(below > want)
            if len(under):
                lo[k] = max(lo[k], ask[under[-1]])
            if len(over):
                hi[k] = min(hi[k], ask[over[0]])
        if not total or all(b[0] <= slack for b in best):
            break
    return sorted(b[1] for b in best)


def assign(rows: DataFrame, cuts: list[Key], name: str = "shard") -> DataFrame:
    """The number of cuts at or below each row's key: one comparison of longs a cut, in the JVM."""
    signed = lambda x: x - (1 << 63)
    h, i = F.col("shard_h"), F.col("shard_i")
    at = F.lit(0)
    for a, b in cuts:
        at = at + (F.when(h > F.lit(signed(a)), 1).when((h == F.lit(signed(a))) & (i >= F.lit(signed(b))), 1).otherwise(0))
    return rows.withColumn(name, at.cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, rows_per_task: int = 1 << 18, scratch: Scratch | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc (struct of the input's columns, or of those of `carry`), shard_size, shard_crc, shard (int) and slot (long, gapless from 0 within the shard, in the order of the key)."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = keyed(copy_numbers(docs.select(F.struct(*(carry or ["*"])).alias("doc"), "doc_id", "text"), scratch, "shard_nth", ["doc_id", "text"]))
    slim = scratch.keep(rows.select("shard_h", "shard_i", "shard_size"), "keys")
    cuts = splitters(slim, shards, tolerance)
    n = slim.count()
    per = max(1, -(-n // (shards * rows_per_task)))  # finer ranges of a shard, so that no task sorts more than about rows_per_task rows
    fine = splitters(slim, shards * per, 0.25) if per > 1 else []
    placed = assign(rows, cuts)
    placed = placed.withColumn("shard_part", _finer(fine) if fine else F.lit(0))
    placed = placed.repartition(max(parts(docs.sparkSession), shards * per), "shard", "shard_part")
    order = Window.partitionBy("shard", "shard_part").orderBy("shard_h", "shard_i")
    sums = assign(slim, cuts).withColumn("shard_part", _finer(fine) if fine else F.lit(0)).groupBy("shard", "shard_part").count()
    before = Window.partitionBy("shard").orderBy("shard_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "shard_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shard_from"))
    out = placed.withColumn("slot", F.row_number().over(order) - 1).join(sums, ["shard", "shard_part"]).withColumn("slot", (F.col("slot") + F.col("shard_from")).cast("long"))
    return out.drop("shard_part", "shard_from", "shard_h", "shard_i")


def _finer(cuts: list[Key]):
    """The range of a row among many cuts, by Arrow and a binary search."""

    @F.pandas_udf("int")
    def at(h, i):
        import pandas as pd

        ph, pi = (np.array([c[k] for c in cuts], np.uint64) for k in (0, 1))
        flip = lambda x: x.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        return pd.Series(below(flip(h), flip(i), ph, pi).astype(np.int32))

    return at("shard_h", "shard_i")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark)
    out = shard(docs, scratch=scratch, carry=["doc_id"])
    return out.select("doc.doc_id", F.col("shard_size").alias("size"), F.col("shard_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
