"""Shared pieces of the corpus operators: scratch tables, hashing of words, grouping of Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage (a fixed value): space and the control characters 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the vectorised functions take at a time, which bounds their temporary arrays to some 50 MB.
SLICE_BYTES = 1 << 18


#: Rows and bytes of an Arrow batch at most: texts and sets can be long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS, BATCH_BYTES = 1500, 8 << 20


def _bound_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str, spread: bool = False) -> DataFrame:
    """A table; `spread` deals rows out if the files give fewer partitions than there are cores (one small file), for work that Python does."""
    _bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if spread and df.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        df = df.repartition(cores)
    return df


def _shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; without one, a new folder of this machine if everything runs on it (local tests)."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sedira-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is scratch space
        pass


class Scratch:
    """Tables written once to the shared folder, which cuts lineage: a lost executor costs a re-read, not a recomputation."""

    def __init__(self, spark: SparkSession):
        _bound_batches(spark)
        self.spark, self.base = spark, f"{_shared_dir(spark)}/sedira-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.base)

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table that nothing lazily evaluated reads any more."""
        _delete(self.spark, f"{self.base}/{name}")


def parts(spark: SparkSession, rows: int = 0, per: int = 1) -> int:
    """Shuffle partitions: the session's number, or more if a partition would get over `per` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(rows / per) if rows else 0)


def fetch(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table that the caller knows to be bounded, by Arrow."""
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def most_frequent(table: DataFrame, count: str, most: int) -> dict[str, np.ndarray]:
    """At most `most` rows of a written table (all of them, if there are no more), those with the largest counts. A histogram of the counts, in steps of 1/16 of a power of two, says where to cut, so nothing is sorted globally; if more rows than `most` share the topmost step, a hash says which are taken."""
    step = F.floor(F.log2(F.col(count)) * 16)
    sizes = sorted(((r["s"], r["n"]) for r in table.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # 1024 rows at most
    total, cut = 0, None
    for s, n in sizes:
        if total + n > most:
            break
        total, cut = total + n, s
    if cut is None and sizes:
        share = F.pmod(F.xxhash64(*table.columns), F.lit(1 << 40)) < int((1 << 40) * 0.9 * most / sizes[0][1])
        return fetch(table.where((step == sizes[0][0]) & share).limit(most))
    return fetch(table.where(step >= cut) if cut is not None else table.limit(0))


def packed_lists(keys: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The runs of equal sorted keys, once each, and of each column the bytes of every run."""
    at = bounds(keys)
    own = keys[at[:-1]] if len(keys) else keys
    out = [pa.array(own)]
    for c in columns:
        offsets = (c.dtype.itemsize * at).astype(np.int32).tobytes()
        out.append(pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(c).tobytes())]) if len(own) else pa.array([], pa.binary()))
    return out


def doc_crc(column: str = "doc_id"):
    """crc32 of the id as text, an expression."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# ---- words as 64-bit hashes, without a Python object per word -------------------------------------------------

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER_BYTE = _BYTE[_LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + (64 << 10))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of text, one row at least; whole texts stay whole."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and at which word each document starts (one more entry than documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z in lower case, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER_BYTE[data] * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each document (a shorter document's whole sequence counts as one run), and where each document's runs start."""
    n = np.diff(at)
    runs = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    to = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(to[-1], np.uint64)
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : len(words) - k + 1 + j]
        doc = np.repeat(np.arange(len(n)), runs)
        position = at[:-1][doc] + np.arange(to[-1]) - to[:-1][doc]
        out = mix(h)[np.minimum(position, len(h) - 1)]
    for d in np.flatnonzero((n > 0) & (n < k)):
        h = np.uint64(n[d])
        with np.errstate(over="ignore"):
            for w in words[at[d] : at[d + 1]]:
                h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w
        out[to[d]] = mix(np.array([h], np.uint64))[0]
    return out, to


def release() -> None:
    """Gives free memory back to the machine: a worker lives on after its task, and its executor's limit counts it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """A function over Arrow batches that releases what it held when it is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def gathered(parts: Iterator[np.ndarray], at_least: int = 1 << 20) -> Iterator[np.ndarray]:
    """Arrays put together until they hold so many numbers: what is combined before an exchange, in bounded memory."""
    held: list[np.ndarray] = []
    size = 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size >= at_least:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


# ---- rows of a key together, on partitions that are sorted by the key ------------------------------------------


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_least: int = 4096) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a sorted key, many small groups at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        last = batch.column(key)[-1]
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_pylist() if not pa.types.is_integer(table.schema.field(key).type) else table.column(key).to_numpy()
        cut = rows
        lastv = last.as_py()
        while cut and keys[cut - 1] == lastv:
            cut -= 1
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows -= cut
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal sorted keys start, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def below(h: np.ndarray, i: np.ndarray, ph: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """For each key (h, i), how many of the sorted keys (ph, pi) are at or below it."""
    lo, hi = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out = hi.copy()
    for k in np.unique(lo[lo < hi]):
        rows = np.flatnonzero((lo == k) & (hi > k))
        out[rows] = k + np.searchsorted(pi[k : hi[rows[0]]], i[rows], "right")
    return out


def gapless(df: DataFrame, group: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps. Only the rows of one (group, bucket) meet in a task: the rows are counted by bucket, and a running sum over those counts says where each bucket starts. The caller chooses buckets small enough."""
    from pyspark.sql import Window

    starts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*group, bucket, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_from"))
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(within)).join(starts, [*group, bucket]).withColumn(name, (F.col("_from") + F.col("_row") - 1).cast("long")).drop("_from", "_row")


#: Repeated documents (two numbers each) that are broadcast at most.
REPEATED = 1 << 18


def copy_numbers(docs: DataFrame, scratch: Scratch, name: str, by: list[str]) -> DataFrame:
    """`docs` with `name`: the row's number (from 0, without gaps) among the rows that are equal in doc_id, text and the other columns of `by`. Only doc_ids are counted at first; where none occurs twice, that is all. Repeated rows are written and numbered by the partitions they came in, so one row that makes up much of a table is not gathered in a task."""
    twice = scratch.keep(docs.groupBy(F.col("doc_id").alias("_twice")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_twice"), f"{name}-ids")
    if twice.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long"))
    key = F.xxhash64(*(x for c in by for x in (F.col(c).isNull(), F.col(c))))
    found = docs.select("doc_id", key.alias("_key")).join(_checked(twice), F.col("doc_id").eqNullSafe(F.col("_twice")), "left_semi")
    found = scratch.keep(found.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), f"{name}-keys")
    if found.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long"))
    keyed, found = docs.withColumn("_key", key), _checked(found)
    copies = scratch.keep(keyed.join(found, "_key", "left_semi").withColumn("_bucket", F.spark_partition_id()), f"{name}-rows")
    numbered = gapless(copies, ["_key"], "_bucket", [F.lit(0)], name)
    return keyed.join(found, "_key", "left_anti").withColumn(name, F.lit(0).cast("long")).drop("_key").unionByName(numbered.drop("_key", "_bucket"))


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= REPEATED else df


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", mixed: Callable = lambda c: F.xxhash64(c, F.lit(7))) -> DataFrame:
    """Connected components of the undirected `edges` (a long, b long): (node, label), label equal for the nodes of a component and itself a node. Every node is merged into its least neighbour (in the order of a hash, so that chains are broken up), and the graph so contracted is taken again until no edge is left; each round is written to the shared folder. Nothing is gathered in the driver but a count."""
    rank = lambda c: F.struct(mixed(c).alias("r"), F.col(c).alias("id"))
    edges = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), f"{name}-e0")
    labels = None
    for k in range(100):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        into = scratch.keep(least.select("node", F.when(F.col("m.r") < mixed("node"), F.col("m.id")).otherwise(F.col("node")).alias("into")), f"{name}-m{k}")
        a, b = (into.select(F.col("node").alias(x), F.col("into").alias(f"{x}2")) for x in "ab")
        edges_next = edges.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct()
        edges = scratch.keep(edges_next, f"{name}-e{k + 1}")
        step = into.select(F.col("node").alias("label"), "into")
        labels = into.select("node", F.col("into").alias("label")) if labels is None else labels.join(step, "label", "left").select("node", F.coalesce("into", "label").alias("label"))
        labels = scratch.keep(labels, f"{name}-l{k}")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
