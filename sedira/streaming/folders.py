"""Drop folders: files that arrive are identified and digested as a stream (an extension; byte streams elsewhere are finite)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedira.functions.digest import digest
from sedira.operators.signatures import CATALOG


def arrivals(spark: SparkSession, folder: str, kind: str = "md5", pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, digest and formats (an array of all whose signature is there) of each file, as a stream. Files over the binary source's limit belong in blob_chunks."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(folder)
    hits = []
    for _, name, bound, offset, pattern_ in CATALOG:
        raw, n = F.unhex(F.lit(pattern_)), len(pattern_) // 2
        at = F.substring("content", offset + 1, n) if bound == "start" else F.expr(f"substring(content, octet_length(content) - {offset - 1}, {n})")
        hits.append(F.when((at == raw) & (F.col("length") >= offset + (n if bound == "start" else 0)), name))
    return files.select("path", "modificationTime", "length", digest(F.col("content"), kind).alias("digest"), F.array_distinct(F.array_compact(F.array(*hits))).alias("formats"))


def first_seen(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One row a digest within the watermark: copies that arrive later are dropped, and state older than it is forgotten."""
    return stream.withWatermark("modificationTime", lateness).dropDuplicatesWithinWatermark(["digest"])


def formats_by_window(stream: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """window, format, files, bytes."""
    rows = stream.withWatermark("modificationTime", lateness).withColumn("format", F.explode_outer("formats"))
    return rows.groupBy(F.window("modificationTime", window), "format").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
