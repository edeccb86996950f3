"""Reports: what info commands print, as relations. Flags are decoded by small tables of bits, in the JVM. A path may also be images made of rows (sources.datasources.Made)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedira.functions.text import bytesize
from sedira.sources.datasources import Made
from sedira.sources.volumes import APM_FLAGS

#: Bits of NTFS volume flags and of DOS and NTFS file attributes.
NTFS_VOLUME_FLAGS = {0x1: "is dirty", 0x2: "resize log file", 0x4: "upgrade on next mount", 0x8: "mounted on NT4", 0x10: "deleting change journal", 0x20: "repair object identifiers", 0x8000: "modified by chkdsk"}
FILE_ATTRIBUTES = {
    0x1: "read-only", 0x2: "hidden", 0x4: "system", 0x10: "directory", 0x20: "archive", 0x40: "device", 0x80: "normal", 0x100: "temporary", 0x200: "sparse",
    0x400: "reparse point", 0x800: "compressed", 0x1000: "offline", 0x2000: "not content indexed", 0x4000: "encrypted", 0x10000: "virtual",
}


def flag_names(value: Column, names: dict[int, str]) -> Column:
    return F.array_compact(F.array(*(F.when(value.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in names.items())))


def _read(spark: SparkSession, kind: str, path: str | Made, **o: str) -> DataFrame:
    if isinstance(path, Made):
        return path.load(kind, **o)
    return spark.read.format(kind).options(path=path, **o).load()


def volume_report(spark: SparkSession, path: str | Made, **o: str) -> DataFrame:
    """APM, GPT and MBR: a row a partition."""
    v = _read(spark, "volumes", path, **o)
    flags = F.when(F.col("scheme") == "apm", flag_names(F.col("flags"), APM_FLAGS)).when((F.col("scheme") == "mbr") & (F.col("flags") == 0x80), F.array(F.lit("is active"))).otherwise(F.array().cast("array<string>"))
    return v.select("path", "scheme", "disk_identifier", "bytes_per_sector", "idx", "type_id", "uuid", "name", "offset", "size", bytesize(F.col("size")).alias("size_text"), flags.alias("flags"))


def image_report(spark: SparkSession, path: str | Made) -> DataFrame:
    """EWF, QCOW, VHD, VHDX, UDIF and sparse images: a row a value of the headers, and stored digests."""
    i = _read(spark, "image_info", path)
    base = F.map_from_arrays(F.array(F.lit("format"), F.lit("media_size"), F.lit("layers")), F.array(F.col("format"), F.col("media_size").cast("string"), F.col("layers").cast("string")))
    stored = F.transform_keys("stored", lambda k, v: F.concat(F.lit("stored_"), k))
    return i.where("_error is null").select("path", F.explode(F.map_concat(base, F.map_filter("info", lambda k, v: ~k.isin("media_size")), stored)).alias("key", "value"))


def file_system_report(spark: SparkSession, path: str | Made) -> DataFrame:
    """ext, FAT and NTFS: a row a value of the volume."""
    return _read(spark, "file_systems", path).where("_error is null").select("path", "volume", "format", F.explode("info").alias("key", "value"))


def entry_report(spark: SparkSession, path: str | Made, identifier: str | None = None, display_path: str | None = None, **o: str) -> DataFrame:
    """One entry, by identifier (of which the reader makes no walk, so that there is no path) or path; the filter becomes a lookup in the reader."""
    e = _read(spark, "file_entries", path, **(o if identifier is None else o | {"identifier": identifier}))
    if display_path is not None:
        e = e.where(F.col("display_path") == display_path)
    return e.withColumn("attribute_names", flag_names(F.col("attributes"), FILE_ATTRIBUTES))


def attribute_report(spark: SparkSession, path: str | Made, identifier: str | None = None, **o: str) -> DataFrame:
    """NTFS and ext: a row an attribute of an entry (or of all), with its value or where it lies; ext: a row for the blocks as well."""
    a = _read(spark, "attributes", path, **o)
    return a if identifier is None else a.where(F.col("identifier") == F.regexp_extract(F.lit(identifier), "^[0-9]+", 0))


def hierarchy_report(spark: SparkSession, path: str | Made, **o: str) -> DataFrame:
    """path, volume and display_path of all entries, in the order of a walk by (volume, postorder)."""
    return _read(spark, "file_entries", path, **o).select("path", "volume", "display_path", "file_type", "postorder")


def verify_report(spark: SparkSession, path: str | Made) -> DataFrame:
    """path, kind, stored, computed and verified of the digests that images carry."""
    from sedira.operators.relations import made_digests, stream_digests

    stored = _read(spark, "image_info", path).where("_error is null").select("path", F.explode("stored").alias("kind", "stored"))
    kinds = ("md5", "sha1")
    computed = made_digests(path, "image_chunks", kinds) if isinstance(path, Made) else stream_digests(_read(spark, "image_chunks", path), kinds, "path")
    both = stored.join(computed, "path").withColumn("computed", F.when(F.col("kind") == "md5", F.col("md5")).otherwise(F.col("sha1")))
    return both.select("path", "kind", "stored", "computed", (F.col("stored") == F.col("computed")).alias("verified"))
