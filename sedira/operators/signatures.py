"""Format identification by byte signatures: a small dimension held against blobs, in generated code. Positions are bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "identifier string, format string, bound string, offset int, pattern binary"
#: Signatures of a catalog at most.
MOST = 512
#: Identifier, format, bound, offset, pattern (hexadecimal).
CATALOG = [
    ("apm1", "apm", "start", 560, "4170706c655f706172746974696f6e5f6d617000000000000000000000000000"),
    ("ext1", "ext", "start", 1080, "53ef"),
    ("ewf1", "ewf", "start", 0, "455646090d0aff00"),
    ("fat1", "fat", "start", 54, "4641543132202020"),
    ("fat2", "fat", "start", 54, "4641543136202020"),
    ("fat3", "fat", "start", 82, "4641543332202020"),
    ("gpt1", "gpt", "start", 512, "4546492050415254"),
    ("gpt2", "gpt", "start", 1024, "4546492050415254"),
    ("gpt3", "gpt", "start", 2048, "4546492050415254"),
    ("gpt4", "gpt", "start", 4096, "4546492050415254"),
    ("mbr1", "mbr", "start", 510, "55aa"),
    ("mbr2", "mbr", "start", 1022, "55aa"),
    ("mbr3", "mbr", "start", 2046, "55aa"),
    ("mbr4", "mbr", "start", 4094, "55aa"),
    ("ntfs1", "ntfs", "start", 3, "4e54465320202020"),
    ("qcow1", "qcow", "start", 0, "514649fb00000001"),
    ("qcow2", "qcow", "start", 0, "514649fb00000002"),
    ("qcow3", "qcow", "start", 0, "514649fb00000003"),
    ("sparseimage1", "sparseimage", "start", 0, "73707273"),
    ("udif1", "udif", "end", 512, "6b6f6c79"),
    ("vhd1", "vhd", "end", 512, "636f6e6563746978"),
    ("vhdx1", "vhdx", "start", 0, "7668647866696c65"),
]
IMAGES, FILE_SYSTEMS = ("ewf", "qcow", "sparseimage", "udif", "vhd", "vhdx"), ("ext", "fat", "ntfs")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r[:4], bytes.fromhex(r[4])) for r in CATALOG], SCHEMA)


def _hit(bound: str, offset: int, pattern: bytes) -> Column:
    """The byte position where a signature is found, else null. _data may be the head and tail of a stream of _size bytes."""
    p, n = F.unhex(F.lit(pattern.hex())), len(pattern)
    if bound == "start":
        return F.when(F.substring("_data", offset + 1, n) == p, F.lit(offset).cast("long"))
    if bound == "end":
        at = F.expr(f"substring(_data, octet_length(_data) - {offset - 1}, {n})")
        return F.when((F.col("_size") >= offset) & (at == p), (F.col("_size") - offset).cast("long"))
    at = F.locate(pattern.decode("latin-1"), F.decode("_data", "ISO-8859-1"))
    return F.when(at > 0, (at - 1).cast("long"))


def scan(blobs: DataFrame, signatures: DataFrame, data: str = "content", size: Column | None = None) -> DataFrame:
    """The blobs' columns (without `data`), identifier, format and position: a row for each signature found (the first place, of an unbound one).

    The catalog is fetched (at most MOST rows) and becomes one projection in generated code: blobs are read once, joined
    with nothing and not exchanged.
    """
    known = signatures.limit(MOST + 1).collect()
    if len(known) > MOST:
        raise ValueError(f"more than {MOST} signatures; scan by parts of the catalog, or use all_matches")
    keep = [c for c in blobs.columns if c != data]
    rows = blobs.withColumn("_data", F.col(data).cast("binary")).withColumn("_size", size if size is not None else F.octet_length("_data").cast("long"))
    hits = []
    for r in known:
        at = _hit(r["bound"], r["offset"] or 0, bytes(r["pattern"]))
        hits.append(F.when(at.isNotNull(), F.struct(F.lit(r["identifier"]).alias("identifier"), F.lit(r["format"]).alias("format"), at.alias("position"))))
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<identifier:string,format:string,position:bigint>>")
    return rows.select(*keep, F.explode(found).alias("_h")).select(*keep, "_h.*")


def first_per_position(found: DataFrame, keys: list[str]) -> DataFrame:
    """One signature for each position of a blob: the least identifier."""
    w = Window.partitionBy(*keys, "position").orderBy("identifier")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cascade(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, format, ambiguous: image formats before volume systems (APM and GPT, then MBR if no FAT or NTFS boot record is there, which has its mark) before file systems; more than one of a kind is ambiguous and has no format."""
    s = found.groupBy(*keys).agg(F.array_sort(F.collect_set("format")).alias("f"))
    of = lambda *kinds: F.filter("f", lambda x: x.isin(*kinds))
    image, volume, fs = of(*IMAGES), of("apm", "gpt"), of(*FILE_SYSTEMS)
    boot = F.size(of("fat", "ntfs")) > 0
    level = F.when(F.size(image) > 0, image).when(F.size(volume) > 0, volume).when(~boot & F.array_contains("f", "mbr"), F.array(F.lit("mbr"))).otherwise(fs)
    return s.withColumn("_l", level).select(*keys, F.when(F.size("_l") == 1, F.col("_l")[0]).alias("format"), (F.size("_l") > 1).alias("ambiguous"))


def info_formats(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, format: all formats found, but VHD only if alone, and MBR only if nothing else is."""
    s = found.groupBy(*keys).agg(F.collect_set("format").alias("f"))
    others = F.array_except("f", F.array(F.lit("mbr")))
    kept = F.when(F.size(others) == 0, F.col("f")).when(F.size(others) > 1, F.array_except(others, F.array(F.lit("vhd")))).otherwise(others)
    return s.select(*keys, F.explode(kept).alias("format"))


def all_matches(blobs: DataFrame, pattern: bytes, keys: list[str], data: str = "content") -> DataFrame:
    """keys, position: every place of an unbound pattern, overlapping ones included."""
    @F.pandas_udf("array<long>")
    def places(values: pd.Series) -> pd.Series:
        def of(v):
            out, at = [], -1
            while v is not None and (at := bytes(v).find(pattern, at + 1)) >= 0:
                out.append(at)
            return out

        return values.map(of)

    return blobs.select(*keys, F.explode(places(F.col(data).cast("binary"))).alias("position"))
