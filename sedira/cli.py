"""The verbs of the command line, for spark-submit or python -m sedira.cli.

image <path> bodyfile|hash|hierarchy|volumes|info|verify, hash <path>, export <path> <display path> <target>,
info <path> [entry <identifier> | path <display path> | hierarchy].
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedira.operators import bodyfile, reports
from sedira.sources import datasources


def digests(spark: SparkSession, path: str, kind: str = "md5", stop: bool = False) -> DataFrame:
    """digest and name of every data stream of the file systems in an image; of the file itself if it holds none."""
    forks = spark.read.format("data_forks").options(path=path, digest=kind, mode="FAILFAST" if stop else "PERMISSIVE").load()
    if forks.isEmpty():
        from sedira.operators.relations import stream_digests

        return stream_digests(spark.read.format("blob_chunks").options(path=path).load(), (kind,), "path").select(F.col(kind).alias("digest"), F.col("path").alias("name"))
    prefix = F.when(F.col("volume") > 0, F.concat(F.lit("/p"), F.col("volume").cast("string"))).otherwise("")
    return forks.select("digest", F.concat(prefix, "display_path", F.when(F.col("fork_name").isNotNull(), F.concat(F.lit(":"), F.col("fork_name"))).otherwise("")).alias("name"))


def bodyfile_lines(spark: SparkSession, path: str, with_md5: bool = False) -> DataFrame:
    """The lines of all entries, with a row a named fork, in no order; entries keep their volume's prefix."""
    e = spark.read.format("file_entries").options(path=path, with_md5=str(with_md5).lower()).load().where("display_path is not null")
    prefix = F.when(F.col("volume") > 0, F.concat(F.lit("/p"), F.col("volume").cast("string"))).otherwise("")
    # a FAT time has no place in the format's time fields
    own = bodyfile.lines(e, F.col("md5") if with_md5 else None, prefix)
    forks = spark.read.format("data_forks").options(path=path, **({"digest": "md5"} if with_md5 else {})).load().where("fork_name is not null")
    joined = forks.select("volume", "identifier", "fork_name", F.col("size").alias("fork_size"), "digest").join(e.drop("size", "md5"), ["volume", "identifier"])
    named = joined.withColumn("display_path", F.concat("display_path", F.lit(":"), "fork_name")).withColumn("size", F.col("fork_size")).withColumn("link_target", F.lit(None).cast("string"))
    return own.unionByName(bodyfile.lines(named, F.col("digest") if with_md5 else None, prefix))


def export(spark: SparkSession, path: str, display_path: str, target: str) -> int:
    """Writes the streams of an entry to files below `target`, where they are read, a mebibyte at a time; the number of files. A name cannot lead out of the target."""
    rows = spark.read.format("data_forks").options(path=path).load().where(F.col("display_path") == display_path)
    rows = rows.select("path", "volume", "display_path", "identifier", "fork_index", "fork_name").collect()  # the streams of one entry a volume

    def put(batch):
        from sedira.sources import datasources

        os.makedirs(target, exist_ok=True)
        for r in batch:
            reader = datasources.DataForks({"path": r["path"]})
            reader.lookup = {"display_path": r["display_path"]}
            fs, _ = reader.open(datasources.Part(r["path"], volume=r["volume"]))
            entry = next(e for e in reader.found(fs) if e.identifier == r["identifier"])
            name = "_".join(x for x in (str(r["volume"]), os.path.basename(r["display_path"]) or "root", r["fork_name"]) if x).replace(os.sep, "_")
            with open(os.path.join(target, name), "wb") as f:
                for chunk in entry.forks[r["fork_index"]].stream.chunks(1 << 20):
                    f.write(chunk)

    if rows:
        spark.createDataFrame(rows).repartition(len(rows)).foreachPartition(put)
    return len(rows)


def write_digests(rows: DataFrame, target: str) -> None:
    """A digest list as text files, `digest  name` a line, as the hash commands of shells read it."""
    rows.select(F.concat_ws("  ", "digest", "name").alias("value")).write.text(target)


def run(spark: SparkSession, argv: list[str]) -> DataFrame | int | None:
    datasources.register(spark)
    p = argparse.ArgumentParser(prog="sedira", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("image")
    a.add_argument("path")
    a.add_argument("what", choices=["bodyfile", "hash", "hierarchy", "volumes", "info", "verify"])
    a.add_argument("--md5", action="store_true")
    a = verbs.add_parser("hash")
    a.add_argument("path")
    a.add_argument("--digest", default="md5", choices=["md5", "sha1", "sha224", "sha256", "sha512"])
    a.add_argument("--stop-on-error", action="store_true")
    a.add_argument("--output", help="a folder for the list, which is written where the digests are made")
    a = verbs.add_parser("export")
    for x in ("path", "entry", "target"):
        a.add_argument(x)
    a = verbs.add_parser("info")
    a.add_argument("path")
    a.add_argument("what", nargs="?", choices=["entry", "path", "hierarchy"])
    a.add_argument("which", nargs="?")
    o = p.parse_args(argv)
    if o.verb == "hash":
        found = digests(spark, o.path, o.digest, o.stop_on_error)
        return write_digests(found, o.output) if o.output else found
    if o.verb == "export":
        return export(spark, o.path, o.entry, o.target)
    if o.verb == "info":
        if o.what == "hierarchy":
            return reports.hierarchy_report(spark, o.path)
        if o.what:
            return reports.entry_report(spark, o.path, **{"identifier" if o.what == "entry" else "display_path": o.which})
        return reports.file_system_report(spark, o.path)
    if o.what == "bodyfile":
        return bodyfile_lines(spark, o.path, o.md5)
    if o.what == "hash":
        from sedira.operators.relations import stream_digests

        return stream_digests(spark.read.format("image_chunks").options(path=o.path).load(), ("md5",), "path")
    return {"hierarchy": reports.hierarchy_report, "volumes": reports.volume_report, "info": reports.image_report, "verify": reports.verify_report}[o.what](spark, o.path)


if __name__ == "__main__":
    import sys

    from sedira.session import build

    result = run(build(), sys.argv[1:])
    if isinstance(result, DataFrame):
        for row in result.toLocalIterator():
            print(*("" if v is None else v for v in row), sep="\t")
    elif result is not None:
        print(result)
