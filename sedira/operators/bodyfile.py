"""Bodyfile lines (extended version 3): one of 11 fields, separated by |, a file entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "# extended bodyfile 3 format"
#: md5 of an entry without a stream, if digests are asked for; else 0 (fixed values).
NO_STREAM, NOT_ASKED = "0" * 32, "0"


def line(md5: Column, name: Column, inode: Column, mode: Column, uid: Column, gid: Column, size: Column, atime: Column, mtime: Column, ctime: Column, crtime: Column) -> Column:
    """A null field is empty, not left out."""
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (md5, name, inode, mode, uid, gid, size, atime, mtime, ctime, crtime)))


def lines(entries: DataFrame, md5: Column | None = None, prefix: Column | None = None) -> DataFrame:
    """entries: display_path, link_target, identifier, mode_string, owner_id, group_id, size, and atime, mtime, ctime, btime as struct(kind, ticks, nanos). The prefix is a volume's display path; a trailing / of it is dropped."""
    from sedira.functions.time import bodyfile_timestamp

    before = F.regexp_replace(prefix, "/$", "") if prefix is not None else F.lit("")
    name = F.concat(before, F.col("display_path"), F.when(F.col("link_target").isNotNull(), F.concat(F.lit(" -> "), F.col("link_target"))).otherwise(""))
    times = (F.when(F.col(t).isNotNull(), bodyfile_timestamp(F.col(f"{t}.kind"), F.col(f"{t}.ticks"), F.col(f"{t}.nanos"))) for t in ("atime", "mtime", "ctime", "btime"))
    return entries.select(line(md5 if md5 is not None else F.lit(NOT_ASKED), name, F.col("identifier"), F.col("mode_string"), F.col("owner_id"), F.col("group_id"), F.col("size"), *times).alias("value"))


def write(lines_: DataFrame, path: str) -> None:
    """Text files of lines; the header is a file of its own, first by name."""
    spark = lines_.sparkSession
    spark.createDataFrame([(HEADER,)], "value string").coalesce(1).write.text(f"{path}/header")
    lines_.write.text(f"{path}/lines")
