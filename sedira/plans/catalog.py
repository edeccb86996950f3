"""The catalog of queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedira.functions import binary, codec, digest, text, time
from sedira.operators import bodyfile, relations, signatures
from sedira.session import bound_batches

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text of documents, for work that Python does on every byte: dealt to all cores, as one row group of a file is one task however large, in bounded batches."""
    bound_batches(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    return _t(spark, d, "documents").select("doc_id", "text").repartition(n, "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- digests and checksums ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def digest_md5(spark, d):
    return _t(spark, d, "documents").select("doc_id", digest.digest(F.col("text"), "md5").alias("digest"))


@query("SELECT doc_id, sha1(text) AS digest FROM documents")
def digest_sha1(spark, d):
    return _t(spark, d, "documents").select("doc_id", digest.digest(F.col("text"), "sha1").alias("digest"))


@query()
def digest_sha224(spark, d):
    return _t(spark, d, "documents").select("doc_id", digest.digest(F.col("text"), "sha224").alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def digest_sha256(spark, d):
    return _t(spark, d, "documents").select("doc_id", digest.digest(F.col("text"), "sha256").alias("digest"))


@query()
def digest_sha512(spark, d):
    return _t(spark, d, "documents").select("doc_id", digest.digest(F.col("text"), "sha512").alias("digest"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' ELSE 'sha256' END AS kind, CASE doc_id % 3 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) ELSE sha256(text) END AS digest FROM documents")
def digest_by_kind(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "md5").when(F.col("doc_id") % 3 == 1, "sha1").otherwise("sha256")
    return _t(spark, d, "documents").withColumn("kind", kind).select("doc_id", "kind", digest.digest_by(F.col("kind"), F.col("text").cast("binary")).alias("digest"))


@query()
def checksum_crc32(spark, d):
    return _t(spark, d, "documents").select("doc_id", digest.crc32(F.col("text").cast("binary")).alias("crc32"))


@query()
def checksum_crc32c(spark, d):
    return _t(spark, d, "documents").select("doc_id", digest.crc_with(F.col("text").cast("binary"), digest.CRC32C).alias("crc32c"))


@query()
def checksum_crc32_forward(spark, d):
    return _t(spark, d, "documents").select("doc_id", digest.crc_with(F.col("text").cast("binary"), digest.CRC32_FORWARD, False).alias("crc32"))


_ADLER = """SELECT doc_id, ((list_sum(list_transform(range(n), lambda i: (n - i) * c[i + 1])) + n) % 65521 * 65536 + (list_sum(c) + 1) % 65521)::BIGINT AS adler32
FROM (SELECT doc_id, octet_length(encode(text)) AS n, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS c FROM documents WHERE length(text) > 0)
UNION ALL SELECT doc_id, CASE WHEN text = '' THEN 1 END FROM documents WHERE coalesce(length(text), 0) = 0"""


@query(_ADLER)
def checksum_adler32(spark, d):
    return _t(spark, d, "documents").select("doc_id", digest.adler32_long(F.col("text").cast("binary")).alias("adler32"))


@query("SELECT p_partkey, ((list_sum(list_transform(range(n), lambda i: (n - i) * c[i + 1])) + n) % 65521 * 65536 + (list_sum(c) + 1) % 65521)::BIGINT AS adler32 FROM (SELECT p_partkey, length(p_name) AS n, list_transform(string_split(p_name, ''), lambda x: unicode(x)::BIGINT) AS c FROM part)")
def checksum_adler32_names(spark, d):
    return _t(spark, d, "part").select("p_partkey", digest.adler32(F.col("p_name").cast("binary")).alias("adler32"))


@query("SELECT doc_id, md5(text) AS stored, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS computed, doc_id % 5 <> 0 AS verified FROM documents")
def digest_verify(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.md5("text").alias("stored"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("media"))
    return docs.select("doc_id", "stored", digest.digest(F.col("media")).alias("computed")).withColumn("verified", F.col("stored") == F.col("computed"))


def _chunks(spark, d):
    """doc_id, chunk_no and bytes of the texts in chunks of 512 bytes; a text is cut before its pieces are rows."""
    at = F.sequence(F.lit(0), F.floor((F.octet_length("content") - 1) / 512).cast("int"))
    docs = _t(spark, d, "documents").where("length(text) > 0").select("doc_id", F.col("text").cast("binary").alias("content"))
    return docs.select("doc_id", F.posexplode(F.transform(at, lambda k: F.substring(F.col("content"), k * 512 + 1, F.lit(512)))).alias("chunk_no", "bytes"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS size, md5(text) AS md5, sha256(text) AS sha256 FROM documents WHERE length(text) > 0")
def digest_of_chunks(spark, d):
    return relations.stream_digests(_chunks(spark, d), ("md5", "sha256"), "doc_id")


@query()
def checksum_crc32_of_chunks(spark, d):
    return relations.combine_crc32(_chunks(spark, d).select("doc_id", "chunk_no", F.crc32("bytes").alias("c"), F.octet_length("bytes").alias("n")), "doc_id", "chunk_no", "c", "n")


# ---- dates and times ---------------------------------------------------------------------------------------------------

_SECS = "epoch_us(ts) // 1000000"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


@query(f"SELECT event_id, {_ISO} AS iso FROM events")
def posix_iso(spark, d):
    return _t(spark, d, "events").select("event_id", time.posix_iso(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("iso"))


@query(f"SELECT event_id, {_ISO} || '.' || lpad((epoch_us(ts) % 1000000 * 1000)::VARCHAR, 9, '0') AS iso, {_ISO} || '.' || lpad((epoch_us(ts) % 1000000 * 1000)::VARCHAR, 9, '0') || ' (' || ({_SECS})::VARCHAR || '.' || (epoch_us(ts) % 1000000 * 1000)::VARCHAR || ')' AS display FROM events")
def posix_ns_iso(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = _t(spark, d, "events").select("event_id", F.floor(us / 1000000).alias("s"), (us % 1000000 * 1000).alias("n"))
    return e.select("event_id", time.posix_ns_iso(F.col("s"), F.col("n")).alias("iso"), time.posix_ns_display(F.col("s"), F.col("n")).alias("display"))


_TICKS = "((epoch_us(ts)::HUGEINT + 11644473600000000) * 10)"


@query(f"SELECT event_id, {_TICKS}::DECIMAL(20, 0) AS ticks FROM events")
def filetime_ticks(spark, d):
    return _t(spark, d, "events").select("event_id", time.filetime_of_timestamp(F.col("ts")).alias("ticks"))


@query(f"SELECT event_id, {_ISO} || '.' || lpad((epoch_us(ts) % 1000000 * 10)::VARCHAR, 7, '0') AS iso FROM events")
def filetime_iso(spark, d):
    return _t(spark, d, "events").select("event_id", time.filetime_iso(time.filetime_of_timestamp(F.col("ts"))).alias("iso"))


@query(f"SELECT event_id, {_ISO} || '.' || lpad((epoch_us(ts) % 1000000 * 10)::VARCHAR, 7, '0') || ' (0x' || lpad(lower(hex(({_TICKS} // 4294967296)::BIGINT)), 8, '0') || ':0x' || lpad(lower(hex(({_TICKS} % 4294967296)::BIGINT)), 8, '0') || ')' AS display FROM events")
def filetime_display(spark, d):
    return _t(spark, d, "events").select("event_id", time.filetime_display(time.filetime_of_timestamp(F.col("ts"))).alias("display"))


@query("SELECT event_id, ts AS ts FROM events")
def filetime_roundtrip(spark, d):
    return _t(spark, d, "events").select("event_id", time.filetime_timestamp(time.filetime_of_timestamp(F.col("ts"))).cast("timestamp_ntz").alias("ts"))


@query("SELECT o_orderkey, ((year(o_orderdate) - 1980) * 512 + month(o_orderdate) * 32 + day(o_orderdate))::INT AS fat_date, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def fat_date_pack(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", time.fat_date_pack(F.col("o_orderdate")).alias("fat_date"))
    return o.withColumn("iso", time.fat_date_iso(F.col("fat_date")))


@query("SELECT event_id, (hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2)::INT AS fat_time FROM events")
def fat_time_pack(spark, d):
    return _t(spark, d, "events").select("event_id", time.fat_time_pack(F.col("ts")).alias("fat_time"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:') || lpad((second(ts) // 2 * 2)::VARCHAR, 2, '0') AS iso, date_trunc('minute', ts) + to_seconds(second(ts) // 2 * 2) AS ts FROM events")
def fat_datetime_iso(spark, d):
    e = _t(spark, d, "events").select("event_id", time.fat_date_pack(F.col("ts")).alias("d"), time.fat_time_pack(F.col("ts")).alias("t"))
    return e.select("event_id", time.fat_datetime_iso(F.col("d"), F.col("t")).alias("iso"), time.fat_timestamp(F.col("d"), F.col("t")).alias("ts"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_us(ts) % 1000000 // 10000)::VARCHAR, 2, '0') AS iso FROM events")
def fat_10ms_iso(spark, d):
    tens = F.second("ts") % 2 * 100 + F.floor(F.unix_micros(F.col("ts").cast("timestamp")) % 1000000 / 10000)
    e = _t(spark, d, "events").select("event_id", time.fat_date_pack(F.col("ts")).alias("d"), time.fat_time_pack(F.col("ts")).alias("t"), tens.cast("int").alias("h"))
    return e.select("event_id", time.fat_10ms_iso(F.col("d"), F.col("t"), F.col("h")).alias("iso"))


@query("SELECT o_orderkey, (DATE '1899-12-30' + (o_orderkey % 60000 - 20000)::INT)::DATE AS day, (o_orderkey * 7919 - 9999999) // 86400 - CASE WHEN (o_orderkey * 7919 - 9999999) % 86400 < 0 THEN 1 ELSE 0 END AS days, ((o_orderkey * 7919 - 9999999) % 86400 + 86400) % 86400 // 3600 AS hours FROM orders")
def calendar_days(spark, d):
    s = time.time_of_seconds(F.col("o_orderkey") * 7919 - 9999999)
    return _t(spark, d, "orders").select("o_orderkey", time.date_of_days(F.col("o_orderkey") % 60000 - 20000, "1899-12-30").alias("day"), s["days"].alias("days"), s["hours"].cast("long").alias("hours"))


@query("SELECT y::INT AS year, (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 AS leap, (make_date(y + 1, 1, 1) - make_date(y, 1, 1))::INT AS days, day(last_day(make_date(y, 2, 1)))::INT AS february FROM (SELECT DISTINCT 1600 + o_orderkey % 800 AS y FROM orders)")
def calendar_years(spark, d):
    y = _t(spark, d, "orders").select((F.col("o_orderkey") % 800 + 1600).cast("int").alias("year")).distinct()
    return y.select("year", time.is_leap_year(F.col("year")).alias("leap"), time.days_in_year(F.col("year")).alias("days"), time.days_in_month(F.col("year"), F.lit(2)).alias("february"))


@query(f"""SELECT event_id, CASE event_id % 4
  WHEN 0 THEN ({_SECS})::VARCHAR || '.' || lpad((epoch_us(ts) % 1000000 * 10)::VARCHAR, 7, '0')
  WHEN 1 THEN ({_SECS})::VARCHAR
  WHEN 2 THEN ({_SECS})::VARCHAR || '.' || lpad((epoch_us(ts) % 1000000 * 1000)::VARCHAR, 9, '0') ELSE '' END AS timestamp FROM events""")
def bodyfile_timestamp(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.element_at(F.array(*(F.lit(k) for k in ("filetime", "posix32", "posix64ns", "not_set"))), (F.col("event_id") % 4 + 1).cast("int"))
    ticks = F.when(F.col("event_id") % 4 == 0, time.filetime_of_timestamp(F.col("ts"))).otherwise(F.floor(us / 1000000).cast(time.U64))
    return _t(spark, d, "events").select("event_id", time.bodyfile_timestamp(kind, ticks, us % 1000000 * 1000).alias("timestamp"))


@query("SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 // 500000 <> 0 THEN 'posix64ns' WHEN event_id % 3 <> 0 THEN 'posix32' ELSE 'not_set' END AS kind FROM events")
def clock_kind(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return _t(spark, d, "events").select("event_id", time.clock_choice(F.col("event_id") % 3, F.floor(us % 1000000 / 500000)).alias("kind"))


@query("""SELECT '0|/' || source || '/' || d.doc_id::VARCHAR || '.' || lang || CASE WHEN quality = 1 AND url IS NOT NULL THEN ' -> ' || url ELSE '' END || '|' || d.doc_id::VARCHAR || '|-rw-r--r--|' || coalesce(quality::VARCHAR, '') || '|' || coalesce(toxic::VARCHAR, '') || '|' || n_chars::VARCHAR || '||' || n_chars::VARCHAR || '|' || n_chars::VARCHAR || '.000000005|' AS value
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN pages p ON d.doc_id = p.page_id""")
def bodyfile_lines(spark, d):
    docs, labels, pages = _t(spark, d, "documents"), _t(spark, d, "labels"), _t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    at = lambda kind, nanos: F.struct(F.lit(kind).alias("kind"), F.col("n_chars").cast(time.U64).alias("ticks"), F.lit(nanos).alias("nanos"))
    e = docs.join(labels, "doc_id", "left").join(pages, "doc_id", "left")
    e = e.select(
        F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("display_path"), F.when(F.col("quality") == 1, F.col("url")).alias("link_target"),
        F.col("doc_id").alias("identifier"), text.mode_string_posix(F.lit(0o100644)).alias("mode_string"), F.col("quality").alias("owner_id"), F.col("toxic").alias("group_id"), F.col("n_chars").alias("size"),
        at("not_set", 0).alias("atime"), at("posix32", 0).alias("mtime"), at("posix64ns", 5).alias("ctime"), F.when(F.lit(False), at("posix32", 0)).alias("btime"),
    )
    return bodyfile.lines(e)


# ---- strings, paths, formatting --------------------------------------------------------------------------------------------


@query("SELECT page_id, string_split(url, '/') AS components FROM pages")
def path_split(spark, d):
    return _t(spark, d, "pages").select("page_id", text.path_split(F.col("url")).alias("components"))


@query("SELECT page_id, string_split(url, '/')[:-2] AS parent, string_split(url, '/')[-1] AS filename, array_to_string(string_split(url, '/')[:-2], '/') AS parent_path FROM pages")
def path_parent(spark, d):
    p = _t(spark, d, "pages").select("page_id", text.path_split(F.col("url")).alias("c"))
    parent = text.path_parent(F.col("c"))
    return p.select("page_id", parent.alias("parent"), text.path_filename(F.col("c")).alias("filename"), text.path_join(parent).alias("parent_path"))


@query("SELECT page_id, CASE WHEN regexp_full_match(f, '(?s).+\\.[^.]*') THEN regexp_extract(f, '\\.([^.]*)$', 1) END AS extension, CASE WHEN regexp_full_match(f, '(?s).+\\.[^.]*') THEN regexp_replace(f, '\\.[^.]*$', '') ELSE f END AS stem FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '.hidden' WHEN page_id % 4 = 1 THEN regexp_replace(url, '^.*/', '') || '.tar.gz' ELSE regexp_replace(url, '^.*/', '') END AS f FROM pages)")
def path_ext_stem(spark, d):
    name = F.regexp_replace("url", "^.*/", "")
    f = F.when(F.col("page_id") % 4 == 0, ".hidden").when(F.col("page_id") % 4 == 1, F.concat(name, F.lit(".tar.gz"))).otherwise(name)
    return _t(spark, d, "pages").select("page_id", f.alias("f")).select("page_id", text.file_extension(F.col("f")).alias("extension"), text.file_stem(F.col("f")).alias("stem"))


@query("SELECT page_id, 'C:\\' || replace(substr(url, 9), '/', '\\') AS path, len(string_split(substr(url, 9), '/')) + 1 AS n FROM pages")
def path_join(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.concat(F.array(F.lit("C:")), text.path_split(F.substring("url", 9, 9999))).alias("c"))
    return p.select("page_id", text.path_join(F.col("c"), "\\").alias("path")).withColumn("n", F.size(text.path_split(F.col("path"), "\\")).cast("long"))


@query(r"SELECT doc_id, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '/', '\/'), ':', '\:'), chr(10), '\x0a'), chr(13), '\x0d'), chr(9), '\x09') AS escaped FROM documents")
def display_escape(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.display_escape(F.col("text")).alias("escaped"))


@query(r"SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda x: replace(x, ':', '\:')), '/') AS path FROM pages")
def display_path(spark, d):
    return _t(spark, d, "pages").select("page_id", text.display_path(text.path_split(F.col("url"))).alias("path"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/gpt{' || md5(p_name) || '}' WHEN 1 THEN '/p' || p_size::VARCHAR WHEN 2 THEN '/p' || p_size::VARCHAR ELSE '' END AS path FROM part")
def layer_display_path(spark, d):
    kind = F.element_at(F.array(*(F.lit(k) for k in ("GPT", "MBR", "APM", "QCOW"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", text.layer_display_path(kind, F.concat(F.lit("/"), F.lower(kind), F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 4 == 0, F.md5("p_name"))).alias("path"))


_RWX = " || ".join(f"CASE WHEN m & {0o400 >> k} <> 0 THEN '{'rwx'[k % 3]}' ELSE '-' END" for k in range(9))


@query(f"SELECT event_id, CASE m & 61440 WHEN 4096 THEN 'p' WHEN 8192 THEN 'c' WHEN 16384 THEN 'd' WHEN 24576 THEN 'b' WHEN 40960 THEN 'l' WHEN 49152 THEN 's' ELSE '-' END || {_RWX} AS mode FROM (SELECT event_id, (event_id * 7919) % 65536 AS m FROM events)")
def mode_string_posix(spark, d):
    return _t(spark, d, "events").select("event_id", text.mode_string_posix((F.col("event_id") * 7919 % 65536).cast("int")).alias("mode"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'l' ELSE '-' END || CASE WHEN event_id & 5 <> 0 THEN 'r-xr-xr-x' ELSE 'rwxrwxrwx' END AS mode, CASE event_id % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'l' ELSE 'b' END || 'rwxrwxrwx' AS by_type FROM events")
def mode_string_dos(spark, d):
    kind = F.element_at(F.array(*(F.lit(k) for k in ("directory", "symbolic_link", "block_device"))), (F.col("event_id") % 3 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", text.mode_string_dos(kind, F.col("event_id")).alias("mode"), text.mode_string_type(kind).alias("by_type"))


def _size_sql(base: int) -> str:
    last = "iB" if base == 1024 else "B"
    cases = " ".join(f"WHEN v >= {base**k}::BIGINT THEN printf('%.1f {u}{last}', v / {base**k}.0::DOUBLE)" for k, u in reversed(list(enumerate("KMGTPE", 1))))
    return f"SELECT doc_id, CASE {cases} ELSE v::VARCHAR || ' B' END AS size FROM (SELECT doc_id, n_chars * [1, 9, 1021, 52111, 5000000, 123456789][(doc_id % 6)::INT + 1] AS v FROM documents)"


def _sizes(spark, d):
    by = F.element_at(F.array(*(F.lit(k).cast("long") for k in (1, 9, 1021, 52111, 5000000, 123456789))), (F.col("doc_id") % 6 + 1).cast("int"))
    return _t(spark, d, "documents").select("doc_id", (F.col("n_chars") * by).alias("v"))


@query(_size_sql(1024))
def bytesize_1024(spark, d):
    return _sizes(spark, d).select("doc_id", text.bytesize(F.col("v"), 1024).alias("size"))


@query(_size_sql(1000))
def bytesize_1000(spark, d):
    return _sizes(spark, d).select("doc_id", text.bytesize(F.col("v"), 1000).alias("size"))


@query("SELECT doc_id, lower(hex(encode(text))) AS hex FROM documents")
def hex_lower(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.hex_lower(F.col("text").cast("binary")).alias("hex"))


_CELLS = lambda a, b: " || ".join(f"CASE WHEN length(h) > {2 * k} THEN substr(h, {2 * k + 1}, 2) || ' ' ELSE '   ' END" for k in range(a, b))


@query(f"SELECT p_partkey, '00000000  ' || {_CELLS(0, 8)} || ' ' || {_CELLS(8, 16)} || ' ' || substr(p_name, 1, 16) AS line FROM (SELECT p_partkey, p_name, lower(hex(encode(substr(p_name, 1, 16)))) AS h FROM part)")
def hexdump_line(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.hexdump_line(F.col("p_name").cast("binary")).alias("line"))


@query()
def hexdump(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.hexdump(F.col("text").cast("binary"), True).alias("dump"))


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21)"


@query(f"SELECT doc_id, {_UUID} AS uuid FROM (SELECT doc_id, md5(text) AS h FROM documents)")
def uuid_from_digest(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.uuid_be(F.unhex(F.md5("text"))).alias("uuid"))


@query("SELECT doc_id, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS uuid, upper(h) AS parsed FROM (SELECT doc_id, md5(text) AS h FROM documents)")
def uuid_le(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.unhex(F.md5("text")).alias("b"))
    return docs.select("doc_id", text.uuid_le(F.col("b")).alias("uuid"), F.hex(text.uuid_parse(F.concat(F.lit("{"), text.uuid_be(F.col("b")), F.lit("}")))).alias("parsed"))


@query("SELECT o_orderkey, CASE WHEN count(*) > 1 AND count(DISTINCT l_returnflag) = 1 THEN '[' || min(l_returnflag) || '; ' || count(*)::VARCHAR || ']' ELSE '[' || string_agg(l_returnflag, ', ' ORDER BY l_linenumber, l_returnflag) || ']' END AS flags FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(*) <= 16")
def array_text(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("v")).where("size(v) <= 16")
    return rows.select("o_orderkey", text.array_text(F.transform("v", lambda x: x["l_returnflag"])).alias("flags"))


@query("SELECT doc_id, text FROM documents")
def base64_roundtrip(spark, d):
    return _t(spark, d, "documents").select("doc_id", codec.base64_stream(F.base64(F.col("text").cast("binary"))).cast("string").alias("text"))


@query("SELECT doc_id, (octet_length(encode(text)) > 0 AND doc_id % 3 <> 1) AS valid FROM documents WHERE length(text) > 0")
def base64_strict(spark, d):
    encoded = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    bad = F.when(F.col("doc_id") % 3 == 1, F.concat(encoded, F.lit("*"))).otherwise(encoded)
    return _t(spark, d, "documents").where("length(text) > 0").select("doc_id", codec.base64_decode(bad).isNotNull().alias("valid"))


@query("SELECT doc_id, 2 * (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) AS bytes FROM documents")
def utf16_len(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.octet_length(F.encode("text", "UTF-16LE")).cast("long").alias("bytes"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents")
def latin1_decode(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.length(codec.decode(F.col("text").cast("binary"), "iso8859_1")).cast("long").alias("n"))


@query("SELECT p_partkey, upper(p_name) AS folded FROM part")
def name_casefold(spark, d):
    return _t(spark, d, "part").select("p_partkey", codec.casefold(F.col("p_name")).alias("folded"))


def _codepage(charset: str):
    def run(spark, d):
        for setting in ("javaCharsets", "codingErrorAction"):
            spark.conf.set(f"spark.sql.legacy.{setting}", "true")
        docs = _texts(spark, d).withColumn("raw", codec.encode(F.col("text"), charset)).where("raw is not null")
        return docs.select("doc_id", codec.decode(F.col("raw"), charset).alias("text"))

    run.__name__ = f"codepage_{charset}"
    return run


def _repertoire(charset: str) -> str:
    return "".join(sorted(set(codec.table(charset).values())))


for _cs in ("iso8859_1", "iso8859_10", "iso8859_14", "iso8859_15", "koi8_r", "windows1252", "windows1250", "mac_roman", "mac_celtic", "mac_gaelic"):
    _set = _repertoire(_cs).replace("'", "''")
    _known = f"list_has_all(string_split('{_set.replace(chr(0), '')}', ''), list_distinct(string_split(text, '')))"
    query(f"SELECT doc_id, text FROM documents WHERE text = '' OR {_known}")(_codepage(_cs))


# ---- layouts -------------------------------------------------------------------------------------------------------------

_LAYOUT = binary.Layout("head", (binary.Field("a", "u32"), binary.Field("b", "u16", order="be"), binary.Field("c", "i16"), binary.Field("e", "u64", order="be"), binary.Field("f", "u8", count=2), binary.Field("g", "i32")))
_LE = lambda a, n: " || ".join(f"substr(h, {a + 2 * k}, 2)" for k in reversed(range(n)))


@query(f"SELECT doc_id, ('0x' || {_LE(1, 4)})::BIGINT AS u32 FROM (SELECT doc_id, md5(text) AS h FROM documents)")
def layout_u32_le(spark, d):
    return _t(spark, d, "documents").select("doc_id", binary.unsigned(F.unhex(F.md5("text")), 0, 4).alias("u32"))


@query("SELECT doc_id, ('0x' || substr(h, 1, 16))::UBIGINT::DECIMAL(20, 0) AS u64 FROM (SELECT doc_id, md5(text) AS h FROM documents)")
def layout_u64_be(spark, d):
    return _t(spark, d, "documents").select("doc_id", binary.unsigned(F.unhex(F.md5("text")), 0, 8, "be").alias("u64"))


_I16 = f"('0x' || {_LE(13, 2)})::BIGINT"
_I32 = f"('0x' || {_LE(37, 4)})::BIGINT"


@query(f"SELECT doc_id, ('0x' || {_LE(1, 4)})::BIGINT AS a, ('0x' || substr(h, 9, 4))::BIGINT AS b, CASE WHEN {_I16} >= 32768 THEN {_I16} - 65536 ELSE {_I16} END AS c, ('0x' || substr(h, 17, 16))::UBIGINT::DECIMAL(20, 0) AS e, ('0x' || substr(h, 33, 2))::BIGINT + ('0x' || substr(h, 35, 2))::BIGINT AS f, CASE WHEN {_I32} >= 2147483648 THEN {_I32} - 4294967296 ELSE {_I32} END AS g FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def layout_struct(spark, d):
    s = _t(spark, d, "documents").select("doc_id", binary.parse(F.unhex(F.sha2("text", 256)), _LAYOUT).alias("s"))
    return s.select("doc_id", "s.a", "s.b", "s.c", "s.e", (F.col("s.f")[0] + F.col("s.f")[1]).alias("f"), "s.g")


# ---- signatures ------------------------------------------------------------------------------------------------------------

_SIGS = [("en", "en", "start", 21, b'lang="en"'), ("fr", "fr", "start", 21, b'lang="fr"'), ("de", "de", "start", 21, b'lang="de"'), ("doctype", "html", "start", 0, b"<!DOCTYPE html>"), ("tail", "html", "end", 7, b"</html>"), ("body", "body", "unbound", 0, b"<body"), ("nav", "nav", "unbound", 0, b"<nav")]


def _pages(spark, d, *bounds):
    sigs = spark.createDataFrame([s for s in _SIGS if s[2] in bounds], signatures.SCHEMA)
    return signatures.scan(_t(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content")), sigs)


_AT = "substr(hex(encode(html)), {at} * 2 + 1, {n} * 2) = upper('{h}')"
_START = " UNION ALL ".join(f"SELECT page_id, '{s[0]}' AS identifier, '{s[1]}' AS format, {s[3]}::BIGINT AS position FROM pages WHERE {_AT.format(at=s[3], n=len(s[4]), h=s[4].hex())}" for s in _SIGS if s[2] == "start")
_END = " UNION ALL ".join(f"SELECT page_id, '{s[0]}' AS identifier, '{s[1]}' AS format, octet_length(encode(html)) - {s[3]} AS position FROM pages WHERE {_AT.format(at=f'(octet_length(encode(html)) - {s[3]})', n=len(s[4]), h=s[4].hex())}" for s in _SIGS if s[2] == "end")
_ANY = " UNION ALL ".join(f"SELECT page_id, '{s[0]}' AS identifier, '{s[1]}' AS format, octet_length(encode(substr(html, 1, instr(html, '{s[4].decode()}') - 1))) AS position FROM pages WHERE instr(html, '{s[4].decode()}') > 0" for s in _SIGS if s[2] == "unbound")


@query(_START)
def sig_bound_start(spark, d):
    return _pages(spark, d, "start")


@query(_END)
def sig_bound_end(spark, d):
    return _pages(spark, d, "end")


@query(_ANY)
def sig_unbound_first(spark, d):
    return _pages(spark, d, "unbound")


@query("WITH RECURSIVE f AS (SELECT page_id, html, instr(html, '<p>') AS k FROM pages WHERE instr(html, '<p>') > 0 UNION ALL SELECT page_id, html, k + instr(substr(html, k + 1), '<p>') FROM f WHERE instr(substr(html, k + 1), '<p>') > 0) SELECT page_id, octet_length(encode(substr(html, 1, k - 1))) AS position FROM f")
def sig_all_matches(spark, d):
    return signatures.all_matches(_t(spark, d, "pages").select("page_id", F.col("html").alias("content")), b"<p>", ["page_id"])


@query(f"SELECT page_id, min(identifier) AS identifier, min_by(format, identifier) AS format, position FROM ({_START} UNION ALL {_ANY}) GROUP BY page_id, position")
def sig_first_per_offset(spark, d):
    return signatures.first_per_position(_pages(spark, d, "start", "unbound"), ["page_id"]).select("page_id", "identifier", "format", "position")


_KINDS = ["qcow", "vhd", "gpt", "mbr", "fat", "ext", "ntfs", "apm", "ewf"]


def _found(spark, d):
    at = lambda k: F.element_at(F.array(*(F.lit(x) for x in _KINDS)), (k % 9 + 1).cast("int"))
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("blob"), at(F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("format"))


_FOUND = f"f AS (SELECT l_orderkey AS blob, list_distinct(list([{', '.join(repr(k) for k in _KINDS)}][((l_partkey * 7 + l_suppkey) % 9)::INT + 1])) AS f FROM lineitem GROUP BY 1)"
_PICK = "list_intersect(f, [{}])"
_IMG, _VOL, _FS = (_PICK.format(", ".join(repr(k) for k in ks)) for ks in (signatures.IMAGES, ("apm", "gpt"), signatures.FILE_SYSTEMS))


@query(f"WITH {_FOUND}, l AS (SELECT blob, CASE WHEN len({_IMG}) > 0 THEN {_IMG} WHEN len({_VOL}) > 0 THEN {_VOL} WHEN len({_PICK.format(repr('fat') + ', ' + repr('ntfs'))}) = 0 AND list_contains(f, 'mbr') THEN ['mbr'] ELSE {_FS} END AS l FROM f) SELECT blob, CASE WHEN len(l) = 1 THEN l[1] END AS format, len(l) > 1 AS ambiguous FROM l")
def format_cascade(spark, d):
    return signatures.cascade(_found(spark, d), ["blob"])


@query(f"WITH {_FOUND}, o AS (SELECT blob, f, list_filter(f, lambda x: x <> 'mbr') AS o FROM f) SELECT blob, unnest(CASE WHEN len(o) = 0 THEN f WHEN len(o) > 1 THEN list_filter(o, lambda x: x <> 'vhd') ELSE o END) AS format FROM o")
def format_info(spark, d):
    return signatures.info_formats(_found(spark, d), ["blob"])


# ---- relations ---------------------------------------------------------------------------------------------------------------

_RANGES = "r AS (SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM lineitem)"


@query(f"WITH {_RANGES} SELECT o_orderkey, o_custkey % 200 AS offset, l_linenumber, o_custkey % 200 - lo AS within FROM orders JOIN r ON o_orderkey = l_orderkey AND o_custkey % 200 >= lo AND o_custkey % 200 < hi")
def interval_lookup(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    before = F.coalesce(F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).cast("long")
    after = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    ranges = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("stream"), "l_linenumber", before.alias("lo"), after.alias("hi"))
    points = _t(spark, d, "orders").select(F.col("o_orderkey").alias("stream"), (F.col("o_custkey") % 200).alias("offset"))
    j = relations.interval_join(points, ranges, "offset", "lo", "hi", 64, ["stream"])
    return j.select(F.col("stream").alias("o_orderkey"), "offset", "l_linenumber", (F.col("offset") - F.col("lo")).alias("within"))


@query("SELECT block, coalesce(arg_max_null(CASE WHEN flag = 'A' THEN NULL ELSE status END, layer) FILTER (flag <> 'N'), '0') AS value FROM (SELECT l_orderkey AS block, l_linenumber * 1000000 + l_partkey AS layer, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def layer_overlay(spark, d):
    layers = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("block"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("layer")).agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("value"))
    kind = F.when(F.col("flag") == "A", "sparse").when(F.col("flag") == "N", "in_parent").otherwise("in_file")
    return relations.overlay(layers.withColumn("kind", kind), ["block"], "layer", "value", "kind", F.lit("0")).select("block", "value")


@query("SELECT o_orderkey AS block, coalesce(a.l_shipdate, b.l_shipdate, TIMESTAMP '1970-01-01') AS value FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS l_shipdate FROM lineitem WHERE l_linenumber = 3 GROUP BY 1) a ON a.l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS l_shipdate FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) b ON b.l_orderkey = o_orderkey")
def layer_fill(spark, d):
    li = _t(spark, d, "lineitem")
    layers = [li.where(F.col("l_linenumber") == k).groupBy(F.col("l_orderkey").alias("block")).agg(F.min("l_shipdate").alias("value")) for k in (3, 1)]
    return relations.fill_layers(_t(spark, d, "orders").select(F.col("o_orderkey").alias("block")), layers, "block", "value", F.lit("1970-01-01").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000) - event_id AS chunk_size FROM events")
def chunk_sizes_lead(spark, d):
    return relations.chunk_sizes(_t(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", F.lit(1000000000).cast("long"))


@query("SELECT event_id, user_id, (coalesce(sum(event_id % 100) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS media_offset FROM events")
def running_media_offset(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 100).alias("size"))
    return relations.running_offsets(e, "user_id", "event_id", "size").select("event_id", "user_id", "media_offset")


def _edges(spark, d):
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    c = _t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


_TREE = """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
t AS (SELECT node, 0 AS level, name AS path, [name || chr(1)] AS k FROM e WHERE parent IS NULL UNION ALL SELECT e.node, level + 1, path || '/' || e.name, list_append(k, e.name || chr(1)) FROM e JOIN t ON e.parent = t.node)"""


@query(_TREE + " SELECT node, level, path FROM t")
def hierarchy_paths(spark, d):
    return relations.tree(_edges(spark, d), "node", "parent", "name").select("node", "level", "path")


@query(_TREE + " SELECT node, row_number() OVER (ORDER BY array_to_string(k, chr(2)) || chr(2) || chr(1114111)) AS position FROM t")
def hierarchy_postorder(spark, d):
    t = relations.tree(_edges(spark, d), "node", "parent", "name").select("node", F.concat("postorder_key", F.lit("\x02"), "node").alias("key"))
    return relations.numbered(t, "key", "position").select("node", "position")


@query("SELECT o_orderkey, c_name AS parent_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 7 <> 0")
def parent_ref_join(spark, d):
    c = _t(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("parent_name"))
    return _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").drop("o_custkey")


@query("SELECT o_orderkey, (o_orderkey - 1) // 1024 AS block_group, (o_orderkey - 1) % 1024 AS slot, g.n FROM orders JOIN (SELECT (o_orderkey - 1) // 1024 AS b, count(*) AS n FROM orders WHERE o_orderkey > 0 GROUP BY 1) g ON g.b = (o_orderkey - 1) // 1024 WHERE o_orderkey > 0")
def inode_group_lookup(spark, d):
    o = _t(spark, d, "orders").where("o_orderkey > 0").select("o_orderkey", F.expr("(o_orderkey - 1) div 1024").alias("block_group"), F.expr("(o_orderkey - 1) % 1024").alias("slot"))
    return o.join(o.groupBy("block_group").agg(F.count(F.lit(1)).alias("n")), "block_group").select("o_orderkey", "block_group", "slot", "n")


@query("SELECT source, count(*) AS entries, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def entry_counts(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum("n_chars").alias("bytes"))


@query("SELECT conv_id, count(*) AS forks, count(DISTINCT role) AS kinds FROM conversations GROUP BY conv_id")
def fork_counts(spark, d):
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("forks"), F.countDistinct("role").alias("kinds"))


@query("SELECT m & 61440 AS kind, count(*) AS n FROM (SELECT (event_id * 7919) % 65536 AS m FROM events) GROUP BY 1")
def filetype_histogram(spark, d):
    return _t(spark, d, "events").select((F.col("event_id") * 7919 % 65536).bitwiseAND(F.lit(61440)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exists_lookup(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_lookup(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (3, 17, 101)")
def point_lookup(spark, d):
    return _t(spark, d, "documents").where(F.col("doc_id").isin(3, 17, 101)).select("doc_id", "text")


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(source, '^src1[0-9]$') AND n_chars BETWEEN 500 AND 5000")
def find_entries(spark, d):
    return _t(spark, d, "documents").where(F.col("source").rlike("^src1[0-9]$") & F.col("n_chars").between(500, 5000)).select("doc_id", "source")


# ---- codecs --------------------------------------------------------------------------------------------------------------


def _deflated(spark, d, f):
    def typed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else f(x.encode()))

    pack = F.pandas_udf(typed, "binary")
    return _texts(spark, d).select("doc_id", pack("text").alias("packed"))


@query("SELECT doc_id, text FROM documents")
def zlib_inflate(spark, d):
    from sedira.functions import compression

    return _deflated(spark, d, zlib.compress).select("doc_id", compression.decompress(F.col("packed"), "zlib").cast("string").alias("text"))


@query("SELECT doc_id, text FROM documents")
def deflate_inflate(spark, d):
    from sedira.functions import compression

    return _deflated(spark, d, lambda x: zlib.compress(x)[2:-4]).select("doc_id", compression.decompress(F.col("packed"), "deflate").cast("string").alias("text"))


@query("SELECT doc_id, text FROM documents")
def bzip2_inflate(spark, d):
    from sedira.functions import compression

    return _deflated(spark, d, bz2.compress).select("doc_id", compression.decompress(F.col("packed"), "bzip2").cast("string").alias("text"))


# ---- flagship --------------------------------------------------------------------------------------------------------------

_DOC_SIGS = [("license", "notice", "start", 0, b"Licensed"), ("the", "english", "start", 0, b"The "), ("para", "prose", "end", 1, b"."), ("uneven", "prose", "end", 1, b"!"), ("copy", "notice", "unbound", 0, b"All rights reserved")]


@query("""WITH s AS (
  SELECT doc_id, 'notice' AS format FROM documents WHERE starts_with(text, 'Licensed') OR contains(text, 'All rights reserved')
  UNION SELECT doc_id, 'english' FROM documents WHERE starts_with(text, 'The ') UNION SELECT doc_id, 'prose' FROM documents WHERE ends_with(text, '.') OR ends_with(text, '!')),
f AS (SELECT doc_id, min(format) AS format FROM s GROUP BY 1)
SELECT d.doc_id, format, md5(text) AS md5, md5(text) || '|/' || source || '/' || d.doc_id::VARCHAR || '|' || d.doc_id::VARCHAR || '|-rw-r--r--|||' || n_chars::VARCHAR || '||||' AS line FROM documents d LEFT JOIN f USING (doc_id)""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its format by signature, MD5 and bodyfile line."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.col("text").cast("binary").alias("content"))
    found = signatures.scan(docs.select("doc_id", "content"), spark.createDataFrame(_DOC_SIGS, signatures.SCHEMA)).groupBy("doc_id").agg(F.min("format").alias("format"))
    e = docs.join(found, "doc_id", "left").withColumn("md5", digest.digest(F.col("content")))
    null = F.lit(None).cast("string")
    name = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return e.select("doc_id", "format", "md5", bodyfile.line(F.col("md5"), name, F.col("doc_id"), text.mode_string_posix(F.lit(0o100644)), null, null, F.col("n_chars"), null, null, null, null).alias("line"))


# ---- rules of formats ------------------------------------------------------------------------------------------------------


def _le(value, width):
    """Little-endian bytes of an integer column."""
    h = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*(F.unhex(F.substring(h, 2 * k + 1, 2)) for k in reversed(range(width))))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 128 ELSE 0 END::BIGINT AS flags, (p_partkey % 256)::BIGINT AS type, (p_partkey * 7)::BIGINT AS start_lba, (p_size * 1000)::BIGINT AS sectors FROM part")
def layout_mbr_entry(spark, d):
    from sedira.functions import formats

    flags = F.when(F.col("p_size") % 2 == 1, F.unhex(F.lit("80"))).otherwise(F.unhex(F.lit("00")))
    raw = F.concat(flags, F.unhex(F.lit("010203")), _le(F.col("p_partkey") % 256, 1), F.unhex(F.lit("040506")), _le(F.col("p_partkey") * 7, 4), _le(F.col("p_size").cast("long") * 1000, 4))
    return _t(spark, d, "part").select("p_partkey", binary.parse(raw, formats.MBR_ENTRY).alias("e")).select("p_partkey", "e.flags", "e.type", "e.start_lba", "e.sectors")


@query("SELECT p_partkey, substr(p_name, 1, 36) AS name, (p_partkey * 2048)::DECIMAL(20, 0) AS first_lba, (p_partkey * 2048 + p_size)::DECIMAL(20, 0) AS last_lba, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS type FROM (SELECT *, md5(p_name) AS h FROM part)")
def layout_gpt_entry(spark, d):
    from sedira.functions import formats

    uid = F.unhex(F.md5("p_name"))
    name = F.unhex(F.rpad(F.hex(F.encode(F.substring("p_name", 1, 36), "UTF-16LE")), 144, "0"))
    raw = F.concat(uid, uid, _le(F.col("p_partkey") * 2048, 8), _le(F.col("p_partkey") * 2048 + F.col("p_size"), 8), _le(F.lit(0).cast("long"), 8), name)
    return _t(spark, d, "part").select("p_partkey", binary.parse(raw, formats.GPT_ENTRY).alias("e")).select("p_partkey", "e.name", "e.first_lba", "e.last_lba", "e.type")


@query("SELECT o_orderkey, CASE WHEN c & 512 <> 0 OR i & 128960 <> 0 OR r & 888 <> 0 THEN 4 WHEN c & 4 <> 0 OR i & 12 <> 0 THEN 3 ELSE 2 END AS version FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 512 ELSE 56 END AS c, o_orderkey % 5 * 2 AS i, o_orderkey % 7 % 3 AS r FROM orders)")
def ext_version(spark, d):
    from sedira.functions import formats

    k = F.col("o_orderkey")
    c = F.when(k % 3 == 0, 4).when(k % 3 == 1, 512).otherwise(56)
    return _t(spark, d, "orders").select("o_orderkey", formats.ext_version(c, (k % 5 * 2).cast("int"), (k % 7 % 3).cast("int")).alias("version"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR n >= 65525 THEN 32 WHEN n >= 4085 THEN 16 ELSE 12 END AS bits FROM (SELECT o_orderkey, o_orderkey * 13 % 100000 AS n FROM orders)")
def fat_bits(spark, d):
    from sedira.functions import formats

    return _t(spark, d, "orders").select("o_orderkey", formats.fat_bits(F.col("o_orderkey") * 13 % 100000, F.when(F.col("o_orderkey") % 11 == 0, 2).otherwise(0)).alias("bits"))


@query("SELECT event_id, event_id::VARCHAR || '-' || (user_id % 65536)::VARCHAR AS reference FROM events")
def ntfs_reference(spark, d):
    from sedira.functions import formats

    return _t(spark, d, "events").select("event_id", formats.ntfs_reference(F.shiftleft(F.col("user_id") % 65536, 48).bitwiseOR(F.col("event_id"))).alias("reference"))


@query("SELECT o_orderkey, o_orderkey % 8 AS state, o_orderkey * 1048576 AS \"offset\", CASE WHEN o_orderkey % 8 = 6 THEN 'in_file' WHEN o_custkey % 2 = 1 AND o_orderkey % 8 = 7 THEN 'by_bitmap' WHEN o_custkey % 2 = 1 AND o_orderkey % 8 = 0 THEN 'in_parent' ELSE 'sparse' END AS kind FROM orders")
def vhdx_block(spark, d):
    from sedira.functions import formats

    e = F.shiftleft(F.col("o_orderkey"), 20).bitwiseOR(F.col("o_orderkey") % 8)
    return _t(spark, d, "orders").select("o_orderkey", formats.vhdx_block(e, F.col("o_custkey") % 2 == 1).alias("b")).select("o_orderkey", "b.state", "b.offset", "b.kind")


@query("SELECT p_partkey, CASE WHEN n < 100 THEN 'E' || lpad(n::VARCHAR, 2, '0') ELSE chr((69 + (n - 100) // 676)::INT) || chr((65 + (n - 100) % 676 // 26)::INT) || chr((65 + (n - 100) % 26)::INT) END AS segment FROM (SELECT p_partkey, p_partkey % 14000 + 1 AS n FROM part)")
def segment_names(spark, d):
    from sedira.functions import formats

    return _t(spark, d, "part").select("p_partkey", formats.segment_name(F.lit("E01"), F.col("p_partkey") % 14000 + 1).alias("segment"))


@query("SELECT p_partkey, p_name AS name, p_size::BIGINT AS size FROM part")
def plist_values(spark, d):
    from sedira.functions import formats

    xml = F.concat(F.lit('<?xml version="1.0"?><plist version="1.0"><dict><key>name</key><string>'), F.col("p_name"), F.lit("</string><key>band-size</key><integer>"), F.col("p_size").cast("string"), F.lit("</integer></dict></plist>"))
    j = _t(spark, d, "part").select("p_partkey", formats.plist(xml.cast("binary")).alias("j"))
    return j.select("p_partkey", F.get_json_object("j", "$.name").alias("name"), F.get_json_object("j", "$['band-size']").cast("long").alias("size"))


@query("SELECT event_id, list_filter([CASE WHEN f & 1 <> 0 THEN 'is valid' END, CASE WHEN f & 2 <> 0 THEN 'is allocated' END, CASE WHEN f & 4 <> 0 THEN 'is in use' END, CASE WHEN f & 8 <> 0 THEN 'is bootable' END, CASE WHEN f & 16 <> 0 THEN 'is readable' END, CASE WHEN f & 32 <> 0 THEN 'is writable' END], lambda x: x IS NOT NULL) AS flags FROM (SELECT event_id, event_id % 64 AS f FROM events)")
def flag_names(spark, d):
    from sedira.operators import reports
    from sedira.sources.volumes import APM_FLAGS

    return _t(spark, d, "events").select("event_id", reports.flag_names(F.col("event_id") % 64, APM_FLAGS).alias("flags"))


def _codec(name: str):
    """Whole texts, packed with matches by functions.packers, come out again."""

    def run(spark, d):
        from sedira.functions import compression, packers

        pack = getattr(packers, name)

        @F.pandas_udf("binary")
        def packed(v: pd.Series) -> pd.Series:
            return v.map(lambda x: None if x is None else pack(x.encode()))

        size = F.octet_length("text").cast("long")
        return _texts(spark, d).select("doc_id", compression.decompress(packed("text"), name, size).cast("string").alias("text"))

    run.__name__ = f"{name}_decode"
    query("SELECT doc_id, text FROM documents")(run)


for _name in ("adc", "lznt1", "lzvn", "lzfse", "lzxpress", "lzxpress_huffman"):
    _codec(_name)


# ---- the catalog of signatures -----------------------------------------------------------------------------------------------

_CATALOG = ", ".join(f"({k}, '{r[0]}', '{r[1]}', {r[3]}, {r[2] == 'end'})" for k, r in enumerate(signatures.CATALOG))


@query(f"SELECT doc_id, identifier, format, CASE WHEN at_end THEN 8192 + octet_length(encode(text)) - pos ELSE pos END::BIGINT AS position FROM documents JOIN (VALUES {_CATALOG}) t(k, identifier, format, pos, at_end) ON k = doc_id % {len(signatures.CATALOG)}")
def signature_catalog(spark, d):
    """Blobs of zeros around each text, with one signature of the catalog in its place."""
    known = spark.createDataFrame([(k, r[2] == "end", r[3], bytes.fromhex(r[4])) for k, r in enumerate(signatures.CATALOG)], "k long, at_end boolean, at int, pattern binary")
    zeros = lambda n: F.unhex(F.repeat(F.lit("00"), n))
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("body"), (F.col("doc_id") % len(signatures.CATALOG)).alias("k")).join(F.broadcast(known), "k")
    n = F.octet_length("pattern")
    front = F.concat(zeros(F.col("at")), F.col("pattern"), zeros(F.lit(6000) - F.col("at") - n), F.col("body"), zeros(F.lit(2192)))
    back = F.concat(zeros(F.lit(6000)), F.col("body"), zeros(F.lit(2192) - F.col("at")), F.col("pattern"), zeros(F.col("at") - n))
    blobs = docs.select("doc_id", F.when(F.col("at_end"), back).otherwise(front).alias("content"))
    return signatures.scan(blobs, signatures.catalog(spark)).select("doc_id", "identifier", "format", "position")


from sedira.plans import media  # noqa: E402, F401  it registers its queries here
