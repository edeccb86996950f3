"""Every query of the catalog against its SQL, on the smallest tables."""

import glob
import os
from decimal import Decimal

import pytest

from sedira.plans import catalog

DATA = os.environ.get("SEDIRA_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return int(v) if isinstance(v, Decimal) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert got == sorted(repr(tuple(plain(r[at[c]]) for c in columns)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, name):
    """Those that SQL does not express: held against the standard library here."""
    import hashlib
    import zlib

    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in catalog.queries()[name](spark, DATA).collect()}
    from tests.test_functions import crc_by_bits

    want = {
        "digest_sha224": ("digest", lambda b: hashlib.sha224(b).hexdigest()), "digest_sha512": ("digest", lambda b: hashlib.sha512(b).hexdigest()), "checksum_crc32": ("crc32", zlib.crc32), "checksum_crc32_of_chunks": ("crc32", zlib.crc32),
        "checksum_crc32c": ("crc32c", lambda b: crc_by_table(b, 0x82F63B78, True)), "checksum_crc32_forward": ("crc32", lambda b: crc_by_table(b, 0x04C11DB7, False)), "hexdump": ("dump", dumped),
    }
    column, f = want[name]
    assert len(rows) == (len(texts) if name != "checksum_crc32_of_chunks" else sum(map(bool, texts.values())))
    for k, b in texts.items():
        if k in rows and (b or name.startswith("digest")):
            assert rows[k][column] == f(b)


def crc_by_table(data, polynomial, mirrored):
    """From checksums of single bytes, by bits."""
    from tests.test_functions import crc_by_bits

    last = 0xFFFFFFFF
    # the checksum of one byte b, from a start of s: only s ^ b matters, so 256 values say it all
    table = []
    for b in range(256):
        c = b if mirrored else b << 24
        for _ in range(8):
            if mirrored:
                c = c >> 1 ^ (polynomial if c & 1 else 0)
            else:
                c = (c << 1 ^ (polynomial if c >> 31 else 0)) & last
        table.append(c)
    c = last
    for b in data:
        c = table[(c ^ b) & 255] ^ c >> 8 if mirrored else table[c >> 24 ^ b] ^ c << 8 & last
    assert len(data) > 40 or c ^ last == crc_by_bits(data, polynomial, mirrored)
    return c ^ last


def dumped(data):
    """A dump of 16 bytes a line; full lines that repeat the one before are folded to one line of dots, but not the last full one."""
    lines = [data[k : k + 16] for k in range(0, len(data), 16)]
    out = []
    for k, line in enumerate(lines):
        if 0 < k < len(data) // 16 - 1 and line == lines[k - 1]:
            if out[-1] != "...":
                out.append("...")
            continue
        cells = [f"{b:02x} " for b in line] + ["   "] * (16 - len(line))
        out.append(f"{16 * k:08x}  {''.join(cells[:8])} {''.join(cells[8:])} " + "".join(chr(b) if 32 <= b < 127 else "." for b in line))
    return "".join(f"{x}\n" for x in out) + "\n"


def test_base64_strict_takes_whole_texts(spark, tmp_path, monkeypatch):
    """What is decoded is all of a long text."""
    from pyspark.sql import functions as F

    whole = catalog.codec.base64_decode
    monkeypatch.setattr(catalog.codec, "base64_decode", lambda c: F.when(F.length(whole(c)) >= 300_000, c))
    spark.createDataFrame([(3, "héllo " * 50_000), (5, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["valid"] for r in catalog.queries()["base64_strict"](spark, str(tmp_path)).collect()}
    assert got == {3: True, 5: False}


@pytest.mark.parametrize("name", ["codepage_windows1250", "codepage_koi8_r", "codepage_mac_celtic", "lznt1_decode", "lzxpress_decode", "lzxpress_huffman_decode", "bzip2_inflate"])
def test_texts_are_dealt_out_in_bounded_batches(spark, tmp_path, name):
    """One file of one row group is no task for one core alone, and Python gets some of its rows at a time."""
    for setting in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{setting}")
    rows = [(k, "a plain text " * (k % 7)) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()[name](spark, str(tmp_path))
    assert {(r["doc_id"], r["text"]) for r in df.collect()} == set(rows)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1500
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 8 << 20
    sizes = [sum(1 for _ in part) for part in df.rdd.glom().collect()]
    assert len(sizes) >= 4 and max(sizes) < 200
