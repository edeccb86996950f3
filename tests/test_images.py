"""Images, volumes and file systems written by sources.writers, read by the data sources and by the readers."""

import hashlib
import os
import random
import zlib

import pytest

from sedira.sources import datasources, images
from sedira.sources.ext import Ext
from sedira.sources.fat import Fat
from sedira.sources.ntfs import Ntfs, open_file_system
from sedira.sources.streams import Block, BlockStream, BytesStream, RangeStream
from sedira.sources.volumes import read_apm, read_gpt, read_mbr, read_volumes
from sedira.sources import writers as imagery

RNG = random.Random(4)
LICENSE = b"".join(b"line %d of a text that repeats itself, line %d\n" % (k, k) for k in range(300))
FILES = {"emptyfile": b"", "testfile1": b"ceramics\n", "TestFile2": LICENSE, "a long file name with spaces.text": RNG.randbytes(3000)}


@pytest.fixture(scope="module")
def media():
    return imagery.fat12(FILES | {"testdir1/nested.txt": b"nested content", "big": RNG.randbytes(900_000)})


def md5(data):
    return hashlib.md5(data).hexdigest()


# ---- file systems ----


def names(fs):
    return {"/".join(e.path): e for e in fs.walk()}


def test_fat(media):
    fs = open_file_system(BytesStream(media))
    assert isinstance(fs, Fat) and fs.bits == 12
    got = names(fs)
    for name, content in (FILES | {"testdir1/nested.txt": b"nested content"}).items():
        assert got["/" + name].data.read_all() == content
    assert fs.info["label"] == "TESTFAT"
    assert list(got)[-1] == "" and list(got).index("/testdir1/nested.txt") < list(got).index("/testdir1")
    assert fs.by_path("/TESTDIR1/NESTED.TXT").name == "nested.txt" and fs.by_path("/none") is None
    assert fs.by_identifier(got["/testfile1"].identifier).name == "testfile1"
    assert got["/testfile1"].mtime.ticks == (43 << 9 | 6 << 5 | 18) << 16 | 12 << 11 | 34 << 5 | 28


def test_ext():
    sparse = LICENSE[:3000] + bytes(30_000) + b"end"
    fs = open_file_system(BytesStream(imagery.ext2(FILES | {"sparse": sparse}, {"link": "testfile1", "long": "x" * 59})))
    assert isinstance(fs, Ext) and fs.version == 2 and fs.info["label"] == "ext2_test"
    got = names(fs)
    for name, content in (FILES | {"sparse": sparse}).items():
        e = got["/" + name]
        assert e.data.read_all() == content and e.mode == 0o100644 and (e.owner_id, e.group_id) == (1000, 100)
    assert got["/link"].link_target == "testfile1" and got["/long"].link_target == "x" * 59
    assert got["/testfile1"].mtime.ticks == 1281643593 and got["/testfile1"].btime is None
    assert [e.name for e in fs.children(fs.root())] == sorted([*FILES, "sparse", "link", "long"])
    assert fs.by_identifier("12").name == "" and fs.by_identifier("999") is None


def lznt1_stored(data):
    return b"".join((len(p) - 1 | 0x3000).to_bytes(2, "little") + p for p in (data[k : k + 4096] for k in range(0, len(data), 4096)))


@pytest.mark.parametrize("many", [0, 12])
def test_ntfs(many):
    content = (b"0123456789abcdef" * 256) * 2
    # a chunk of literals and one long match: sixteen bytes, then a match back by 16
    bits = 4
    head = bytes([0]) + content[:8] + bytes([0]) + content[8:16]
    chunk = head + bytes([1]) + ((16 - 1) << 16 - bits - 0 & 0xFFFF | (4096 - 16 - 3) & 0xFFF).to_bytes(2, "little")
    packed = ((len(chunk) - 1 | 0xB000).to_bytes(2, "little") + chunk) * 2
    files = FILES | {f"more{k}": b"%d" % k for k in range(many)}
    raw = imagery.ntfs(files, {"testfile1": {"stream": b"hidden"}}, {"packed": (content, packed)})
    fs = open_file_system(BytesStream(raw))
    assert isinstance(fs, Ntfs) and fs.info["label"] == "ntfs_test" and fs.info["version"] == "3.1"
    got = names(fs)
    assert {n.strip("/") for n in got} == {"", "packed", *files}
    for name, x in files.items():
        assert got["/" + name].data.read_all() == x
    assert got["/packed"].data.read_all() == content and got["/packed"].data.read_at(5000, 20) == content[5000:5020]
    assert [(f.name, f.stream.read_all()) for f in got["/testfile1"].forks] == [(None, FILES["testfile1"]), ("stream", b"hidden")]
    assert (got["/testfile1"].btime.kind, got["/testfile1"].btime.ticks) == ("filetime", 0x01CB3A623D0A17CE)
    assert fs.by_path("/TESTFILE1").identifier == "12-12"
    assert fs.names(12)[0][1:3] == ("testfile1", 3)


# ---- volumes ----


def test_mbr(media):
    raw = imagery.mbr([(1, media), (0x83, b"x" * 1024)], [(7, b"a" * 512), (6, b"b" * 1500)])
    v = read_mbr(BytesStream(raw))
    assert [(x.type_id, x.size) for x in v] == [("0x01", len(media)), ("0x83", 1024), ("0x07", 512), ("0x06", 1536)]
    assert v[0].stream(BytesStream(raw)).read_all() == media and v[3].stream(BytesStream(raw)).read_all()[:1500] == b"b" * 1500
    assert v[0].flags == 0x80 and v[0].disk_identifier == "0x0000cafe"
    assert read_volumes(BytesStream(media)) == []


@pytest.mark.parametrize("sector", [512, 4096])
def test_gpt(media, sector):
    raw = imagery.gpt([("ebd0a0a2-b9e5-4433-87c0-68b6b72699c7", "first", media), ("0fc63daf-8483-4772-8e79-3d69d8477de4", "zweite ß", b"x" * 5000)], sector)
    v = read_volumes(BytesStream(raw))
    assert [(x.scheme, x.name, x.bytes_per_sector) for x in v] == [("gpt", "first", sector), ("gpt", "zweite ß", sector)]
    assert v[0].stream(BytesStream(raw)).read_at(0, len(media)) == media
    assert v[0].type_id.startswith("ebd0a0a2") and v[1].identifier.endswith("000002")
    with pytest.raises(ValueError):
        read_gpt(BytesStream(raw[: 3 * sector - 100] + b"?" + raw[3 * sector - 99 :]))


def test_apm(media):
    raw = imagery.apm([("Apple_HFS", "disk image", media)])
    v = read_volumes(BytesStream(raw))
    assert [(x.type_id, x.name) for x in v] == [("Apple_partition_map", "Apple"), ("Apple_HFS", "disk image")]
    assert v[1].stream(BytesStream(raw)).read_all() == media
    with pytest.raises(ValueError):
        read_apm(BytesStream(media))


# ---- images: one medium in many containers reads alike ----


@pytest.fixture(scope="module")
def folder(media, tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    put = lambda name, data: (d / name).write_bytes(data)
    media = media.ljust(-(-len(media) // 65536) * 65536, b"\0")
    put("raw.dd", media)
    for k in range(3):
        put(f"split.{k + 1:03d}", media[k * 400_000 : (k + 1) * 400_000 if k < 2 else None])
    put("v2.qcow2", imagery.qcow2(media, 2))
    put("v3.qcow2", imagery.qcow2(media, 3, packed={0, 1}))
    changed = bytearray(media)
    changed[:512] = bytes(512)
    put("base.qcow2", imagery.qcow2(bytes(changed)))
    put("layer.qcow2", imagery.qcow2(media, 2, "base.qcow2", {0}))
    put("fixed.vhd", imagery.vhd(media, 2))
    put("dynamic.vhd", imagery.vhd(media, 3))
    put("parent.vhd", imagery.vhd(bytes(changed), 3, identifier=9))
    put("differential.vhd", imagery.vhd(media, 4, ("parent.vhd", bytes(15) + b"\x09"), {0, 3}))
    put("image.vhdx", imagery.vhdx(media))
    put("image.sparseimage", imagery.sparseimage(media))
    put("zlib.dmg", imagery.udif(media, 0x80000005, zlib.compress))
    import bz2

    put("bzip2.dmg", imagery.udif(media, 0x80000006, bz2.compress))
    adc = lambda x: b"".join(bytes([0x7F + len(p)]) + p for p in (x[k : k + 128] for k in range(0, len(x), 128)))
    put("adc.dmg", imagery.udif(media, 0x80000004, adc))
    lzvn = lambda x: b"".join(bytes([0xE0, len(p) - 16]) + p if len(p) > 15 else bytes([0xE0 | len(p)]) + p for p in (x[k : k + 256] for k in range(0, len(x), 256))) + b"\x06" + bytes(7)
    import struct

    def lzfse(x):
        raw = lzvn(x)
        return b"bvxn" + struct.pack("<II", len(x), len(raw)) + raw + b"bvx$"

    put("lzfse.dmg", imagery.udif(media, 0x80000007, lzfse))
    for k, data in enumerate(imagery.ewf(media, hashlib.md5(media).digest()), 1):
        put(f"image.E{k:02d}", data)
    put("bad.qcow2", imagery.qcow2(media[:65536])[:32] + b"\0\0\0\1" + imagery.qcow2(media[:65536])[36:])
    b = d / "bundle.sparsebundle"
    (b / "bands").mkdir(parents=True)
    (b / "Info.plist").write_bytes(b'<?xml version="1.0"?><plist version="1.0"><dict><key>band-size</key><integer>100000</integer><key>size</key><integer>%d</integer></dict></plist>' % len(media))
    for k in range(-(-len(media) // 100_000)):
        if any(part := media[k * 100_000 : (k + 1) * 100_000]):
            (b / "bands" / f"{k:x}").write_bytes(part)
    return str(d), media


ALL = ["raw.dd", "split.001", "v2.qcow2", "v3.qcow2", "layer.qcow2", "fixed.vhd", "dynamic.vhd", "differential.vhd", "image.vhdx", "image.sparseimage", "zlib.dmg", "bzip2.dmg", "adc.dmg", "lzfse.dmg", "image.E01", "bundle.sparsebundle"]


@pytest.mark.parametrize("name", ALL)
def test_containers_read_alike(folder, name):
    d, media = folder
    i = images.open_any(os.path.join(d, name))
    assert i.media.size == len(media)
    assert md5(i.media.read_all()) == md5(media)
    for _ in range(20):
        at = RNG.randrange(len(media))
        assert i.media.read_at(at, 700) == media[at : at + 700]
    assert i.layers == (2 if name in ("layer.qcow2", "differential.vhd") else 1)


def test_ewf_header(folder):
    d, media = folder
    i = images.open_ewf(f"{d}/image.E01")
    assert i.stored["md5"] == md5(media) and i.info["case_number"] == "007" and i.info["examiner_name"] == "me"
    assert [images.ewf_segment_name("E01", n) for n in (1, 99, 100, 101, 126, 775, 776)] == ["E01", "E99", "EAA", "EAB", "EBA", "EZZ", "FAA"]
    assert images.ewf_segment_name("s01", 100) == "saa"


def test_streams():
    s = BlockStream([Block(10, 5, 2, 5), Block(20, 4, kind="in_parent")], [BytesStream(b"..hello..")], 30, BytesStream(bytes(range(64))))
    assert s.read_all() == bytes(10) + b"hello" + bytes(5) + bytes([20, 21, 22, 23]) + bytes(6)
    with pytest.raises(ValueError):
        RangeStream(BytesStream(b"abc"), 3)


# ---- data sources ----


@pytest.fixture(scope="module")
def sources(spark):
    datasources.register(spark)
    return lambda kind, path, **o: spark.read.format(kind).options(path=path, **o).load()


def test_sources(spark, sources, folder, tmp_path):
    d, media = folder
    disk = imagery.gpt([("ebd0a0a2-b9e5-4433-87c0-68b6b72699c7", "fat", media), ("0fc63daf-8483-4772-8e79-3d69d8477de4", "ext", imagery.ext2(FILES, {"link": "testfile1"})), ("ebd0a0a2-b9e5-4433-87c0-68b6b72699c7", "ntfs", imagery.ntfs(FILES, {"testfile1": {"ads": b"x"}}, {}))])
    path = str(tmp_path / "disk.qcow2")
    (tmp_path / "disk.qcow2").write_bytes(imagery.qcow2(disk))
    assert [(r["scheme"], r["idx"], r["name"]) for r in sources("volumes", path).orderBy("idx").collect()] == [("gpt", 1, "fat"), ("gpt", 2, "ext"), ("gpt", 3, "ntfs")]
    e = sources("file_entries", path, with_md5="true")
    rows = {(r["volume"], r["display_path"]): r for r in e.collect()}
    for k in (1, 2, 3):
        for name, content in FILES.items():
            assert rows[k, "/" + name]["md5"] == md5(content) and rows[k, "/" + name]["size"] == len(content)
        assert rows[k, "/"]["is_root"] and rows[k, "/"]["md5"] == "0" * 32
    assert rows[2, "/link"]["link_target"] == "testfile1" and rows[2, "/link"]["mode_string"] == "lrwxrwxrwx"
    assert [x["vfs_type"] for x in rows[3, "/testfile1"]["layers"]] == ["OS", "QCOW", "GPT", "NTFS"]
    assert e.where("display_path = '/testfile1'").count() == 3
    assert e.where("identifier = '12-12'").select("name").collect()[0][0] == "testfile1"
    forks = sources("data_forks", path, digest="sha256", with_content="true").where("fork_name = 'ads'").collect()
    assert [(r["display_path"], bytes(r["content"]), r["digest"]) for r in forks] == [("/testfile1", b"x", hashlib.sha256(b"x").hexdigest())]
    assert {r["format"] for r in sources("file_systems", path).collect()} == {"fat", "ext", "ntfs"}
    nodes = sources("scan_nodes", path).collect()
    assert sorted(r["vfs_type"] for r in nodes) == ["EXT", "FAT", "GPT", "GPT", "GPT", "NTFS", "OS", "QCOW"]
    from sedira.operators import relations

    t = relations.tree(spark.createDataFrame([(r["node_id"], r["parent_id"], r["location"].split("/")[-1]) for r in nodes], "n string, p string, l string"), "n", "p", "l", "n")
    assert t.count() == 8


def test_image_sources(spark, sources, folder):
    from sedira.operators import relations

    d, media = folder
    info = {os.path.basename(r["path"]): r for r in sources("image_info", d).collect()}
    assert info["image.E01"]["stored"]["md5"] == md5(media) and info["differential.vhd"]["layers"] == 2
    assert info["image.E02"]["stored"]["md5"] == md5(media)  # any segment opens the set
    assert info["bad.qcow2"]["_error"] and info["bundle.sparsebundle"]["format"] == "sparsebundle"
    with pytest.raises(Exception, match="encrypted"):
        sources("image_info", f"{d}/bad.qcow2", mode="FAILFAST").collect()
    chunks = sources("image_chunks", f"{d}/v*.qcow2", chunk="100000", per_partition="2")
    assert {(r["path"][-8:], r["size"], r["md5"]) for r in relations.stream_digests(chunks, ("md5",), "path").collect()} == {("v2.qcow2", len(media), md5(media)), ("v3.qcow2", len(media), md5(media))}
    blob = sources("blob_chunks", f"{d}/raw.dd", chunk="65536", offset="512")
    assert relations.stream_digests(blob, ("sha1",), "path").collect()[0]["sha1"] == hashlib.sha1(media[512:]).hexdigest()
    bm = sources("block_map", f"{d}/layer.qcow2")
    assert bm.where("layer = 0 and kind = 'in_file'").count() == 1 and bm.where("layer = 1").count() > 1
    from sedira.operators import signatures
    from pyspark.sql import functions as F

    found = signatures.scan(sources("head_tail", d).select("path", "length", "content"), signatures.catalog(spark), size=F.col("length"))
    got = {os.path.basename(r["path"]): r["format"] for r in signatures.cascade(found, ["path"]).collect()}
    assert (got["v3.qcow2"], got["fixed.vhd"], got["zlib.dmg"], got["image.E02"], got["image.vhdx"], got["raw.dd"], got["image.sparseimage"]) == ("qcow", "vhd", "udif", "ewf", "vhdx", "fat", "sparseimage")


def test_os_entries(spark, sources, folder):
    d, _ = folder
    rows = {r["name"]: r for r in sources("os_entries", d).collect()}
    assert rows["raw.dd"]["file_type"] == "file" and rows["bands"]["file_type"] == "directory" and rows["raw.dd"]["mtime"]["ts"] is not None


def test_bodyfile_of_an_image(spark, sources, folder, tmp_path):
    from sedira.operators import bodyfile

    d, _ = folder
    e = sources("file_entries", f"{d}/raw.dd", with_md5="true")
    rows = [r["value"] for r in bodyfile.lines(e, e["md5"]).collect()]
    line = next(r for r in rows if "/testfile1|" in r)
    assert line.startswith(f"{md5(FILES['testfile1'])}|/testfile1|0x") and line.endswith("|-rwxrwxrwx|||9||||")
    bodyfile.write(bodyfile.lines(e), str(tmp_path / "out"))
    assert bodyfile.HEADER in open(next((tmp_path / "out" / "header").glob("part*"))).read()
