import hashlib

import pytest

from sedira import cli
from sedira.operators import reports
from sedira.sources import datasources
from sedira.streaming import folders
from sedira.sources import writers as imagery

FILES = {"testfile1": b"ceramics\n", "other": b"x" * 5000}


@pytest.fixture(scope="module")
def disk(spark, tmp_path_factory):
    datasources.register(spark)
    d = tmp_path_factory.mktemp("disk")
    raw = imagery.mbr([(7, imagery.ntfs(FILES, {"testfile1": {"ads": b"abc"}}, {})), (0x83, imagery.ext2(FILES, {"link": "testfile1"}))])
    for k, data in enumerate(imagery.ewf(raw, hashlib.md5(raw).digest(), 1), 1):
        (d / f"disk.E{k:02d}").write_bytes(data)
    return str(d / "disk.E01")


def test_reports(spark, disk):
    v = reports.volume_report(spark, disk).orderBy("idx").collect()
    assert [(r["type_id"], r["name"], r["size_text"], r["flags"]) for r in v] == [("0x07", "HPFS/NTFS", "45.0 KiB", ["is active"]), ("0x83", "Linux", "19.0 KiB", [])]
    i = {r["key"]: r["value"] for r in reports.image_report(spark, disk).collect()}
    assert i["format"] == "ewf" and i["description"] == "an image" and "stored_md5" in i
    f = {(r["volume"], r["key"]): r["value"] for r in reports.file_system_report(spark, disk).collect()}
    assert f[1, "label"] == "ntfs_test" and f[2, "version"] == "ext2"
    e = reports.entry_report(spark, disk, identifier="11-11").collect()
    assert [(r["name"], r["attribute_names"]) for r in e] == [("testfile1", ["archive"])]
    a = [(r["volume"], r["kind"], r["name"], r["resident"], int(r["size"])) for r in reports.attribute_report(spark, disk, "11-11").collect()]
    assert a == [(1, "0x10", None, True, 48), (1, "0x30", None, True, 84), (1, "0x80", None, True, 9), (1, "0x80", "ads", True, 3), (2, "data", None, False, 9)]
    assert {r["volume"] for r in reports.entry_report(spark, disk, display_path="/other").collect()} == {1, 2}
    assert [r["verified"] for r in reports.verify_report(spark, disk).collect()] == [True]


def test_command_line(spark, disk, tmp_path):
    lines = [r[0] for r in cli.run(spark, ["image", disk, "bodyfile", "--md5"]).collect()]
    m = hashlib.md5(FILES["testfile1"]).hexdigest()
    assert f"{m}|/p1/testfile1|11-11|-rwxrwxrwx|||9|1281647191.5468753|1281647191.5468751|1281647191.5468752|1281647191.5468750" in lines
    assert f"{hashlib.md5(b'abc').hexdigest()}|/p1/testfile1:ads|11-11|-rwxrwxrwx|||3|1281647191.5468753|1281647191.5468751|1281647191.5468752|1281647191.5468750" in lines
    assert f"{m}|/p2/testfile1|11|-rw-r--r--|1000|100|9|1281643591|1281643593|1281643592|" in lines
    assert any("|/p2/link -> testfile1|" in x for x in lines)
    got = {tuple(r) for r in cli.run(spark, ["hash", disk]).collect()}
    assert (m, "/p1/testfile1") in got and (hashlib.md5(b"abc").hexdigest(), "/p1/testfile1:ads") in got
    (tmp_path / "plain.txt").write_bytes(b"plain text")
    assert cli.run(spark, ["hash", str(tmp_path / "plain.txt"), "--digest", "sha1"]).collect()[0][0] == hashlib.sha1(b"plain text").hexdigest()
    assert cli.run(spark, ["export", disk, "/testfile1", str(tmp_path / "out")]) == 3
    assert (tmp_path / "out" / "1_testfile1_ads").read_bytes() == b"abc"
    cli.run(spark, ["hash", disk, "--output", str(tmp_path / "list")])
    assert f"{m}  /p1/testfile1" in spark.read.text(str(tmp_path / "list")).toPandas()["value"].tolist()
    assert cli.run(spark, ["info", disk, "hierarchy"]).count() == 3 + 4
    assert cli.run(spark, ["info", disk, "path", "/link"]).collect()[0]["link_target"] == "testfile1"


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.qcow2").write_bytes(imagery.qcow2(b"x" * 65536))
    (tmp_path / "in" / "b.vhd").write_bytes(imagery.vhd(b"y" * 4096, 2))
    (tmp_path / "in" / "c.vhd").write_bytes(imagery.vhd(b"y" * 4096, 2))
    s = folders.first_seen(folders.arrivals(spark, str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("drop_folder").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("drop_folder").collect()
    assert sorted(r["formats"][0] for r in rows) == ["qcow", "vhd"]
