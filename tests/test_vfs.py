import pytest

from sedira.vfs import Location, Resolver
from sedira.sources import writers as imagery


def test_resolver(spark, tmp_path):
    (tmp_path / "d.qcow2").write_bytes(imagery.qcow2(imagery.mbr([(7, imagery.ntfs({"a.txt": b"text"}, {"a.txt": {"s": b"more"}}, {})), (1, imagery.fat12({"dir/b.txt": b"b"}))])))
    r = Resolver(spark)
    disk = Location.base(str(tmp_path / "d.qcow2")).layer("QCOW", "/qcow1")
    first = disk.layer("MBR", "/mbr1")
    assert first.volume == 1 and first.parent == disk and disk.volume is None
    assert [x["name"] for x in r.entries(first.layer("NTFS", "/a.txt")).collect()] == ["a.txt"]
    assert r.exists(disk.layer("MBR", "/mbr2").layer("FAT", "/dir/b.txt")) and not r.exists(first.layer("NTFS", "/none"))
    assert [bytes(x["content"]) for x in r.data(first.layer("NTFS", "/a.txt"), "s").collect()] == [b"more"]
    assert [x["name"] for x in r.children(disk.layer("MBR", "/mbr2").layer("FAT", "/")).collect()] == ["dir"]
    assert r.entries(disk).count() == 2 + 3
    assert r.scan(disk.layers[0][1]).count() == 6
    with pytest.raises(ValueError):
        Location.base("/x", "ZFS")
