"""Volume systems: APM, GPT, MBR partitions of a medium."""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

from sedira.sources.streams import RangeStream, Stream

SECTORS = (512, 1024, 2048, 4096)


@dataclass
class Volume:
    scheme: str
    index: int
    offset: int
    size: int
    type_id: str = ""
    identifier: str = ""
    name: str = ""
    flags: int = 0
    bytes_per_sector: int = 512
    disk_identifier: str = ""

    def stream(self, media: Stream) -> Stream:
        return RangeStream(media, self.offset, self.size)


def read_apm(media: Stream) -> list[Volume]:
    """The partition map starts in the second block, whose size the first says."""
    block = 512
    if media.read_at(0, 2) == b"ER":
        block, = struct.unpack(">H", media.read_at(2, 2))
    entry = media.read_at(512, 512)
    if entry[:2] != b"PM":
        raise ValueError("no partition map")
    total, = struct.unpack_from(">I", entry, 4)
    out = []
    for k in range(total):
        e = media.read_at(512 * (k + 1), 512)
        if e[:2] != b"PM":
            raise ValueError(f"damaged entry {k}")
        start, n = struct.unpack_from(">II", e, 8)
        text = lambda a, b, e=e: e[a:b].split(b"\0")[0].decode("ascii", "replace")
        out.append(Volume("apm", k + 1, start * block, n * block, text(48, 80), "", text(16, 48), struct.unpack_from(">I", e, 88)[0], block))
    return out


def read_gpt(media: Stream, sector: int | None = None) -> list[Volume]:
    """Sector sizes are tried in turn unless given. The header's and the entries' checksums are verified; the backup header is read if the first is damaged."""
    for size in [sector] if sector else SECTORS:
        for at in (size, media.size - size):
            h = media.read_at(at, 92)
            if h[:8] == b"EFI PART" and zlib.crc32(h[:16] + b"\0\0\0\0" + h[20:92]) == struct.unpack_from("<I", h, 16)[0]:
                return _gpt(media, h, size)
    raise ValueError("no partition table")


def _gpt(media: Stream, h: bytes, sector: int) -> list[Volume]:
    disk = str(uuid.UUID(bytes_le=h[56:72]))
    lba, n, width, crc = struct.unpack_from("<QIII", h, 72)
    if width != 128:
        raise ValueError(f"entries of {width} bytes")
    raw = media.read_at(lba * sector, n * width)
    if zlib.crc32(raw) != crc:
        raise ValueError("the entries' checksum does not fit")
    out = []
    for k in range(n):
        e = raw[128 * k : 128 * k + 128]
        if not any(e[:16]):
            continue
        first, last, flags = struct.unpack_from("<QQQ", e, 32)
        out.append(Volume("gpt", len(out) + 1, first * sector, (last - first + 1) * sector, str(uuid.UUID(bytes_le=e[:16])), str(uuid.UUID(bytes_le=e[16:32])), e[56:].decode("utf-16-le").split("\0")[0], flags, sector, disk))
    return out


def read_mbr(media: Stream, sector: int | None = None) -> list[Volume]:
    """Four primary entries, then the chain of extended records. The sector size is where the extended record's mark is found."""
    h = media.read_at(0, 512)
    if h[510:512] != b"\x55\xaa":
        raise ValueError("no master boot record")
    entry = lambda raw, k: (raw[446 + 16 * k], raw[450 + 16 * k], *struct.unpack_from("<II", raw, 454 + 16 * k))
    first = [entry(h, k) for k in range(4)]
    extended = next((e for e in first if e[1] in (5, 15)), None)
    if sector is None:
        sector = 512
        if extended:
            sector = next((s for s in SECTORS if media.read_at(extended[2] * s + 510, 2) == b"\x55\xaa"), 512)
    disk = f"0x{struct.unpack_from('<I', h, 440)[0]:08x}"
    out: list[Volume] = []

    def add(e: tuple, base: int) -> None:
        out.append(Volume("mbr", len(out) + 1, (base + e[2]) * sector, e[3] * sector, f"0x{e[1]:02x}", "", MBR_TYPES.get(e[1], ""), e[0], sector, disk))

    for e in first:
        if e[1] and e[1] not in (5, 15):
            add(e, 0)
    at, seen = (extended[2] if extended else 0), set()
    while at and at not in seen:
        seen.add(at)
        raw = media.read_at(at * sector, 512)
        if raw[510:512] != b"\x55\xaa":
            raise ValueError("damaged extended record")
        follow = 0
        for k in range(4):
            e = entry(raw, k)
            if e[1] in (5, 15):
                follow = extended[2] + e[2]
            elif e[1]:
                add(e, at)
        at = follow
    return out


#: Names of common partition types.
MBR_TYPES = {
    0x01: "FAT12", 0x04: "FAT16 < 32M", 0x05: "Extended", 0x06: "FAT16", 0x07: "HPFS/NTFS", 0x0B: "FAT32", 0x0C: "FAT32 (LBA)", 0x0E: "FAT16 (LBA)", 0x0F: "Extended (LBA)",
    0x11: "Hidden FAT12", 0x14: "Hidden FAT16 < 32M", 0x16: "Hidden FAT16", 0x17: "Hidden HPFS/NTFS", 0x1B: "Hidden FAT32", 0x1C: "Hidden FAT32 (LBA)", 0x1E: "Hidden FAT16 (LBA)",
    0x27: "Windows recovery", 0x42: "Dynamic disk", 0x82: "Linux swap", 0x83: "Linux", 0x85: "Linux extended", 0x8E: "Linux LVM", 0xA5: "FreeBSD", 0xA6: "OpenBSD", 0xA8: "Mac OS X",
    0xA9: "NetBSD", 0xAB: "Mac OS X boot", 0xAF: "HFS/HFS+", 0xBE: "Solaris boot", 0xBF: "Solaris", 0xEE: "GPT protective", 0xEF: "EFI system", 0xFB: "VMware VMFS", 0xFD: "Linux RAID",
}
#: Status bits of an APM entry.
APM_FLAGS = {
    0x1: "is valid", 0x2: "is allocated", 0x4: "is in use", 0x8: "is bootable", 0x10: "is readable", 0x20: "is writable", 0x40: "boot code is position independent",
    0x100: "has a chain-compatible driver", 0x200: "has a real driver", 0x400: "has a chain driver", 0x40000000: "is mounted at startup", 0x80000000: "is the startup partition",
}


def read_volumes(media: Stream) -> list[Volume]:
    """APM or GPT by signature, else MBR unless a FAT or NTFS boot record stands there; none if it is no volume system."""
    h = media.read_at(0, 4104)
    if h[560:580] == b"Apple_partition_map\0":
        return read_apm(media)
    if any(h[s : s + 8] == b"EFI PART" for s in SECTORS):
        return read_gpt(media)
    boot = h[54:57] == b"FAT" or h[82:85] == b"FAT" or h[3:11] == b"NTFS    "
    return read_mbr(media) if h[510:512] == b"\x55\xaa" and not boot else []
