"""Writes small images after the public descriptions of the formats: what the readers are checked with.

A file system, volume system or container is made of bytes in memory, as large as what it holds needs, so these are for
images of some megabytes. Compressed forms come from functions.packers or the standard library.
"""

from __future__ import annotations

import plistlib
import struct
import uuid
import zlib


def filled(part: bytes) -> bool:
    """Whether a part is not all zeros: compared at once, not byte by byte."""
    return part != bytes(len(part))


def fat12(files: dict[str, bytes], label: str = "TESTFAT") -> bytes:
    """A FAT-12 volume of 512-byte clusters; names over 8.3 get long entries; one folder deep (a/b). Up to 4084 clusters."""
    need = [2 + -(-len(n.rpartition("/")[2]) // 13) for n in files]
    clusters = max(16, sum(-(-len(c) // 512) for c in files.values()) + sum(k // 16 + 3 for k in need))
    if clusters > 4084:
        raise ValueError("too much for FAT-12")
    fat_n, root_n = -(-(clusters + 2) * 3 // 1024), -(-(sum(need) + 2) // 16) * 16
    fat = [0xFF8, 0xFFF] + [0] * clusters
    data = bytearray(clusters * 512)
    next_ = 2

    def put(content: bytes) -> int:
        nonlocal next_
        n = -(-len(content) // 512)
        if not n:
            return 0
        first = next_
        data[(first - 2) * 512 : (first - 2) * 512 + len(content)] = content
        for k in range(n):
            fat[first + k] = first + k + 1 if k < n - 1 else 0xFFF
        next_ += n
        return first

    def entries(name: str, cluster: int, size: int, attr: int, number: int) -> bytes:
        stem, _, ext = name.upper().partition(".")
        out = b""
        short = (stem[:8].ljust(8) + ext[:3].ljust(3)).encode()
        if name != name.upper() or len(stem) > 8 or len(ext) > 3:
            short = f"FILE~{number}".ljust(8).encode()[:8] + ext[:3].ljust(3).encode()
            check = 0
            for c in short:
                check = ((check >> 1) + ((check & 1) << 7) + c) & 255
            units = name.encode("utf-16-le") + b"\0\0"
            units += b"\xff" * (-len(units) % 26)
            parts = [units[k : k + 26] for k in range(0, len(units), 26)]
            for k in reversed(range(len(parts))):
                p = parts[k]
                out += bytes([k + 1 | (0x40 if k == len(parts) - 1 else 0)]) + p[:10] + bytes([15, 0, check]) + p[10:22] + b"\0\0" + p[22:]
        date, time = 43 << 9 | 6 << 5 | 18, 12 << 11 | 34 << 5 | 28
        out += short + struct.pack("<BBBHHHHHHHI", attr, 0, 150, time, date, date, cluster >> 16, time, date, cluster & 0xFFFF, size)
        return out

    root = (label.ljust(11).encode() + bytes([8])).ljust(32, b"\0")
    folders: dict[str, bytes] = {}
    for k, (name, content) in enumerate(files.items()):
        folder, _, base = name.rpartition("/")
        e = entries(base, put(content), len(content), 0x20, k)
        if folder:
            folders[folder] = folders.get(folder, b"") + e
        else:
            root += e
    for k, (name, raw) in enumerate(folders.items()):
        dots = b".".ljust(11) + bytes([16]) + bytes(20) + b"..".ljust(11) + bytes([16]) + bytes(20)
        root += entries(name, put(dots + raw), 0, 0x10, 50 + k)
    table = bytearray()
    for a, b in zip(fat[::2], fat[1::2]):
        table += bytes([a & 255, a >> 8 | (b & 15) << 4, b >> 4])
    boot = bytearray(512)
    boot[:11] = b"\xeb\x3c\x90MSDOS5.0"
    struct.pack_into("<HBHBHHBH", boot, 11, 512, 1, 1, 1, root_n, 1 + fat_n + root_n * 32 // 512 + clusters, 0xF8, fat_n)
    boot[38] = 0x29
    boot[43:54], boot[54:62] = label.ljust(11).encode(), b"FAT12   "
    boot[510:] = b"\x55\xaa"
    return bytes(boot) + bytes(table).ljust(fat_n * 512, b"\0") + root.ljust(root_n * 32, b"\0") + bytes(data)


def ext2(files: dict[str, bytes], links: dict[str, str]) -> bytes:
    """An ext2 volume of 1024-byte blocks with the files in its root; one group of up to 8192 blocks, files of up to 268 KiB."""
    inodes = -(-(11 + len(files) + len(links)) // 8) * 8
    table = 5
    names = sum(12 + len(n.encode()) for n in [*files, *links])
    blocks = table + inodes * 128 // 1024 + sum(-(-len(c) // 1024) + 1 for c in files.values()) + 2 * (names // 900) + 4
    if blocks > 8192 or any(len(c) > 268 << 10 for c in files.values()):
        raise ValueError("too much for one group")
    out = bytearray(blocks * 1024)
    next_block = table + inodes * 128 // 1024
    next_inode = 11

    def inode(n: int, mode: int, size: int, pointers: list[int], raw: bytes | None = None) -> None:
        at = table * 1024 + (n - 1) * 128
        struct.pack_into("<HHIIIIIHHII", out, at, mode, 1000, size, 1281643591, 1281643592, 1281643593, 0, 100, 1, len(pointers) * 2, 0)
        out[at + 40 : at + 100] = raw.ljust(60, b"\0") if raw is not None else struct.pack("<15I", *pointers, *[0] * (15 - len(pointers)))

    def store(content: bytes) -> list[int]:
        nonlocal next_block
        all_ = []
        for k in range(0, len(content), 1024):
            part = content[k : k + 1024]
            if filled(part):
                out[next_block * 1024 : next_block * 1024 + len(part)] = part
                all_.append(next_block)
                next_block += 1
            else:
                all_.append(0)
        if len(all_) > 12:
            direct, rest = all_[:12], all_[12:]
            struct.pack_into(f"<{len(rest)}I", out, next_block * 1024, *rest)
            all_ = [*direct, next_block]
            next_block += 1
        return all_

    rows = [(2, b".", 2), (2, b"..", 2)]
    for name, content in files.items():
        inode(next_inode, 0o100644, len(content), store(content))
        rows.append((next_inode, name.encode(), 1))
        next_inode += 1
    for name, target in links.items():
        inode(next_inode, 0o120777, len(target), [], target.encode())
        rows.append((next_inode, name.encode(), 7))
        next_inode += 1
    listing, part = b"", b""
    for k, (n, name, kind) in enumerate(rows):
        width = 8 + (len(name) + 3 & ~3)
        more = 8 + (len(rows[k + 1][1]) + 3 & ~3) if k < len(rows) - 1 else 1024
        if len(part) + width + more > 1024:
            width = 1024 - len(part)
        part += (struct.pack("<IHBB", n, width, len(name), kind) + name).ljust(width, b"\0")
        if len(part) == 1024:
            listing, part = listing + part, b""
    inode(2, 0o040755, len(listing), store(listing))
    s = bytearray(1024)
    struct.pack_into("<IIIIIIIIIII", s, 0, inodes, blocks, 0, 0, 0, 1, 0, 0, 8192, 8192, inodes)
    s[56:58] = b"\x53\xef"
    struct.pack_into("<I", s, 76, 1)
    struct.pack_into("<H", s, 88, 128)
    struct.pack_into("<III", s, 92, 0, 2, 0)
    s[104:120], s[120:129] = uuid.UUID(int=77).bytes, b"ext2_test"
    out[1024:2048] = s
    struct.pack_into("<III", out, 2048, 3, 4, table)
    return bytes(out)


def _attribute(kind: int, value: bytes, name: str = "") -> bytes:
    raw = name.encode("utf-16-le")
    where = 24 + len(raw) + (-len(raw) % 8)
    body = struct.pack("<IIBBHHHIHH", kind, 0, 0, len(name), 24, 0, 0, len(value), where, 0) + raw
    out = bytearray((body.ljust(where, b"\0") + value).ljust(where + len(value) + -(where + len(value)) % 8, b"\0"))
    struct.pack_into("<I", out, 4, len(out))
    return bytes(out)


def _far(kind: int, runs: bytes, clusters: int, size: int, flags: int = 0, unit: int = 0) -> bytes:
    at = 72 if flags else 64
    out = bytearray(struct.pack("<IIBBHHHQQHHIQQQ", kind, 0, 1, 0, at, flags, 0, 0, clusters - 1, at, unit, 0, clusters * 1024, size, size).ljust(at, b"\0") + runs)
    out = bytearray(out.ljust(len(out) + -len(out) % 8, b"\0"))
    struct.pack_into("<I", out, 4, len(out))
    return bytes(out)


def ntfs(files: dict[str, bytes], forks: dict[str, dict[str, bytes]], packed: dict[str, tuple[bytes, bytes]]) -> bytes:
    """An NTFS volume of 1024-byte clusters and records: resident files, far ones, named streams; `packed` has content and its LZNT1 form in units of 16 clusters."""
    mft = 16
    n = 11 + len(files) + len(packed)
    total = mft + n + 2 + sum(-(-len(c) // 1024) for c in files.values()) + 16 * len(packed) + 8
    if total > 32767:
        raise ValueError("too much for runs of 16 bits")
    out = bytearray(total * 1024)
    free = mft + n + 2
    stamp = 0x01CB3A623D0A17CE

    def run(first: int, count: int) -> bytes:
        return bytes([0x22]) + struct.pack("<Hh", count, first)

    def name_value(name: str, size: int, directory: bool) -> bytes:
        return struct.pack("<QQQQQQQIIBB", 5 | 5 << 48, stamp, stamp, stamp, stamp, size, size, 0x10000000 if directory else 0x20, 0, len(name), 3) + name.encode("utf-16-le")

    def record(k: int, attributes: list[bytes], flags: int = 1) -> None:
        body = b"".join(attributes) + b"\xff\xff\xff\xff\0\0\0\0"
        raw = bytearray((b"FILE" + struct.pack("<HHQHHHHIIQHHI", 48, 3, 0, k or 1, 1, 56, flags, 56 + len(body), 1024, 0, 0, 0, k) + bytes(8)).ljust(56, b"\0")[:56] + body)
        raw = bytearray(raw.ljust(1024, b"\0"))
        raw[48:50] = b"\x07\x00"
        for i in (1, 2):
            raw[48 + 2 * i : 50 + 2 * i] = raw[i * 512 - 2 : i * 512]
            raw[i * 512 - 2 : i * 512] = b"\x07\x00"
        out[(mft + k) * 1024 : (mft + k + 1) * 1024] = raw

    standard = _attribute(0x10, struct.pack("<QQQQIIII", stamp, stamp + 1, stamp + 2, stamp + 3, 0x20, 0, 0, 0))
    record(0, [standard, _attribute(0x30, name_value("$MFT", 0, False)), _far(0x80, run(mft, n) + b"\0", n, n * 1024)])
    record(3, [standard, _attribute(0x30, name_value("$Volume", 0, False)), _attribute(0x60, "ntfs_test".encode("utf-16-le")), _attribute(0x70, bytes(8) + b"\x03\x01\x00\x00")])
    listing = b""
    for k, (name, content) in enumerate([*files.items(), *((x, v[0]) for x, v in packed.items())], 11):
        attributes = [standard, _attribute(0x30, name_value(name, len(content), False))]
        if name in packed:
            raw = packed[name][1]
            m = -(-len(raw) // 1024)
            out[free * 1024 : free * 1024 + len(raw)] = raw
            attributes.append(_far(0x80, run(free, m) + bytes([0x02]) + struct.pack("<H", 16 - m) + b"\0", 16, len(content), 1, 4))
            free += m
        elif len(content) < 200:
            attributes.append(_attribute(0x80, content))
        else:
            m = -(-len(content) // 1024)
            out[free * 1024 : free * 1024 + len(content)] = content
            attributes.append(_far(0x80, run(free, m) + b"\0", m, len(content)))
            free += m
        attributes += [_attribute(0x80, v, f) for f, v in forks.get(name, {}).items()]
        record(k, attributes)
        key = name_value(name, len(content), False)
        width = 16 + len(key) + -len(key) % 8
        listing += (struct.pack("<QHHI", k | k << 48, width, len(key), 0) + key).ljust(width, b"\0")
    end = struct.pack("<QHHI", 0, 16, 0, 2)
    small, large = len(listing) < 300, None
    if small:
        root = struct.pack("<IIIBBBBIIII", 0x30, 1, 4096, 1, 0, 0, 0, 16, 16 + len(listing) + 16, 16 + len(listing) + 16, 0) + listing + end
    else:  # one node below the root
        node = bytearray((b"INDX" + struct.pack("<HHQQ", 40, 9, 0, 0) + struct.pack("<IIII", 40, 40 + len(listing) + 16, 4072, 0) + bytes(24) + listing + end).ljust(4096, b"\0"))
        node[40:42] = b"\x09\x00"
        for i in range(1, 9):
            node[40 + 2 * i : 42 + 2 * i] = node[i * 512 - 2 : i * 512]
            node[i * 512 - 2 : i * 512] = b"\x09\x00"
        out[free * 1024 : free * 1024 + 4096] = node
        raw = "$I30".encode("utf-16-le")
        large = bytearray(struct.pack("<IIBBHHHQQHHIQQQ", 0xA0, 0, 1, 4, 64, 0, 0, 0, 3, 72, 0, 0, 4096, 4096, 4096) + raw + run(free, 4) + b"\0\0\0")
        large = bytearray(large.ljust(len(large) + -len(large) % 8, b"\0"))
        struct.pack_into("<I", large, 4, len(large))
        root = struct.pack("<IIIBBBBIIII", 0x30, 1, 4096, 4, 0, 0, 0, 16, 40, 40, 1) + struct.pack("<QHHIQ", 0, 24, 0, 3, 0)
    record(5, [standard, _attribute(0x30, name_value(".", 0, True)), _attribute(0x90, root, "$I30"), *([bytes(large)] if large else [])], 3)
    boot = bytearray(512)
    boot[3:11] = b"NTFS    "
    struct.pack_into("<HB", boot, 11, 512, 2)
    struct.pack_into("<QQQ", boot, 40, total * 2, mft, 1)
    struct.pack_into("<bxxxbxxxQ", boot, 64, -10, 4, 0x1234)
    boot[510:] = b"\x55\xaa"
    out[:512] = boot
    return bytes(out)


def mbr(parts: list[tuple[int, bytes]], logical: list[tuple[int, bytes]] = ()) -> bytes:
    out = bytearray(512)
    at = 1
    struct.pack_into("<I", out, 440, 0xCAFE)
    for k, (kind, data) in enumerate(parts):
        n = -(-len(data) // 512)
        struct.pack_into("<B3xB3xII", out, 446 + 16 * k, 0x80 if not k else 0, kind, at, n)
        out += data.ljust(n * 512, b"\0")
        at += n
    if logical:
        first = at
        struct.pack_into("<B3xB3xII", out, 446 + 16 * len(parts), 0, 5, first, sum(1 + -(-len(d) // 512) for _, d in logical))
        for k, (kind, data) in enumerate(logical):
            n = -(-len(data) // 512)
            e = bytearray(512)
            struct.pack_into("<B3xB3xII", e, 446, 0, kind, 1, n)
            if k < len(logical) - 1:
                struct.pack_into("<B3xB3xII", e, 462, 0, 5, at + 1 + n - first, 1)
            e[510:] = b"\x55\xaa"
            out += e + data.ljust(n * 512, b"\0")
            at += 1 + n
    out[510:512] = b"\x55\xaa"
    return bytes(out)


def gpt(parts: list[tuple[str, str, bytes]], sector: int = 512) -> bytes:
    entries = bytearray(128 * 128)
    first = 2 + -(-len(entries) // sector)
    at, body = first, b""
    for k, (kind, name, data) in enumerate(parts):
        n = -(-len(data) // sector)
        entries[128 * k : 128 * k + 128] = (uuid.UUID(kind).bytes_le + uuid.UUID(int=k + 1).bytes_le + struct.pack("<QQQ", at, at + n - 1, k) + name.encode("utf-16-le")).ljust(128, b"\0")
        body += data.ljust(n * sector, b"\0")
        at += n
    head = bytearray(b"EFI PART" + struct.pack("<IIIIQQQQ16sQIII", 0x10000, 92, 0, 0, 1, at, first, at - 1, uuid.UUID(int=99).bytes_le, 2, 128, 128, zlib.crc32(entries)))
    struct.pack_into("<I", head, 16, zlib.crc32(head))
    protective = mbr([(0xEE, b"")])
    return protective.ljust(sector, b"\0") + bytes(head).ljust(sector, b"\0") + bytes(entries).ljust((first - 2) * sector, b"\0") + body + bytes(sector)


def apm(parts: list[tuple[str, str, bytes]]) -> bytes:
    out = bytearray(b"ER" + struct.pack(">HI", 512, 4096)).ljust(512, b"\0")
    every = [("Apple_partition_map", "Apple", b""), *parts]
    at, body = 1 + len(every), b""
    for k, (kind, name, data) in enumerate(every):
        n = len(every) if not k else -(-len(data) // 512)
        start = 1 if not k else at
        e = b"PM\0\0" + struct.pack(">III", len(every), start, n) + name.encode().ljust(32, b"\0") + kind.encode().ljust(32, b"\0") + struct.pack(">III", 0, n, 0x33)
        out += e.ljust(512, b"\0")
        if k:
            body += data.ljust(n * 512, b"\0")
            at += n
    return bytes(out + body)


def qcow2(media: bytes, version: int = 2, backing: str = "", only: set[int] | None = None, packed: set[int] = frozenset()) -> bytes:
    """64 KiB clusters; `only` says which are stored (else all that are not zero), `packed` which are compressed."""
    bits = 16
    cluster = 1 << bits
    n = -(-len(media) // cluster)
    per = 1 << bits - 3
    l1_n = -(-n // per)
    name = backing.encode()
    out = bytearray(cluster * (2 + l1_n))
    l1 = []
    for i in range(l1_n):
        table = []
        for k in range(i * per, min(n, (i + 1) * per)):
            part = media[k * cluster : (k + 1) * cluster].ljust(cluster, b"\0")
            if (k not in only) if only is not None else not filled(part):
                table.append(0)
            elif k in packed:
                c = zlib.compressobj(9, zlib.DEFLATED, -12)
                raw = c.compress(part) + c.flush()
                at = len(out)
                sectors = -(-(at % 512 + len(raw)) // 512) - 1
                out += raw
                table.append(1 << 62 | sectors << 62 - (bits - 8) | at)
            else:
                out += bytes(-len(out) % cluster)
                table.append(1 << 63 | len(out))
                out += part
        l1.append(1 << 63 | cluster * (2 + i))
        struct.pack_into(f">{len(table)}Q", out, cluster * (2 + i), *table)
    struct.pack_into(f">{l1_n}Q", out, cluster, *l1)
    struct.pack_into(">4sIQIIQIIQQII", out, 0, b"QFI\xfb", version, 200 if name else 0, len(name), bits, len(media), 0, l1_n, cluster, 0, 0, 0)
    if version == 3:
        struct.pack_into(">QQQII", out, 72, 0, 0, 0, 4, 104)
    out[200 : 200 + len(name)] = name
    return bytes(out)


def vhd(media: bytes, kind: int = 3, parent: tuple[str, bytes] | None = None, own: set[int] = frozenset(), identifier: int = 5) -> bytes:
    """Blocks of 16 KiB; of a differential image `own` says which sectors are its."""
    block = 16384

    def footer(next_: int) -> bytes:
        return (b"conectix" + struct.pack(">IIQI4sI4sQQIII16s", 2, 0x10000, next_, 0, b"test", 0, b"Wi2k", len(media), len(media), 0, kind, 0, uuid.UUID(int=identifier).bytes)).ljust(512, b"\0")

    if kind == 2:
        return media + footer((1 << 64) - 1)
    n = -(-len(media) // block)
    bat, body, at = [], b"", 512 + 1024 + -(-n * 4 // 512) * 512
    for k in range(n):
        part = media[k * block : (k + 1) * block].ljust(block, b"\0")
        sectors = [s for s in range(block // 512) if k * (block // 512) + s in own] if kind == 4 else list(range(block // 512))
        if (kind == 3 and not filled(part)) or not sectors:
            bat.append(0xFFFFFFFF)
            continue
        bits = bytearray(512)
        for s in sectors:
            bits[s >> 3] |= 0x80 >> (s & 7)
        bat.append((at + len(body)) // 512)
        body += bytes(bits) + part
    head = b"cxsparse" + struct.pack(">QQIII", (1 << 64) - 1, 1536, 0x10000, n, block) + bytes(4) + (parent[1] if parent else bytes(16)) + bytes(8) + (parent[0] if parent else "").encode("utf-16-be")
    return footer(512) + head.ljust(1024, b"\0") + struct.pack(f">{n}I", *bat).ljust(-(-n * 4 // 512) * 512, b"\0") + body + footer(512)


def vhdx_parts(media: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    """The size of a VHDX image, and what is not zero in it, with its places: an image of a small medium is 4 MiB of almost nothing."""
    block, mib = 1 << 20, 1 << 20
    n = -(-len(media) // block)
    region = b"regi" + struct.pack("<III", 0, 2, 0)
    region += uuid.UUID("2dc27766-f623-4200-9d64-115e9bfd4a08").bytes_le + struct.pack("<QII", 3 * mib, mib, 1) + uuid.UUID("8b7ca206-4790-4b9a-b8fe-575f050f886e").bytes_le + struct.pack("<QII", 2 * mib, mib, 1)
    items = [("caa16737-fa36-4d43-b3b6-33f0aa44e76b", struct.pack("<II", block, 0)), ("2fa54224-cd1b-4876-b211-5dbed83bf4b8", struct.pack("<Q", len(media))), ("beca12ab-b2e6-4523-93ef-c309e000c746", uuid.UUID(int=6).bytes_le), ("8141bf1d-a96f-4709-ba47-f233a8faab5f", struct.pack("<I", 512))]
    table, values = b"metadata" + struct.pack("<HH", 0, len(items)) + bytes(20), b""
    for name, v in items:
        table += uuid.UUID(name).bytes_le + struct.pack("<IIII", 65536 + len(values), len(v), 0, 0)
        values += v
    per = (1 << 23) * 512 // block
    bat, end, stored = bytearray(8 * (n + n // per)), 4 * mib, []
    for k in range(n):
        part = media[k * block : (k + 1) * block]
        e = 2
        if filled(part):
            e = (end // mib) << 20 | 6
            stored.append((end, part))
            end += block
        struct.pack_into("<Q", bat, 8 * (k + k // per), e)
    return end, [(0, b"vhdxfile"), (192 << 10, region), (2 * mib, table), (2 * mib + 65536, values), (3 * mib, bytes(bat)), *stored]


def vhdx(media: bytes) -> bytes:
    size, parts = vhdx_parts(media)
    out = bytearray(size)
    for at, part in parts:
        out[at : at + len(part)] = part
    return bytes(out)


def sparseimage(media: bytes) -> bytes:
    band = 128 * 512
    out, numbers = b"", []
    for k in range(-(-len(media) // band)):
        part = media[k * band : (k + 1) * band].ljust(band, b"\0")
        if filled(part):
            numbers.append(k + 1)
            out += part
    return (b"sprs" + struct.pack(">IIII", 3, 128, 1, len(media) // 512).ljust(60, b"\0") + struct.pack(f">{len(numbers)}I", *numbers)).ljust(4096, b"\0") + out


def udif(media: bytes, kind: int, pack) -> bytes:
    """Blocks of 64 KiB: zero ones sparse, the first raw, others packed."""
    size, data, rows = 65536, b"", []
    for k in range(-(-len(media) // size)):
        part = media[k * size : (k + 1) * size]
        n = len(part) // 512
        if not filled(part):
            rows.append((0, k * 128, n, 0, 0))
            continue
        raw = part if not k else pack(part)
        rows.append((1 if not k else kind, k * 128, n, len(data), len(raw)))
        data += raw
    rows.append((0xFFFFFFFF, len(media) // 512, 0, len(data), 0))
    table = (b"mish" + struct.pack(">IQQQ", 1, 0, len(media) // 512, 0)).ljust(200, b"\0") + struct.pack(">I", len(rows))
    table += b"".join(struct.pack(">IIQQQQ", r[0], 0, *r[1:]) for r in rows)
    xml = plistlib.dumps({"resource-fork": {"blkx": [{"Data": table, "ID": "0"}]}})
    tail = bytearray(512)
    struct.pack_into(">4sIIIQQQ", tail, 0, b"koly", 4, 512, 1, 0, 0, len(data))
    struct.pack_into(">QQ", tail, 216, len(data), len(xml))
    struct.pack_into(">Q", tail, 492, len(media) // 512)
    return data + xml + bytes(tail)


def ewf(media: bytes, md5: bytes, segments: int = 2) -> list[bytes]:
    """Chunks of 32 KiB, every other one compressed, over some segment files."""
    size = 32768
    chunks = [media[k : k + size] for k in range(0, len(media), size)]
    files, per = [], -(-len(chunks) // segments)

    def section(kind: bytes, at: int, body: bytes, last: bool = False) -> bytes:
        head = kind.ljust(16, b"\0") + struct.pack("<QQ", at if last else at + 76 + len(body), 76 + len(body)) + bytes(40)
        return head + struct.pack("<I", zlib.adler32(head)) + body

    for s in range(segments):
        out = b"EVF\x09\x0d\x0a\xff\x00\x01" + struct.pack("<HH", s + 1, 0)
        if not s:
            text = "1\nmain\na\tc\tn\te\tt\tav\tov\tm\tu\tp\nan image\t007\t1\tme\tnotes\t1\tLinux\t2010 8 12 20 6 31\t2010 8 12 20 6 31\t0\n\n"
            out += section(b"header", len(out), zlib.compress(text.encode()))
            volume = struct.pack("<IIII", 1, len(chunks), 64, 512) + struct.pack("<Q", len(media) // 512)
            out += section(b"volume", len(out), (b"\x01\0\0\0" + volume[4:]).ljust(1052, b"\0"))
        own, body, entries = chunks[s * per : (s + 1) * per], b"", []
        base = len(out) + 76
        for k, c in enumerate(own):
            raw = zlib.compress(c) if k & 1 else c + struct.pack("<I", zlib.adler32(c))
            entries.append(len(body) | (0x80000000 if k & 1 else 0))
            body += raw
        out += section(b"sectors", len(out), body)
        table = struct.pack("<I4xQ4xI", len(entries), base, 0) + struct.pack(f"<{len(entries)}I", *entries) + bytes(4)
        out += section(b"table", len(out), table)
        if s == segments - 1:
            out += section(b"hash", len(out), md5 + bytes(20))
            out += section(b"done", len(out), b"", True)
        else:
            out += section(b"next", len(out), b"", True)
        files.append(out)
    return files
