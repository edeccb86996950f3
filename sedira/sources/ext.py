"""ext2, ext3 and ext4 file systems."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from sedira.sources.entries import Entry, FileSystem, Fork, Time, resident
from sedira.sources.streams import Block, BlockStream, Stream

#: Types by mode, and feature masks by which versions are told apart.
TYPES = {0x1000: "named_pipe", 0x2000: "character_device", 0x4000: "directory", 0x6000: "block_device", 0x8000: "file", 0xA000: "symbolic_link", 0xC000: "socket"}
EXT4, EXT3 = (0x200, 0x1F7C0, 0x378), (0x4, 0xC)
COMPATIBLE = {0x1: "directory preallocation", 0x2: "imagic inodes", 0x4: "journal", 0x8: "extended attributes", 0x10: "resize inode", 0x20: "directory index", 0x200: "sparse super version 2"}
INCOMPATIBLE = {0x1: "compression", 0x2: "directory entry type", 0x4: "needs recovery", 0x8: "journal device", 0x10: "meta block groups", 0x40: "extents", 0x80: "64-bit", 0x100: "multiple mount protection", 0x200: "flexible block groups", 0x400: "large extended attributes", 0x1000: "directory data", 0x2000: "checksum seed", 0x4000: "large directory", 0x8000: "inline data", 0x10000: "encryption"}
READ_ONLY = {0x1: "sparse super", 0x2: "large file", 0x4: "binary tree directory", 0x8: "huge file", 0x10: "group descriptor checksums", 0x20: "many links", 0x40: "large inodes", 0x100: "quota", 0x200: "bigalloc", 0x400: "metadata checksums"}
ROOT, EXTENTS, INLINE = 2, 0x80000, 0x10000000


def version_of(compatible: int, incompatible: int, read_only: int) -> int:
    if compatible & EXT4[0] or incompatible & EXT4[1] or read_only & EXT4[2]:
        return 4
    return 3 if compatible & EXT3[0] or incompatible & EXT3[1] else 2


class Ext(FileSystem):
    format = "ext"

    def __init__(self, stream: Stream):
        self.stream = stream
        s = stream.read_at(1024, 1024)
        if s[56:58] != b"\x53\xef":
            raise ValueError("no ext superblock")
        u32 = lambda at: struct.unpack_from("<I", s, at)[0]
        self.block = 1024 << u32(24)
        self.inodes, self.per_group = u32(0), u32(40)
        self.records = self.inodes
        compatible, incompatible, read_only = u32(92), u32(96), u32(100)
        self.version = version_of(compatible, incompatible, read_only)
        self.inode_size = struct.unpack_from("<H", s, 88)[0] if u32(76) else 128
        blocks = u32(4) | (u32(0x150) << 32 if incompatible & 0x80 else 0)
        self.groups = -(-(blocks - u32(20)) // u32(32))
        width = struct.unpack_from("<H", s, 254)[0] or 64 if incompatible & 0x80 else 32
        raw = stream.read_at((u32(20) + 1) * self.block, self.groups * width)
        self.tables = []
        for k in range(self.groups):
            lo = struct.unpack_from("<I", raw, k * width + 8)[0]
            self.tables.append(lo | (struct.unpack_from("<I", raw, k * width + 40)[0] << 32 if width >= 64 else 0))
        text = lambda a, b: s[a:b].split(b"\0")[0].decode("utf-8", "replace")
        named = lambda bits, names: ", ".join(v for k, v in names.items() if bits & k)
        self.info = {
            "version": f"ext{self.version}", "label": text(120, 136), "identifier": str(uuid.UUID(bytes=s[104:120])), "last_mount_path": text(136, 200), "block_size": str(self.block), "inode_size": str(self.inode_size), "number_of_inodes": str(self.inodes),
            "mount_time": str(u32(44)), "write_time": str(u32(48)), "compatible_features": named(compatible, COMPATIBLE), "incompatible_features": named(incompatible, INCOMPATIBLE), "read_only_features": named(read_only, READ_ONLY),
        }
        self.has_types = bool(incompatible & 2)

    def inode(self, n: int) -> bytes:
        if not 1 <= n <= self.inodes:
            raise ValueError(f"no inode {n}")
        group, k = divmod(n - 1, self.per_group)
        return self.stream.read_at(self.tables[group] * self.block + k * self.inode_size, self.inode_size)

    # ---- data ----

    def _extents(self, node: bytes, out: list[Block], depth: int = 0) -> None:
        magic, n, _, level = struct.unpack_from("<HHHH", node)
        if magic != 0xF30A or depth > 8:
            raise ValueError("damaged extents")
        for k in range(n):
            first, = struct.unpack_from("<I", node, 12 + 12 * k)
            if level:
                lo, hi = struct.unpack_from("<IH", node, 16 + 12 * k)
                self._extents(self.stream.read_at((hi << 32 | lo) * self.block, self.block), out, depth + 1)
            else:
                length, hi, lo = struct.unpack_from("<HHI", node, 16 + 12 * k)
                unwritten = length > 0x8000
                length -= 0x8000 if unwritten else 0
                out.append(Block(first * self.block, length * self.block, (hi << 32 | lo) * self.block, kind="sparse" if unwritten else "in_file"))

    def _pointers(self, inode: bytes, size: int) -> list[Block]:
        out, at, want = [], 0, -(-size // self.block)
        per = self.block // 4

        def add(block: int) -> None:
            nonlocal at
            if block and out and out[-1].data_offset + out[-1].size == block * self.block and out[-1].media_offset + out[-1].size == at * self.block:
                out[-1].size += self.block
            elif block:
                out.append(Block(at * self.block, self.block, block * self.block))
            at += 1

        def through(block: int, level: int) -> None:
            nonlocal at
            if not block:
                at += per**level
                return
            for b in struct.unpack(f"<{per}I", self.stream.read_at(block * self.block, self.block)):
                if at >= want:
                    return
                add(b) if level == 1 else through(b, level - 1)

        direct = struct.unpack_from("<15I", inode, 40)
        for b in direct[:12]:
            if at < want:
                add(b)
        for level, b in enumerate(direct[12:], 1):
            if at < want:
                through(b, level)
        return out

    def data_of(self, inode: bytes, size: int) -> Stream:
        flags, = struct.unpack_from("<I", inode, 32)
        if flags & INLINE:
            return resident((inode[40:100] + self._inline_rest(inode))[:size])
        if flags & EXTENTS:
            blocks: list[Block] = []
            self._extents(inode[40:100], blocks)
        else:
            blocks = self._pointers(inode, size)
        return BlockStream(blocks, [self.stream], size)

    def attributes(self, inode: bytes) -> list[tuple[str, bytes]]:
        """Extended attributes, in the inode and in its block."""
        prefixes = {0: "", 1: "user.", 2: "system.posix_acl_access", 3: "system.posix_acl_default", 4: "trusted.", 6: "security.", 7: "system.", 8: "system.richacl"}
        out: list[tuple[str, bytes]] = []

        def read(raw: bytes, at: int, base: int) -> None:
            while at + 16 <= len(raw) and any(raw[at : at + 4]):
                n, kind, where, block, size = struct.unpack_from("<BBHII", raw, at)
                name = prefixes.get(kind, "") + raw[at + 16 : at + 16 + n].decode("utf-8", "replace")
                out.append((name, raw[base + where : base + where + size] if not block else b""))
                at += 16 + (n + 3 & ~3)

        if len(inode) > 132:
            at = 128 + struct.unpack_from("<H", inode, 128)[0]
            if inode[at : at + 4] == b"\x00\x00\x02\xea":
                read(inode, at + 4, at + 4)
        block = struct.unpack_from("<I", inode, 104)[0] | struct.unpack_from("<H", inode, 118)[0] << 32
        if block:
            raw = self.stream.read_at(block * self.block, self.block)
            if raw[:4] == b"\x00\x00\x02\xea":
                read(raw, 32, 0)
        return out

    def _inline_rest(self, inode: bytes) -> bytes:
        return next((v for k, v in self.attributes(inode) if k == "system.data"), b"")

    # ---- entries ----

    def entry(self, n: int, name: str = "", raw: bytes = b"") -> Entry:
        i = self.inode(n)
        mode, uid, size, atime, ctime, mtime = struct.unpack_from("<HHIIII", i)
        gid, = struct.unpack_from("<H", i, 24)
        kind = TYPES.get(mode & 0xF000, "unknown")
        size |= struct.unpack_from("<I", i, 108)[0] << 32 if kind == "file" else 0
        uid |= struct.unpack_from("<H", i, 120)[0] << 16
        gid |= struct.unpack_from("<H", i, 122)[0] << 16
        more = struct.unpack_from("<H", i, 128)[0] if len(i) > 128 else 0

        def stamp(seconds: int, at: int) -> Time:
            if more >= at - 128 + 4 and self.version == 4:
                extra, = struct.unpack_from("<I", i, at)
                s = seconds - (1 << 32) * (seconds >> 31) + ((extra & 3) << 32)
                return Time("posix64ns", s, extra >> 2) if extra >> 2 else Time("posix32", s) if s else Time("not_set")
            s = seconds - (1 << 32) * (seconds >> 31)
            return Time("posix32", s) if s else Time("not_set")

        out = Entry(str(n), name, raw, kind, size if kind in ("file", "symbolic_link") else 0, mode, None, uid, gid, stamp(atime, 140), stamp(mtime, 136), stamp(ctime, 132), key=n)
        if more >= 20:
            out.btime = stamp(struct.unpack_from("<I", i, 144)[0], 148)
        try:
            out.n_attributes = len(self.attributes(i))
            if kind == "symbolic_link":
                data = i[40 : 40 + size] if size < 60 else self.data_of(i, size).read_all()
                out.link_target = data.decode("utf-8", "replace")
            elif kind == "file":
                out.forks = [Fork(None, self.data_of(i, size))]
            elif kind in ("block_device", "character_device"):
                d = struct.unpack_from("<H", i, 40)[0] or struct.unpack_from("<H", i, 44)[0]
                out.device = (d >> 8, d & 255)
        except (ValueError, struct.error) as x:
            out.error = str(x)
        return out

    def root(self) -> Entry:
        return self.entry(ROOT)

    def by_identifier(self, identifier: str) -> Entry | None:
        try:
            return self.entry(int(identifier))
        except ValueError:
            return None

    def children(self, entry: Entry) -> Iterator[Entry]:
        i = self.inode(entry.key)
        flags, size = struct.unpack_from("<I", i, 32)[0], struct.unpack_from("<I", i, 4)[0]
        found: dict[bytes, int] = {}
        if flags & INLINE:
            parts = [i[44:100], self._inline_rest(i)]
        else:
            data = self.data_of(i, size).read_all()
            parts = [data[k : k + self.block] for k in range(0, len(data), self.block)]
        for raw in parts:
            at = 0
            while at + 8 <= len(raw):
                n, width, length = struct.unpack_from("<IHB", raw, at)
                if width < 8:
                    break
                name = raw[at + 8 : at + 8 + length]
                if n and length and name not in (b".", b".."):
                    found[name] = n
                at += width
        for name in sorted(found):
            try:
                yield self.entry(found[name], name.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), name)
            except ValueError as x:
                yield Entry(str(found[name]), name.decode("utf-8", "replace"), name, "unknown", error=str(x))
