"""FAT-12, FAT-16 and FAT-32 file systems."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from sedira.functions.codec import fold_name
from sedira.sources.entries import Entry, FileSystem, Fork, Time
from sedira.sources.streams import Block, BlockStream, RangeStream, Stream


class Fat(FileSystem):
    format = "fat"

    def __init__(self, stream: Stream):
        self.stream = stream
        b = stream.read_at(0, 512)
        self.sector, per, reserved, tables, root_n = struct.unpack_from("<HBHBH", b, 11)
        if self.sector not in (512, 1024, 2048, 4096) or not per or not tables:
            raise ValueError("no FAT boot record")
        total = struct.unpack_from("<H", b, 19)[0] or struct.unpack_from("<I", b, 32)[0]
        table_n = struct.unpack_from("<H", b, 22)[0] or struct.unpack_from("<I", b, 36)[0]
        self.cluster = per * self.sector
        root_at = reserved + tables * table_n
        self.root_at, self.root_size = root_at * self.sector, root_n * 32
        data = root_at + -(-self.root_size // self.sector)
        self.data, self.count = data * self.sector, max(0, total - data) // per
        wide = struct.unpack_from("<H", b, 22)[0] == 0
        self.root_cluster = struct.unpack_from("<I", b, 44)[0] if wide else 0
        self.bits = 32 if self.root_cluster or self.count >= 65525 else 16 if self.count >= 4085 else 12
        self.table = RangeStream(stream, reserved * self.sector, table_n * self.sector).read_all()
        ext = 64 if self.bits == 32 else 36
        label = b[ext + 7 : ext + 18].decode("ascii", "replace").rstrip() if b[ext + 2] == 0x29 else ""
        self.info = {"version": f"FAT-{self.bits}", "label": label, "bytes_per_sector": str(self.sector), "cluster_size": str(self.cluster), "number_of_clusters": str(self.count)}

    def next_cluster(self, n: int) -> int | None:
        """None at the end of a chain."""
        if self.bits == 12:
            v, = struct.unpack_from("<H", self.table, n + n // 2)
            v = v >> 4 if n & 1 else v & 0xFFF
            return None if v > 0xFF0 else v
        if self.bits == 16:
            v, = struct.unpack_from("<H", self.table, 2 * n)
            return None if v > 0xFFF0 else v
        v = struct.unpack_from("<I", self.table, 4 * n)[0] & 0x0FFFFFFF
        return None if v > 0x0FFFFFF0 else v

    def chain(self, first: int, size: int | None = None) -> Stream:
        blocks: list[Block] = []
        n, at, seen = first, 0, set()
        while n is not None and n >= 2 and (size is None or at < size):
            if n in seen or n >= self.count + 2:
                raise ValueError("damaged cluster chain")
            seen.add(n)
            where = self.data + (n - 2) * self.cluster
            if blocks and blocks[-1].data_offset + blocks[-1].size == where:
                blocks[-1].size += self.cluster
            else:
                blocks.append(Block(at, self.cluster, where))
            at += self.cluster
            n = self.next_cluster(n)
        return BlockStream(blocks, [self.stream], at if size is None else size)

    def root(self) -> Entry:
        return Entry("0x00000000", "", file_type="directory", key=("root",))

    def same(self, a: str, b: str) -> bool:
        return fold_name(a) == fold_name(b)

    def children(self, entry: Entry) -> Iterator[Entry]:
        if entry.key[0] == "root" and self.bits != 32:
            raw, base = self.stream.read_at(self.root_at, self.root_size), self.root_at
        else:
            s = self.chain(self.root_cluster if entry.key[0] == "root" else entry.key[1])
            raw, base = s.read_all(), None
        long: dict[int, str] = {}
        for at in range(0, len(raw) - 31, 32):
            e = raw[at : at + 32]
            if not any(e):
                break
            if e[0] == 0xE5:
                long = {}
                continue
            if e[11] == 0x0F and e[26:28] == b"\0\0" and (1 <= e[0] <= 0x13 or 0x41 <= e[0] <= 0x54):
                long[e[0] & 0x3F] = (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "surrogatepass")
                continue
            name = "".join(long[k] for k in sorted(long)).split("\0")[0].rstrip("￿")
            long = {}
            if e[11] & 0x08:
                if entry.key[0] == "root":
                    self.info["label"] = e[:11].decode("latin-1").rstrip()
                continue
            stem, ext = e[:8].decode("latin-1").rstrip(), e[8:11].decode("latin-1").rstrip()
            stem = "\xe5" + stem[1:] if e[0] == 0x05 else stem
            if e[12] & 0x08:
                stem = stem.lower()
            if e[12] & 0x10:
                ext = ext.lower()
            short = f"{stem}.{ext}" if ext else stem
            if short in (".", ".."):
                continue
            cluster = struct.unpack_from("<H", e, 20)[0] << 16 & (0xFFFFFFFF if self.bits == 32 else 0) | struct.unpack_from("<H", e, 26)[0]
            size, = struct.unpack_from("<I", e, 28)
            where = base + at if base is not None else s.blocks[0].data_offset + at if len(s.blocks) == 1 else self._place(s, at)
            yield self._entry(name or short, e, cluster, size, where)

    @staticmethod
    def _place(s: BlockStream, at: int) -> int:
        from bisect import bisect_right

        b = s.blocks[bisect_right(s.starts, at) - 1]
        return b.data_offset + at - b.media_offset

    def _entry(self, name: str, e: bytes, cluster: int, size: int, where: int) -> Entry:
        directory = bool(e[11] & 0x10)
        out = Entry(f"0x{where:08x}", name, e[:11], "directory" if directory else "file", 0 if directory else size, attributes=e[11], key=("cluster", cluster))
        stamp = lambda d, t, tens=0: Time("fat", struct.unpack_from("<H", e, d)[0] << 16 | (struct.unpack_from("<H", e, t)[0] if t else 0), tens) if struct.unpack_from("<H", e, d)[0] else Time("not_set")
        out.mtime, out.atime, out.btime = stamp(24, 22), stamp(18, 0), stamp(16, 14, e[13])
        if not directory:
            try:
                out.forks = [Fork(None, self.chain(cluster, size))]
            except ValueError as x:
                out.error = str(x)
        return out
