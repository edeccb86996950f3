"""NTFS file systems."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from sedira.functions.codec import fold_name
from sedira.functions.compression import decompress_bytes
from sedira.sources.entries import Entry, FileSystem, Fork, Time, resident
from sedira.sources.streams import Block, BlockStream, Stream

#: Attribute types, name spaces, reparse tags, methods of WOF with their unit.
STANDARD, LIST, NAME, VOLUME_NAME, VOLUME_INFO, DATA, INDEX_ROOT, INDEX_ALLOCATION, REPARSE = 0x10, 0x20, 0x30, 0x60, 0x70, 0x80, 0x90, 0xA0, 0xC0
DOS = 2
LINK, JUNCTION, WOF = 0xA000000C, 0xA0000003, 0x80000017
WOF_METHODS = {0: ("lzxpress_huffman", 4096), 1: ("lzx", 32768), 2: ("lzxpress_huffman", 8192), 3: ("lzxpress_huffman", 16384)}


@dataclass
class Attribute:
    kind: int
    name: str
    flags: int
    resident: bytes | None
    runs: list[tuple[int, int, int | None]]  # virtual cluster, clusters, cluster on disk
    size: int = 0
    valid: int = 0
    unit: int = 0


def fix_up(raw: bytes, sector: int = 512) -> bytes:
    """Puts back the bytes at the ends of strides that the update sequence replaced."""
    at, n = struct.unpack_from("<HH", raw, 4)
    out, mark = bytearray(raw), raw[at : at + 2]
    for k in range(1, n):
        end = k * sector
        if end > len(out):
            break
        if out[end - 2 : end] != mark:
            raise ValueError("torn record")
        out[end - 2 : end] = raw[at + 2 * k : at + 2 * k + 2]
    return bytes(out)


def data_runs(raw: bytes, first: int) -> list[tuple[int, int, int | None]]:
    out, at, vcn, lcn = [], 0, first, 0
    while at < len(raw) and raw[at]:
        a, b = raw[at] & 15, raw[at] >> 4
        n = int.from_bytes(raw[at + 1 : at + 1 + a], "little")
        if b:
            lcn += int.from_bytes(raw[at + 1 + a : at + 1 + a + b], "little", signed=True)
        out.append((vcn, n, lcn if b else None))
        vcn += n
        at += 1 + a + b
    return out


class _Units(Stream):
    """A compressed stream: units of clusters, each stored whole, sparse, or LZNT1 with a sparse tail."""

    KEPT = 8

    def __init__(self, fs: Ntfs, a: Attribute):
        self.fs, self.a, self.size, self.unit = fs, a, a.size, fs.cluster << a.unit
        self._done: dict[int, bytes] = {}

    def _decode(self, k: int) -> bytes:
        if k not in self._done:
            first, n = k << self.a.unit, 1 << self.a.unit
            raw, whole = [], 0
            for vcn, m, lcn in self.a.runs:
                lo, hi = max(first, vcn), min(first + n, vcn + m)
                if lo < hi and lcn is not None:
                    raw.append(self.fs.stream.read_at((lcn + lo - vcn) * self.fs.cluster, (hi - lo) * self.fs.cluster))
                    whole += hi - lo
            data = b"".join(raw)
            if 0 < whole < n:
                data = decompress_bytes(data, "lznt1", self.unit)
            if len(self._done) >= self.KEPT:
                del self._done[next(iter(self._done))]
            self._done[k] = data.ljust(self.unit, b"\0")
        return self._done[k]

    def read_at(self, offset: int, size: int) -> bytes:
        end = min(self.size, offset + size)
        parts = []
        for k in range(offset // self.unit, -(-end // self.unit) if end > offset else 0):
            lo = max(offset - k * self.unit, 0)
            parts.append(self._decode(k)[lo : end - k * self.unit])
        data = b"".join(parts)
        if self.a.valid < self.size and offset + len(data) > self.a.valid:
            keep = max(0, self.a.valid - offset)
            data = data[:keep].ljust(len(data), b"\0")
        return data


class _Wof(Stream):
    """A file in chunks behind a table of their ends."""

    def __init__(self, packed: Stream, size: int, method: int):
        self.packed, self.size = packed, size
        self.codec, self.unit = WOF_METHODS[method]
        n = -(-size // self.unit)
        width = 8 if size > 0xFFFFFFFF else 4
        raw = packed.read_at(0, (n - 1) * width) if n else b""
        self.ends = [0, *struct.unpack(f"<{n - 1}{'Q' if width == 8 else 'I'}", raw), packed.size - len(raw)] if n else [0]
        self.base = len(raw)

    def read_at(self, offset: int, size: int) -> bytes:
        end, parts = min(self.size, offset + size), []
        for k in range(offset // self.unit, -(-end // self.unit) if end > offset else 0):
            want = min(self.unit, self.size - k * self.unit)
            raw = self.packed.read_at(self.base + self.ends[k], self.ends[k + 1] - self.ends[k])
            data = raw if len(raw) >= want else decompress_bytes(raw, self.codec, want)
            parts.append(data[max(offset - k * self.unit, 0) : end - k * self.unit])
        return b"".join(parts)


class Ntfs(FileSystem):
    format = "ntfs"

    def __init__(self, stream: Stream):
        self.stream = stream
        b = stream.read_at(0, 512)
        if b[3:11] != b"NTFS    ":
            raise ValueError("no NTFS boot record")
        sector, = struct.unpack_from("<H", b, 11)
        per = b[13] if b[13] <= 128 else 1 << 256 - b[13]
        self.cluster = sector * per
        size = lambda v: v * self.cluster if v < 128 else 1 << 256 - v
        self.record, self.index = size(b[64]), size(b[68])
        mft, = struct.unpack_from("<Q", b, 48)
        first = self._parse(fix_up(stream.read_at(mft * self.cluster, self.record)))
        self.mft: Stream = resident(b"")
        self.mft = self._stream(next(a for a in first if a.kind == DATA and not a.name))
        every = self.attributes(0)
        self.mft = self._stream(self._joined([a for a in every if a.kind == DATA and not a.name]))
        self.records = self.mft.size // self.record
        self.upcase: list[int] | None = None
        self.info = {"bytes_per_sector": str(sector), "cluster_size": str(self.cluster), "mft_entry_size": str(self.record), "serial_number": f"0x{struct.unpack_from('<Q', b, 72)[0]:016x}"}
        try:
            for a in self.attributes(3):
                if a.kind == VOLUME_NAME and a.resident is not None:
                    self.info["label"] = a.resident.decode("utf-16-le")
                if a.kind == VOLUME_INFO and a.resident is not None:
                    self.info |= {"version": f"{a.resident[8]}.{a.resident[9]}", "flags": f"0x{struct.unpack_from('<H', a.resident, 10)[0]:04x}"}
            up = self._stream(self._joined([a for a in self.attributes(10) if a.kind == DATA and not a.name])).read_all()
            self.upcase = list(struct.unpack(f"<{len(up) // 2}H", up[: len(up) // 2 * 2]))
        except (ValueError, StopIteration, IndexError):
            pass  # a volume without them is read by the rule

    # ---- records and attributes ----

    def read_record(self, n: int) -> bytes:
        raw = self.mft.read_at(n * self.record, self.record)
        if raw[:4] != b"FILE":
            raise ValueError(f"record {n} is {raw[:4]!r}")
        return fix_up(raw)

    @staticmethod
    def _parse(rec: bytes) -> list[Attribute]:
        out, at = [], struct.unpack_from("<H", rec, 20)[0]
        while at + 16 <= len(rec):
            kind, n = struct.unpack_from("<II", rec, at)
            if kind == 0xFFFFFFFF or n < 24 or at + n > len(rec):
                break
            far, length, where, flags = struct.unpack_from("<BBHH", rec, at + 8)
            name = rec[at + where : at + where + 2 * length].decode("utf-16-le", "surrogatepass")
            if far:
                first, _, runs, unit = struct.unpack_from("<QQHH", rec, at + 16)
                size, valid = struct.unpack_from("<QQ", rec, at + 48) if not first else (0, 0)
                out.append(Attribute(kind, name, flags, None, data_runs(rec[at + runs : at + n], first), size, valid, unit))
            else:
                size, value = struct.unpack_from("<IH", rec, at + 16)
                out.append(Attribute(kind, name, flags, rec[at + value : at + value + size], [], size, size))
            at += n
        return out

    @staticmethod
    def _joined(parts: list[Attribute]) -> Attribute:
        """An attribute whose runs are spread over records."""
        parts = sorted(parts, key=lambda a: a.runs[0][0] if a.runs else 0)
        if not parts:
            raise ValueError("no such attribute")
        first = parts[0]
        return Attribute(first.kind, first.name, first.flags, first.resident, [r for a in parts for r in a.runs], first.size, first.valid, first.unit)

    def attributes(self, n: int) -> list[Attribute]:
        found = self._parse(self.read_record(n))
        listed = [a for a in found if a.kind == LIST]
        if listed:
            raw = self._stream(self._joined(listed)).read_all()
            at, others = 0, set()
            while at + 26 <= len(raw):
                width, = struct.unpack_from("<H", raw, at + 4)
                ref = struct.unpack_from("<Q", raw, at + 16)[0] & 0xFFFFFFFFFFFF
                if ref != n:
                    others.add(ref)
                if width < 26:
                    break
                at += width
            for o in sorted(others):
                found += self._parse(self.read_record(o))
        return found

    def _stream(self, a: Attribute) -> Stream:
        if a.resident is not None:
            return resident(a.resident)
        if a.flags & 1 and a.unit:
            return _Units(self, a)
        blocks = [Block(v * self.cluster, m * self.cluster, lcn * self.cluster) for v, m, lcn in a.runs if lcn is not None]
        if a.valid < a.size:  # what lies behind the valid data is zero
            blocks = [Block(b.media_offset, min(b.size, a.valid - b.media_offset), b.data_offset) for b in blocks if b.media_offset < a.valid]
        return BlockStream(blocks, [self.stream], a.size)

    # ---- entries ----

    def entry(self, n: int, name: str | None = None) -> Entry:
        rec = self.read_record(n)
        sequence, = struct.unpack_from("<H", rec, 16)
        out = Entry(f"{n}-{sequence}", name or "", key=n, attributes=0)
        attributes = self.attributes(n)
        names = [a.resident for a in attributes if a.kind == NAME and a.resident is not None]
        if name is None and names:
            best = min(names, key=lambda v: v[65] == DOS)
            out.name = best[66 : 66 + 2 * best[64]].decode("utf-16-le", "surrogatepass") if n != 5 else ""
        out.raw_name = out.name.encode("utf-16-le", "surrogatepass")
        for a in attributes:
            if a.kind == STANDARD and a.resident is not None:
                b, m, c, t, flags = struct.unpack_from("<QQQQI", a.resident)
                out.btime, out.mtime, out.ctime, out.atime = (Time("filetime", v) for v in (b, m, c, t))
                out.attributes = flags
        directory = bool(struct.unpack_from("<H", rec, 22)[0] & 2) or any(a.kind == INDEX_ROOT and a.name == "$I30" for a in attributes)
        out.file_type = "directory" if directory else "file"
        out.n_attributes = len(attributes)
        forks: dict[str, list[Attribute]] = {}
        for a in attributes:
            if a.kind == DATA:
                forks.setdefault(a.name, []).append(a)
        reparse = next((a for a in attributes if a.kind == REPARSE), None)
        tag = data = None
        if reparse is not None:
            data = self._stream(reparse).read_all()
            tag, = struct.unpack_from("<I", data)
        if tag in (LINK, JUNCTION):
            so, sn, po, pn = struct.unpack_from("<HHHH", data, 8)
            base = 20 if tag == LINK else 16
            shown = data[base + po : base + po + pn] or data[base + so : base + so + sn]
            out.link_target = shown.decode("utf-16-le", "surrogatepass")
            out.file_type = "symbolic_link"
        for fork in sorted(forks):
            try:
                a = self._joined(forks[fork])
                s = self._stream(a)
                if not fork and tag == WOF and "WofCompressedData" in forks:
                    s = _Wof(self._stream(self._joined(forks["WofCompressedData"])), a.size, struct.unpack_from("<I", data, 20)[0])
                out.forks.append(Fork(fork or None, s))
            except (ValueError, KeyError) as x:
                out.error = str(x)
        out.size = out.data.size if out.data is not None else 0
        return out

    def root(self) -> Entry:
        return self.entry(5, "")

    def by_identifier(self, identifier: str) -> Entry | None:
        n = int(identifier.split("-")[0])
        try:
            e = self.entry(n)
        except ValueError:
            return None
        return e if "-" not in identifier or e.identifier == identifier else None

    def same(self, a: str, b: str) -> bool:
        return fold_name(a, self.upcase) == fold_name(b, self.upcase)

    def children(self, entry: Entry) -> Iterator[Entry]:
        attributes = self.attributes(entry.key)
        root = next((a for a in attributes if a.kind == INDEX_ROOT and a.name == "$I30"), None)
        if root is None:
            return
        parts = [a for a in attributes if a.kind == INDEX_ALLOCATION and a.name == "$I30"]
        nodes = self._stream(self._joined(parts)) if parts else None
        seen: set[int] = set()

        def walk(raw: bytes, at: int) -> Iterator[tuple[int, bytes]]:
            first, used = struct.unpack_from("<II", raw, at)
            here, end = at + first, at + used
            while here + 16 <= end:
                ref, n, key, flags = struct.unpack_from("<QHHI", raw, here)
                if flags & 1 and nodes is not None:
                    vcn, = struct.unpack_from("<Q", raw, here + n - 8)
                    if vcn in seen:
                        raise ValueError("an index within itself")
                    seen.add(vcn)
                    step = self.cluster if self.index >= self.cluster else 512
                    node = nodes.read_at(vcn * step, self.index)
                    if node[:4] != b"INDX":
                        raise ValueError("damaged index")
                    yield from walk(fix_up(node), 24)
                if flags & 2 or n < 16:
                    break
                yield ref, raw[here + 16 : here + 16 + key]
                here += n

        for ref, key in walk(root.resident, 16):
            name = key[66 : 66 + 2 * key[64]].decode("utf-16-le", "surrogatepass")
            n = ref & 0xFFFFFFFFFFFF
            if key[65] == DOS or n == entry.key:
                continue
            try:
                yield self.entry(n, name)
            except ValueError as x:
                yield Entry(f"{n}-{ref >> 48}", name, key[66:], "unknown", error=str(x))

    def names(self, n: int) -> list[tuple[int, str, int, list[Time]]]:
        """(parent record, name, name space, times) of each $FILE_NAME attribute."""
        out = []
        for a in self.attributes(n):
            if a.kind == NAME and a.resident is not None:
                v = a.resident
                times = [Time("filetime", t) for t in struct.unpack_from("<4Q", v, 8)]
                out.append((struct.unpack_from("<Q", v)[0] & 0xFFFFFFFFFFFF, v[66 : 66 + 2 * v[64]].decode("utf-16-le", "surrogatepass"), v[65], times))
        return out


def open_file_system(stream: Stream) -> FileSystem | None:
    """By signature; None if it is none. More than one is an error."""
    from sedira.sources.ext import Ext
    from sedira.sources.fat import Fat

    h = stream.read_at(0, 1082)
    found = [Ext] * (h[1080:1082] == b"\x53\xef") + [Fat] * (h[54:59] in (b"FAT12", b"FAT16") or h[82:87] == b"FAT32") + [Ntfs] * (h[3:11] == b"NTFS    ")
    if len(found) > 1:
        raise ValueError("more than one file system's signature")
    return found[0](stream) if found else None
