"""Storage media images: each opener gives the medium as a BlockStream and what the headers say.

Written after the public descriptions of the formats.
"""

from __future__ import annotations

import os
import plistlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from sedira.sources.streams import Block, BlockStream, FileStream, Stream


@dataclass
class Image:
    format: str
    media: Stream
    info: dict[str, str] = field(default_factory=dict)
    stored: dict[str, str] = field(default_factory=dict)  # digests by kind
    errors: list[tuple[int, int]] = field(default_factory=list)  # sectors that could not be read: first, number
    layers: int = 1


Opener = Callable[[str], Stream]


def _beside(path: str) -> Opener:
    """Opens files named in an image, in its folder. A name that leads out of it is not followed."""
    folder = os.path.dirname(path)

    def open_(name: str) -> Stream:
        return FileStream(os.path.join(folder, os.path.basename(name.replace("\\", "/"))))

    return open_


# ---- raw ----------------------------------------------------------------------------------------------------------------


def open_raw(path: str) -> Image:
    """One file, or the numbered files .001, .002, ... as one medium."""
    if not re.search(r"\.0*1$", path):
        return Image("raw", FileStream(path))
    files, blocks, at = [], [], 0
    stem, number = path[: -len(path.rsplit(".", 1)[1])], path.rsplit(".", 1)[1]
    for k in range(int(number), 1 << 20):
        if not os.path.exists(name := f"{stem}{k:0{len(number)}d}"):
            break
        files.append(FileStream(name))
        blocks.append(Block(at, files[-1].size, 0, files[-1].size, segment=len(files) - 1))
        at += files[-1].size
    return Image("raw", BlockStream(blocks, files, at))


# ---- EWF ------------------------------------------------------------------------------------------------------------------


def ewf_segment_name(first: str, number: int) -> str:
    """The extension of a segment file: E01 to E99, then EAA to EZZ, FAA and on; the case and letter are the first's."""
    lead = first[0]
    if number < 100:
        return f"{lead}{number:02d}"
    a, rest = divmod(number - 100, 26 * 26)
    top = chr(ord(lead) + a)
    if top.lower() > "z" or not top.isalpha():
        raise ValueError(f"no name for segment {number}")
    low = ord("a" if lead.islower() else "A")
    return top + chr(low + rest // 26) + chr(low + rest % 26)


#: Keys of the header's values.
EWF_KEYS = {
    "a": "description", "c": "case_number", "n": "evidence_number", "e": "examiner_name", "t": "notes", "av": "version", "ov": "platform", "m": "acquisition_date",
    "u": "system_date", "p": "password_hash", "pid": "process_identifier", "dc": "unknown_dc", "ext": "extents", "r": "compression_level", "md": "model", "sn": "serial_number", "l": "device_label",
}


def _ewf_header(data: bytes) -> dict[str, str]:
    raw = zlib.decompress(data)
    text = raw.decode("utf-16") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else raw.decode("latin-1")
    lines = text.replace("\r", "").split("\n")
    if len(lines) < 4:
        return {}
    return {EWF_KEYS.get(k, k): v for k, v in zip(lines[2].split("\t"), lines[3].split("\t"))}


def open_ewf(path: str) -> Image:
    image, files, blocks = Image("ewf", Stream()), [], []
    chunk = sectors = count = 0
    at, ended = 0, False
    stem, first = path[: path.rfind(".") + 1], path[path.rfind(".") + 1 :]
    while not ended:
        name = stem + ewf_segment_name(first, len(files) + 1)
        f = FileStream(name)
        if f.read_at(0, 8) != b"EVF\x09\x0d\x0a\xff\x00":
            raise ValueError(f"no EWF segment file: {name}")
        if struct.unpack("<H", f.read_at(9, 2))[0] != len(files) + 1:
            raise ValueError("segments out of order")
        files.append(f)
        seg, here, sectors_end = len(files) - 1, 13, 0
        while True:
            raw = f.read_at(here, 76)
            kind = raw[:16].rstrip(b"\0").decode("ascii", "replace")
            next_, size = struct.unpack_from("<QQ", raw, 16)
            if zlib.adler32(raw[:72]) != struct.unpack_from("<I", raw, 72)[0]:
                raise ValueError(f"damaged section at {here}")
            data = lambda n, here=here, f=f: f.read_at(here + 76, n)
            if kind in ("header", "header2"):
                image.info |= _ewf_header(data(size - 76))
            elif kind in ("volume", "disk", "data"):
                v = data(94)
                count, per, sector = struct.unpack_from("<III", v, 4)
                sectors = struct.unpack_from("<Q", v, 16)[0] if size - 76 > 94 else struct.unpack_from("<I", v, 16)[0]
                chunk = per * sector
                image.info |= {"bytes_per_sector": str(sector), "sectors_per_chunk": str(per), "number_of_sectors": str(sectors), "number_of_chunks": str(count)}
                if size - 76 > 94:
                    full = data(1052)
                    image.info |= {"media_type": str(full[0]), "set_identifier": str(uuid.UUID(bytes_le=full[64:80]))}
            elif kind == "sectors":
                sectors_end = here + size
            elif kind == "table":
                n, base = struct.unpack_from("<I4xQ", data(24))
                entries = struct.unpack(f"<{n}I", f.read_at(here + 100, 4 * n))
                over = False
                for k, e in enumerate(entries):
                    packed, offset = bool(e >> 31) and not over, (e & 0x7FFFFFFF) if not over else e
                    if k + 1 < n:
                        following = entries[k + 1] & 0x7FFFFFFF if not over else entries[k + 1]
                        if not over and following < offset and entries[k + 1] >= 0x80000000 > offset:
                            over, following = True, entries[k + 1]
                        length = following - offset
                    else:
                        length = (sectors_end or here) - base - offset
                    media = min(chunk, sectors * int(image.info["bytes_per_sector"]) - at)
                    blocks.append(Block(at, media, base + offset, length if packed else media, "compressed" if packed else "in_file", seg, "zlib"))
                    at += media
            elif kind == "hash":
                image.stored["md5"] = data(16).hex()
            elif kind == "digest":
                v = data(36)
                image.stored |= {"md5": v[:16].hex(), "sha1": v[16:36].hex()}
            elif kind == "error2":
                n = struct.unpack("<I", data(4))[0]
                image.errors = [struct.unpack("<II", f.read_at(here + 76 + 520 + 8 * k, 8)) for k in range(n)]
            if kind == "done":
                ended = True
                break
            if kind == "next" or next_ <= here:
                break
            here = next_
    image.media = BlockStream(blocks, files, sectors * int(image.info["bytes_per_sector"]))
    return image


# ---- QCOW -----------------------------------------------------------------------------------------------------------------


def open_qcow(path: str, depth: int = 0) -> Image:
    """Versions 1 to 3. What no table describes is the backing file's, or zero; compressed clusters are decoded; encrypted images are refused."""
    f = FileStream(path)
    h = f.read_at(0, 104)
    magic, version = struct.unpack_from(">4sI", h)
    if magic != b"QFI\xfb" or version not in (1, 2, 3):
        raise ValueError("no QCOW image")
    backing_at, backing_n = struct.unpack_from(">QI", h, 8)
    if version == 1:
        size, bits, l2_bits, crypt, l1_at = struct.unpack_from(">QBB2xIQ", h, 24)
        l1_n = -(-size // (1 << bits + l2_bits))
        flag, mask = 1 << 63, (1 << 63) - 1
    else:
        bits, size, crypt, l1_n, l1_at = struct.unpack_from(">IQIIQ", h, 20)
        l2_bits, flag, mask = bits - 3, 1 << 62, 0x00FFFFFFFFFFFE00
    if crypt:
        raise ValueError("encrypted image")
    backing = f.read_at(backing_at, backing_n).decode() if backing_at else ""
    parent = open_any(os.path.join(os.path.dirname(path), os.path.basename(backing)), depth + 1) if backing and depth < 64 else None
    cluster, missing = 1 << bits, "in_parent" if parent else "sparse"
    blocks, whole = [], 1 << bits + l2_bits
    for i, l2 in enumerate(struct.unpack(f">{l1_n}Q", f.read_at(l1_at, 8 * l1_n))):
        at, l2 = i * whole, l2 & mask
        if not l2:
            blocks.append(Block(at, min(whole, size - at), kind=missing))
            continue
        for k, e in enumerate(struct.unpack(f">{1 << l2_bits}Q", f.read_at(l2, 8 << l2_bits))):
            here = at + k * cluster
            n = min(cluster, size - here)
            if n <= 0:
                break
            if e & flag:
                if version == 1:
                    shift = 63 - bits
                    start, length = e & (1 << shift) - 1, e >> shift & cluster - 1
                else:
                    shift = 62 - (bits - 8)
                    start = e & (1 << shift) - 1
                    length = ((e & (1 << 62) - 1) >> shift) * 512 + 512 - start % 512
                blocks.append(Block(here, n, start, length, "compressed", 0, "qcow"))
            elif version == 3 and e & 1:
                blocks.append(Block(here, n, kind="sparse"))
            elif e & mask:
                blocks.append(Block(here, n, e & mask, n))
            else:
                blocks.append(Block(here, n, kind=missing))
    info = {"format_version": str(version), "media_size": str(size), "backing_file": backing}
    return Image("qcow", BlockStream(blocks, [f], size, parent.media if parent else None), info, layers=1 + (parent.layers if parent else 0))


# ---- VHD ----------------------------------------------------------------------------------------------------------------


def _vhd_footer(f: Stream) -> bytes:
    h = f.read_at(f.size - 512, 512)
    if h[:8] != b"conectix":
        h = f.read_at(0, 512)
    if h[:8] != b"conectix":
        raise ValueError("no VHD image")
    return h


def open_vhd(path: str, depth: int = 0) -> Image:
    f = FileStream(path)
    h = _vhd_footer(f)
    next_, = struct.unpack_from(">Q", h, 16)
    size, = struct.unpack_from(">Q", h, 48)
    kind, = struct.unpack_from(">I", h, 60)
    info = {"disk_type": {2: "fixed", 3: "dynamic", 4: "differential"}.get(kind, str(kind)), "media_size": str(size), "identifier": str(uuid.UUID(bytes=h[68:84]))}
    if kind == 2:
        return Image("vhd", BlockStream([Block(0, size, 0, size)], [f], size), info)
    d = f.read_at(next_, 1024)
    if d[:8] != b"cxsparse":
        raise ValueError("no dynamic disk header")
    bat, = struct.unpack_from(">Q", d, 16)
    n, block = struct.unpack_from(">II", d, 28)
    info["block_size"] = str(block)
    parent = None
    if kind == 4:
        name = d[64:576].decode("utf-16-be").split("\0")[0]
        info |= {"parent_identifier": str(uuid.UUID(bytes=d[40:56])), "parent_name": name}
        parent = open_vhd(os.path.join(os.path.dirname(path), os.path.basename(name.replace("\\", "/"))), depth + 1)
        if parent.info["identifier"] != info["parent_identifier"]:
            raise ValueError("another parent was found")
    bitmap = -(-(block // 512) // 8)
    bitmap = -(-bitmap // 512) * 512
    blocks = []
    for k, e in enumerate(struct.unpack(f">{n}I", f.read_at(bat, 4 * n))):
        at = k * block
        m = min(block, size - at)
        if m <= 0:
            break
        if e == 0xFFFFFFFF:
            blocks.append(Block(at, m, kind="in_parent" if parent else "sparse"))
        elif not parent:
            blocks.append(Block(at, m, e * 512 + bitmap, m))
        else:
            blocks += _by_bitmap(f.read_at(e * 512, bitmap), at, m, e * 512 + bitmap, 512, high_first=True)
    return Image("vhd", BlockStream(blocks, [f], size, parent.media if parent else None), info, layers=1 + (parent.layers if parent else 0))


def _by_bitmap(bits: bytes, at: int, size: int, data: int, sector: int, high_first: bool, start: int = 0) -> list[Block]:
    """Runs of sectors that are here or in the parent."""
    out, k, n = [], 0, -(-size // sector)
    is_set = lambda i: bits[(start + i) >> 3] >> (7 - (start + i & 7) if high_first else start + i & 7) & 1
    while k < n:
        here, j = is_set(k), k
        while j < n and is_set(j) == here:
            j += 1
        m = min(size, j * sector) - k * sector
        out.append(Block(at + k * sector, m, data + k * sector, m) if here else Block(at + k * sector, m, kind="in_parent"))
        k = j
    return out


# ---- VHDX -----------------------------------------------------------------------------------------------------------------

#: Identifiers of the region table and of metadata items.
_BAT, _META = "2dc27766-f623-4200-9d64-115e9bfd4a08", "8b7ca206-4790-4b9a-b8fe-575f050f886e"
_ITEMS = {
    "caa16737-fa36-4d43-b3b6-33f0aa44e76b": "parameters", "2fa54224-cd1b-4876-b211-5dbed83bf4b8": "size", "beca12ab-b2e6-4523-93ef-c309e000c746": "identifier",
    "8141bf1d-a96f-4709-ba47-f233a8faab5f": "logical_sector", "cda348c7-445d-4471-9cc9-e9885251c556": "physical_sector", "a8d35f2d-b30b-454d-abf7-d3d84834ab0c": "parent",
}


def open_vhdx(path: str, depth: int = 0) -> Image:
    f = FileStream(path)
    if f.read_at(0, 8) != b"vhdxfile":
        raise ValueError("no VHDX image")
    regions: dict[str, tuple[int, int]] = {}
    for table in (192 << 10, 256 << 10):
        r = f.read_at(table, 65536)
        if r[:4] == b"regi":
            for k in range(struct.unpack_from("<I", r, 8)[0]):
                e = r[16 + 32 * k : 48 + 32 * k]
                regions[str(uuid.UUID(bytes_le=e[:16]))] = struct.unpack_from("<QI", e, 16)
            break
    at, n = regions[_META]
    m = f.read_at(at, 65536)
    items: dict[str, bytes] = {}
    for k in range(struct.unpack_from("<H", m, 10)[0]):
        e = m[32 + 32 * k : 64 + 32 * k]
        offset, size = struct.unpack_from("<II", e, 16)
        items[_ITEMS.get(str(uuid.UUID(bytes_le=e[:16])), "other")] = f.read_at(at + offset, size)
    block, flags = struct.unpack("<II", items["parameters"][:8])
    size, = struct.unpack("<Q", items["size"])
    sector, = struct.unpack("<I", items["logical_sector"])
    differs = bool(flags & 2)
    info = {"media_size": str(size), "block_size": str(block), "bytes_per_sector": str(sector), "identifier": str(uuid.UUID(bytes_le=items["identifier"])), "disk_type": "differential" if differs else "fixed" if flags & 1 else "dynamic"}
    parent = None
    if differs:
        p = items["parent"]
        values = {}
        for k in range(struct.unpack_from("<H", p, 18)[0]):
            ko, vo, kn, vn = struct.unpack_from("<IIHH", p, 20 + 12 * k)
            values[p[ko : ko + kn].decode("utf-16-le")] = p[vo : vo + vn].decode("utf-16-le")
        info |= {"parent_identifier": values.get("parent_linkage", "").strip("{}").lower(), "parent_name": values.get("relative_path") or values.get("absolute_win32_path", "")}
        parent = open_vhdx(os.path.join(os.path.dirname(path), os.path.basename(info["parent_name"].replace("\\", "/"))), depth + 1)
    per = (1 << 23) * sector // block  # blocks that one sector bitmap describes
    bat_at, _ = regions[_BAT]
    count = -(-size // block)
    entries = count + (count - 1) // per if not differs else -(-count // per) * (per + 1)
    bat = struct.unpack(f"<{entries}Q", f.read_at(bat_at, 8 * entries))
    blocks = []
    for k in range(count):
        e, here = bat[k + k // per], k * block
        m, state, data = min(block, size - here), e & 7, (e >> 20) << 20
        if state == 6:
            blocks.append(Block(here, m, data, m))
        elif differs and state == 7:
            bits = (bat[(k // per + 1) * (per + 1) - 1] >> 20) << 20
            first = k % per * block // sector
            raw = f.read_at(bits + first // 8, -(-(block // sector) // 8))
            blocks += _by_bitmap(raw, here, m, data, sector, high_first=False)
        else:
            blocks.append(Block(here, m, kind="in_parent" if differs and state == 0 else "sparse"))
    return Image("vhdx", BlockStream(blocks, [f], size, parent.media if parent else None), info, layers=1 + (parent.layers if parent else 0))


# ---- Apple: UDIF, sparse image, sparse bundle ---------------------------------------------------------------------------------

#: Kinds of UDIF blocks.
UDIF_CODECS = {0x80000004: "adc", 0x80000005: "zlib", 0x80000006: "bzip2", 0x80000007: "lzfse", 0x80000008: "lzma"}


def open_udif(path: str) -> Image:
    f = FileStream(path)
    h = f.read_at(f.size - 512, 512)
    if h[:4] != b"koly":
        raise ValueError("no UDIF image")
    data_at, data_n = struct.unpack_from(">QQ", h, 24)
    xml_at, xml_n = struct.unpack_from(">QQ", h, 216)
    sectors, = struct.unpack_from(">Q", h, 492)
    info = {"media_size": str(sectors * 512), "format_version": str(struct.unpack_from(">I", h, 4)[0])}
    if not xml_n:
        return Image("udif", BlockStream([Block(0, sectors * 512, data_at, data_n)], [f], sectors * 512), info)
    blocks, methods = [], set()
    for part in plistlib.loads(f.read_at(xml_at, xml_n))["resource-fork"]["blkx"]:
        t = part["Data"]
        base, = struct.unpack_from(">Q", t, 8)
        start, = struct.unpack_from(">Q", t, 24)
        for k in range(struct.unpack_from(">I", t, 200)[0]):
            kind, _, first, n, offset, length = struct.unpack_from(">IIQQQQ", t, 204 + 40 * k)
            at, m = (base + first) * 512, n * 512
            if kind in (0, 2):
                blocks.append(Block(at, m, kind="sparse"))
            elif kind == 1:
                blocks.append(Block(at, m, data_at + start + offset, m))
            elif kind in UDIF_CODECS:
                methods.add(UDIF_CODECS[kind])
                blocks.append(Block(at, m, data_at + start + offset, length, "compressed", 0, UDIF_CODECS[kind]))
            elif kind not in (0x7FFFFFFE, 0xFFFFFFFF):
                raise ValueError(f"unknown block kind {kind:#x}")
    if len(methods) > 1:
        raise ValueError("mixed compression")
    return Image("udif", BlockStream(blocks, [f], sectors * 512), info | {"compression": "".join(methods)})


def open_sparseimage(path: str) -> Image:
    f = FileStream(path)
    h = f.read_at(0, 4096)
    if h[:4] != b"sprs":
        raise ValueError("no sparse image")
    per, = struct.unpack_from(">I", h, 8)
    sectors, = struct.unpack_from(">I", h, 16)
    band, size = per * 512, sectors * 512
    blocks = []
    for k, number in enumerate(struct.unpack(">1008I", h[64:])):
        at = (number - 1) * band
        if number and at < size:
            blocks.append(Block(at, min(band, size - at), 4096 + k * band, band))
    return Image("sparseimage", BlockStream(blocks, [f], size), {"media_size": str(size), "band_size": str(band)})


def open_sparsebundle(path: str) -> Image:
    with open(os.path.join(path, "Info.plist"), "rb") as p:
        info = plistlib.load(p)
    band, size = int(info["band-size"]), int(info["size"])
    files, blocks = [], []
    for k in range(-(-size // band)):
        name = os.path.join(path, "bands", f"{k:x}")
        if os.path.exists(name):
            files.append(FileStream(name))
            blocks.append(Block(k * band, min(band, files[-1].size, size - k * band), 0, band, segment=len(files) - 1))
    return Image("sparsebundle", BlockStream(blocks, files, size), {"media_size": str(size), "band_size": str(band)})


def plist_json(data: bytes) -> str:
    """A property list as JSON; data in base64, dates in ISO form."""
    import base64
    import datetime
    import json

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, bytes):
            return base64.b64encode(x).decode()
        return x.isoformat() if isinstance(x, datetime.datetime) else x

    return json.dumps(plain(plistlib.loads(data)), ensure_ascii=False)


_OPEN = {"ewf": open_ewf, "qcow": open_qcow, "vhd": open_vhd, "vhdx": open_vhdx, "udif": open_udif, "sparseimage": open_sparseimage, "sparsebundle": open_sparsebundle, "raw": open_raw}


def detect(f: Stream) -> str:
    """The image format by signature; raw if none."""
    head, tail = f.read_at(0, 8), f.read_at(max(0, f.size - 512), 8)
    for mark, name in ((b"EVF\x09\x0d\x0a\xff\x00", "ewf"), (b"QFI\xfb", "qcow"), (b"vhdxfile", "vhdx"), (b"sprs", "sparseimage")):
        if head.startswith(mark):
            return name
    return "udif" if tail[:4] == b"koly" else "vhd" if tail == b"conectix" or head == b"conectix" else "raw"


def open_any(path: str, depth: int = 0) -> Image:
    if os.path.isdir(path):
        return open_sparsebundle(path)
    kind = detect(FileStream(path))
    return _OPEN[kind](path, depth) if kind in ("qcow", "vhd", "vhdx") else _OPEN[kind](path)
