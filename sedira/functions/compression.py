"""Decoders of the compressed streams of images and file systems, and `decompress`, which applies one to a column by Arrow.

Each decoder takes bytes (and the size of the output where the format does not say it) and returns bytes; damaged input
raises ValueError, which the column function turns into null. They are written after the public format descriptions.
"""

from __future__ import annotations

import bz2
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _copy(out: bytearray, distance: int, length: int) -> None:
    """Appends `length` bytes from `distance` back; they may overlap what is appended."""
    at = len(out) - distance
    if distance <= 0 or at < 0:
        raise ValueError("a match starts before the output")
    if distance >= length:
        out += out[at : at + length]
    else:
        part = bytes(out[at:])
        out += (part * (length // distance + 1))[:length]


def adc(data: bytes, size: int | None = None) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (size is None or len(out) < size):
        b = data[at]
        if b & 0x80:
            n = (b & 0x7F) + 1
            out += data[at + 1 : at + 1 + n]
            at += 1 + n
        elif b & 0x40:
            _copy(out, (data[at + 1] << 8 | data[at + 2]) + 1, (b & 0x3F) + 4)
            at += 3
        else:
            _copy(out, ((b & 3) << 8 | data[at + 1]) + 1, (b >> 2) + 3)
            at += 2
    return bytes(out)


def lznt1(data: bytes, size: int | None = None) -> bytes:
    """Chunks of 4096 bytes; the split of a match's 16 bits into distance and length moves with the place in the chunk."""
    out, at = bytearray(), 0
    while at + 2 <= len(data) and (size is None or len(out) < size):
        head = data[at] | data[at + 1] << 8
        if not head:
            break
        end = at + 3 + (head & 0xFFF)
        at += 2
        if not head & 0x8000:
            out += data[at:end]
        else:
            start, top = len(out), min(end, len(data))
            while at < top:
                flags, at, k = data[at], at + 1, 0
                while k < 8 and at < end:
                    rest = flags >> k
                    if not rest & 1:  # literals up to the next match, at once
                        n = min((rest & -rest).bit_length() - 1 if rest else 8 - k, end - at)
                        if at + n > len(data):
                            raise IndexError("a chunk ends early")
                        out += data[at : at + n]
                        at += n
                        k += n
                        continue
                    pair = data[at] | data[at + 1] << 8
                    at += 2
                    k += 1
                    bits = 16 - max(4, (len(out) - start - 1).bit_length())
                    far, n = (pair >> bits) + 1, (pair & (1 << bits) - 1) + 3
                    if far >= n and (back := len(out) - far) >= 0:
                        out += out[back : back + n]
                    else:
                        _copy(out, far, n)
        at = end
    return bytes(out if size is None else out[:size])


# ---- LZVN and LZFSE ---------------------------------------------------------------------------------------------------


def lzvn(data: bytes, size: int | None = None) -> bytes:
    out, at, far = bytearray(), 0, 0
    while at < len(data) and (size is None or len(out) < size):
        b = data[at]
        low = b & 7
        literals = match = 0
        if b == 0x06:
            break
        if b in (0x0E, 0x16):
            at += 1
            continue
        if b >= 0xF0:
            match, at = (data[at + 1] + 16, at + 2) if b == 0xF0 else (b & 15, at + 1)
        elif b >= 0xE0:
            literals, at = (data[at + 1] + 16, at + 2) if b == 0xE0 else (b & 15, at + 1)
        elif 0xA0 <= b < 0xC0:
            more = data[at + 1] | data[at + 2] << 8
            literals, match, far = b >> 3 & 3, (low << 2 | more & 3) + 3, more >> 2
            at += 3
        elif 0x70 <= b < 0x80 or 0xD0 <= b or low == 6 and b < 0x40:
            raise ValueError(f"undefined operation {b:#x}")
        else:
            literals, match = b >> 6, (b >> 3 & 7) + 3
            if low == 6:
                at += 1
            elif low == 7:
                far = data[at + 1] | data[at + 2] << 8
                at += 3
            else:
                far = low << 8 | data[at + 1]
                at += 2
        out += data[at : at + literals]
        at += literals
        if match:
            _copy(out, far, match)
    return bytes(out if size is None else out[:size])


class _Back:
    """Bits read from the end of a payload; the last byte may hold fewer than eight."""

    def __init__(self, data: bytes, bits: int):
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data) + bits

    def pull(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("out of bits")
        return self.value >> self.left & (1 << n) - 1


def _fse(freq: list[int], states: int) -> list[tuple[int, int, int]]:
    """(symbol, bits, base of the next state) of each state."""
    out = []
    for symbol, f in enumerate(freq):
        if f:
            k = states.bit_length() - f.bit_length()
            wide = (2 * states >> k) - f
            out += [(symbol, k, (f + j << k) - states) if j < wide else (symbol, k - 1, j - wide << k - 1) for j in range(f)]
    return out


def _ranges(extra: list[int]) -> list[tuple[int, int]]:
    """(extra bits, base) of value symbols: each starts where the one before ends."""
    out, base = [], 0
    for n in extra:
        out.append((n, base))
        base += 1 << n
    return out


_L = _ranges([0] * 16 + [2, 3, 5, 8])
_M = _ranges([0] * 16 + [3, 5, 8, 11])
_D = _ranges([k // 4 for k in range(64)])


def _frequencies(data: bytes, n: int = 360) -> list[int]:
    """Variable-length codes of small counts, least bits first."""
    bits, out = int.from_bytes(data, "little"), []
    for _ in range(n):
        b = bits & 31
        if b & 1 == 0:
            v, k = b >> 1 & 1, 2
        elif b & 3 == 1:
            v, k = 2 + (b >> 2 & 1), 3
        elif b & 7 == 3:
            v, k = 4 + (b >> 3), 5
        elif b & 15 == 7:
            v, k = 8 + (bits >> 4 & 15), 8
        else:
            v, k = 24 + (bits >> 4 & 1023), 14
        out.append(v)
        bits >>= k
    return out


def _lzfse_block(out: bytearray, h: dict, freq: list[int], payload: bytes) -> None:
    tables = [_fse(freq[a:b], n) for a, b, n in ((0, 20, 64), (20, 40, 64), (40, 104, 256), (104, 360, 1024))]
    split = h["literal_bytes"]
    bits, states, literals = _Back(payload[:split], h["literal_bits"]), list(h["literal_states"]), bytearray()
    table = tables[3]
    for k in range(h["literals"]):
        symbol, n, base = table[states[k & 3]]
        states[k & 3] = base + bits.pull(n)
        literals.append(symbol)
    bits, states = _Back(payload[split : split + h["lmd_bytes"]], h["lmd_bits"]), list(h["lmd_states"])
    at = far = 0
    for _ in range(h["matches"]):
        got = []
        for k, values in enumerate((_L, _M, _D)):
            symbol, n, base = tables[k][states[k]]
            extra, start = values[symbol]
            v = bits.pull(n + extra)
            states[k] = base + (v >> extra)
            got.append(start + (v & (1 << extra) - 1))
        out += literals[at : at + got[0]]
        at += got[0]
        far = got[2] or far
        if got[1]:
            _copy(out, far, got[1])


def lzfse(data: bytes, size: int | None = None) -> bytes:
    out, at = bytearray(), 0
    while at + 4 <= len(data):
        mark = data[at : at + 4]
        if mark == b"bvx$":
            break
        raw = struct.unpack_from("<I", data, at + 4)[0]
        want = len(out) + raw
        if mark == b"bvx-":
            out += data[at + 8 : at + 8 + raw]
            at += 8 + raw
        elif mark == b"bvxn":
            n = struct.unpack_from("<I", data, at + 8)[0]
            out += lzvn(data[at + 12 : at + 12 + n], raw)
            at += 12 + n
        elif mark == b"bvx2":
            a, b, c = struct.unpack_from("<QQQ", data, at + 8)
            head = c & 0xFFFFFFFF
            h = {
                "literals": a & 0xFFFFF, "literal_bytes": a >> 20 & 0xFFFFF, "matches": a >> 40 & 0xFFFFF, "literal_bits": (a >> 60 & 7) - 7,
                "literal_states": [b >> 10 * k & 1023 for k in range(4)], "lmd_bytes": b >> 40 & 0xFFFFF, "lmd_bits": (b >> 60 & 7) - 7,
                "lmd_states": [c >> 32 + 10 * k & 1023 for k in range(3)],
            }
            freq = _frequencies(data[at + 32 : at + head]) if head > 32 else [0] * 360
            end = at + head + h["literal_bytes"] + h["lmd_bytes"]
            _lzfse_block(out, h, freq, data[at + head : end])
            at = end
        elif mark == b"bvx1":
            v = struct.unpack_from("<IIIIIi4Hi3H360H", data, at + 8)
            h = {"literals": v[1], "matches": v[2], "literal_bytes": v[3], "lmd_bytes": v[4], "literal_bits": v[5], "literal_states": v[6:10], "lmd_bits": v[10], "lmd_states": v[11:14]}
            head = 772
            end = at + head + h["literal_bytes"] + h["lmd_bytes"]
            _lzfse_block(out, h, list(v[14:]), data[at + head : end])
            at = end
        else:
            raise ValueError(f"unknown block {mark!r}")
        if len(out) != want:
            raise ValueError("a block's size does not fit")
    return bytes(out if size is None else out[:size])


# ---- Huffman codes ------------------------------------------------------------------------------------------------------


def _codes(lengths: list[int]) -> tuple[list[tuple[int, int] | None], int]:
    """A table of (symbol, length) by the next `width` bits, of a canonical code."""
    width = max(lengths, default=0)
    table: list[tuple[int, int] | None] = [None] * (1 << width)
    at = 0
    for n in range(1, width + 1):
        for symbol, length in enumerate(lengths):
            if length == n:
                step = 1 << width - n
                table[at : at + step] = [(symbol, n)] * step
                at += step
                if at > len(table):
                    raise ValueError("too many codes")
    return table[: 1 << width], width


class _Words:
    """Bits from the top of little-endian 16-bit words."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.bits, self.n = data, at, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            w = self.data[self.at : self.at + 2]
            self.bits = self.bits << 16 | int.from_bytes(w, "little")
            self.at += 2
            self.n += 16
            if self.at > len(self.data) + 8:
                raise ValueError("out of bits")

    def pull(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.n -= n
        v = self.bits >> self.n
        self.bits &= (1 << self.n) - 1
        return v

    def fill(self) -> None:
        """A word more if fewer than 16 bits are held."""
        if self.n < 16:
            self.need(self.n + 16)

    def symbol(self, code: tuple) -> int:
        table, width = code
        self.need(width)
        hit = table[self.bits >> self.n - width] if width else None
        if hit is None:
            raise ValueError("no such code")
        self.n -= hit[1]
        self.bits &= (1 << self.n) - 1
        return hit[0]


# ---- LZX ------------------------------------------------------------------------------------------------------------------


def lzx(data: bytes, size: int = 32768, window: int = 32768, call_size: int = 12_000_000) -> bytes:
    """One chunk, as WOF and WIM store it: blocks of verbatim, aligned or uncompressed kind, then calls put back."""
    slots: list[tuple[int, int]] = []
    base, k = 0, 0
    while base < window:
        extra = 0 if k < 4 else min(17, k // 2 - 1)
        slots.append((extra, base))
        base += 1 << extra
        k += 1
    main, length = [0] * (256 + 8 * len(slots)), [0] * 249
    bits, out, recent = _Words(data), bytearray(), [1, 1, 1]

    def read(into: list[int], a: int, b: int) -> None:
        pre = _codes([bits.pull(4) for _ in range(20)])
        k = a
        while k < b:
            s = bits.symbol(pre)
            if s < 17:
                into[k] = (into[k] - s) % 17
                k += 1
                continue
            n = bits.pull(4) + 4 if s == 17 else bits.pull(5) + 20 if s == 18 else bits.pull(1) + 4
            v = 0 if s < 19 else (into[k] - bits.symbol(pre)) % 17
            into[k : min(k + n, b)] = [v] * (min(k + n, b) - k)
            k += n

    while len(out) < size:
        kind = bits.pull(3)
        left = 32768 if bits.pull(1) else bits.pull(16)
        if kind == 3:
            # to the next 16-bit boundary, a whole word on if there already; words read ahead are given back
            bits.at += (2 if bits.n % 16 == 0 else 0) - 2 * (bits.n // 16)
            bits.bits = bits.n = 0
            recent = list(struct.unpack_from("<III", data, bits.at))
            out += data[bits.at + 12 : bits.at + 12 + left]
            bits.at += 12 + left + (left & 1)
            continue
        if kind not in (1, 2):
            raise ValueError(f"unknown block type {kind}")
        aligned = _codes([bits.pull(3) for _ in range(8)]) if kind == 2 else None
        read(main, 0, 256)
        read(main, 256, len(main))
        read(length, 0, 249)
        main_code, length_code = _codes(main), _codes(length)
        end = min(size, len(out) + left)
        while len(out) < end:
            s = bits.symbol(main_code)
            if s < 256:
                out.append(s)
                continue
            n, slot = (s - 256) % 8 + 2, (s - 256) // 8
            if n == 9:
                n += bits.symbol(length_code)
            if slot < 3:
                far = recent[slot]
                recent[slot] = recent[0]
                recent[0] = far
            else:
                extra, start = slots[slot]
                if aligned and extra >= 3:
                    far = (bits.pull(extra - 3) << 3) + bits.symbol(aligned)
                else:
                    far = bits.pull(extra)
                far += start - 2
                recent = [far, *recent[:2]]
            _copy(out, far, n)
    return _calls(out[:size], call_size)


def _calls(out: bytearray, call_size: int) -> bytes:
    """x86 call operands were made absolute before compression; they are made relative again."""
    at = 0
    while at < len(out) - 10:
        if out[at] != 0xE8:
            at += 1
            continue
        v = struct.unpack_from("<i", out, at + 1)[0]
        if -at <= v < call_size:
            struct.pack_into("<i", out, at + 1, v - at if v >= 0 else v + call_size)
        at += 5
    return bytes(out)


# ---- LZXPRESS ---------------------------------------------------------------------------------------------------------------


def lzxpress(data: bytes, size: int | None = None) -> bytes:
    """The plain variant: 32 flags at a time, 13-bit distances, lengths that grow by nibble, byte, word."""
    out, at, flags, left, half = bytearray(), 0, 0, 0, None
    while at < len(data) and (size is None or len(out) < size):
        if not left:
            flags, left = struct.unpack_from("<I", data, at)[0], 32
            at += 4
            if at >= len(data):
                break
        if not flags >> left - 1 & 1:  # literals up to the next match, at once
            n = min(left - (flags & (1 << left) - 1).bit_length(), len(data) - at)
            if size is not None:
                n = min(n, size - len(out))
            out += data[at : at + n]
            at += n
            left -= n
            continue
        left -= 1
        pair = data[at] | data[at + 1] << 8
        at += 2
        n = pair & 7
        if n == 7:
            if half is None:
                half, n = at, data[at] & 15
                at += 1
            else:
                n, half = data[half] >> 4, None
            if n == 15:
                n = data[at]
                at += 1
                if n == 255:
                    n = struct.unpack_from("<H", data, at)[0]
                    at += 2
                    if not n:
                        n = struct.unpack_from("<I", data, at)[0]
                        at += 4
                    n -= 22
                n += 15
            n += 7
        n, far = n + 3, (pair >> 3) + 1
        if far >= n and (back := len(out) - far) >= 0:
            out += out[back : back + n]
        else:
            _copy(out, far, n)
    return bytes(out)


def lzxpress_huffman(data: bytes, size: int) -> bytes:
    """Blocks of 64 KiB with a code table each; a match's length may follow in whole bytes."""
    out, at, lengths, code = bytearray(), 0, b"", ([], 0)
    padded = data + bytes(12)  # bits may be read ahead, by 8 bytes and a word
    last, masks = len(data) + 8, [(1 << k) - 1 for k in range(64)]
    while len(out) < size:
        if data[at : at + 256] != lengths:
            lengths = data[at : at + 256]
            code = _codes([n for b in lengths for n in (b & 15, b >> 4)])
        table, width = code
        if not width:
            raise ValueError("no such code")
        at += 256
        bits, held = 0, 0  # `held` bits, from the top of little-endian words: 16 at least before each symbol and each distance
        for _ in range(2):
            bits = bits << 16 | int.from_bytes(padded[at : at + 2], "little")
            at, held = at + 2, held + 16
            if at > last:
                raise ValueError("out of bits")
        end = min(size, len(out) + 65536)
        while len(out) < end:
            hit = table[bits >> held - width]
            if hit is None:
                raise ValueError("no such code")
            s, n = hit
            held -= n
            bits &= masks[held]
            if held < 16:
                if at >= last:
                    raise ValueError("out of bits")
                bits = bits << 16 | padded[at] | padded[at + 1] << 8
                at, held = at + 2, held + 16
            if s < 256:
                out.append(s)
                continue
            n, k = s - 256 & 15, s - 256 >> 4
            if n == 15:
                n = data[at] + 15
                at += 1
                if n == 270:
                    n = struct.unpack_from("<H", data, at)[0]
                    at += 2
                    if not n:
                        n = struct.unpack_from("<I", data, at)[0]
                        at += 4
            held -= k
            far = (1 << k) + (bits >> held)
            bits &= masks[held]
            if held < 16:
                if at >= last:
                    raise ValueError("out of bits")
                bits = bits << 16 | padded[at] | padded[at + 1] << 8
                at, held = at + 2, held + 16
            n += 3
            if far >= n and (back := len(out) - far) >= 0:
                out += out[back : back + n]
            else:
                _copy(out, far, n)
    return bytes(out[:size])


def _qcow(data: bytes, size: int | None) -> bytes:
    """A raw deflate stream that may be followed by padding."""
    return zlib.decompressobj(-15).decompress(data)


def _lzma(data: bytes, size: int | None) -> bytes:
    import lzma

    return lzma.decompress(data)


CODECS = {
    "qcow": _qcow, "lzma": _lzma,
    "zlib": lambda d, n: zlib.decompress(d), "deflate": lambda d, n: zlib.decompress(d, -15), "bzip2": lambda d, n: bz2.decompress(d),
    "adc": adc, "lznt1": lznt1, "lzvn": lzvn, "lzfse": lzfse, "lzx": lambda d, n: lzx(d, n or 32768), "lzxpress": lzxpress, "lzxpress_huffman": lzxpress_huffman,
}


def decompress_bytes(data: bytes, codec: str, size: int | None = None) -> bytes:
    try:
        return CODECS[codec](data, size)
    except (zlib.error, OSError, IndexError, struct.error, EOFError) as e:
        raise ValueError(str(e)) from e


def decompress(data: Column, codec: str, size: Column | None = None) -> Column:
    """The decoded bytes; null where the input is damaged. One block a row: rows are independent, so blocks decode side by side."""
    CODECS[codec]

    @F.pandas_udf("binary")
    def run(values: pd.Series, sizes: pd.Series) -> pd.Series:
        def of(v, n):
            if v is None:
                return None
            try:
                return decompress_bytes(bytes(v), codec, None if pd.isna(n) else int(n))
            except ValueError:
                return None

        return pd.Series([of(v, n) for v, n in zip(values, sizes)])

    return run(data, size if size is not None else F.lit(None).cast("long"))
