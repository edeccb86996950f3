"""Fixed binary layouts as Column expressions.

A layout is a list of fields; `parse` makes one struct expression of them, evaluated in the JVM. Unsigned 64-bit values
are DECIMAL(20,0), 32-bit ones BIGINT.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTH = {"u8": 1, "i8": 1, "u16": 2, "i16": 2, "u32": 4, "i32": 4, "u64": 8, "i64": 8}


@dataclass(frozen=True)
class Field:
    """kind: u8 to i64, bytes, char (NUL-ended text), ucs2 (NUL-ended UTF-16), uuid, hex, or struct; size in bytes where the kind has none; count for arrays; order: le or be, by default the layout's; when: the least structure size from which the field exists."""

    name: str
    kind: str
    size: int = 0
    count: int = 0
    order: str | None = None
    when: int = 0
    layout: Layout | None = None

    @property
    def width(self) -> int:
        one = _WIDTH.get(self.kind) or (16 if self.kind == "uuid" else self.layout.size if self.layout else self.size)
        return one * max(1, self.count)


@dataclass(frozen=True)
class Layout:
    name: str
    fields: tuple[Field, ...]
    order: str = "le"

    @property
    def size(self) -> int:
        return sum(f.width for f in self.fields)

    def offsets(self) -> dict[str, int]:
        out, at = {}, 0
        for f in self.fields:
            out[f.name] = at
            at += f.width
        return out


def unsigned(data: Column, offset: int, width: int, order: str = "le") -> Column:
    """An unsigned integer at a byte offset; null where the data ends before."""
    at = offset + 1
    if order == "le" and width > 1:
        raw = F.concat(*(F.substring(data, at + k, 1) for k in reversed(range(width))))
    else:
        raw = F.substring(data, at, width)
    h = F.hex(raw)
    value = F.conv(h, 16, 10).cast("decimal(20,0)" if width == 8 else "long")
    return F.when(F.octet_length(data) >= offset + width, value)


def signed(data: Column, offset: int, width: int, order: str = "le") -> Column:
    v = unsigned(data, offset, width, order)
    half, whole = 1 << (8 * width - 1), 1 << (8 * width)
    if width == 8:
        whole_ = F.lit(str(whole)).cast("decimal(20,0)")
        return F.when(v >= F.lit(str(half)).cast("decimal(20,0)"), v - whole_).otherwise(v).cast("long")
    return F.when(v >= half, v - whole).otherwise(v)


def _one(data: Column, f: Field, at: int, order: str) -> Column:
    if f.kind in _WIDTH:
        return (unsigned if f.kind[0] == "u" else signed)(data, at, _WIDTH[f.kind], order)
    size = 16 if f.kind == "uuid" else f.layout.size if f.layout else f.size
    raw = F.substring(data, at + 1, size)
    if f.kind == "char":
        return F.regexp_extract(F.decode(raw, "ISO-8859-1"), r"^([^\x00]*)", 1)
    if f.kind == "ucs2":
        return F.regexp_extract(F.decode(raw, "UTF-16LE" if order == "le" else "UTF-16BE"), r"^([^\x00]*)", 1)
    if f.kind == "hex":
        return F.lower(F.hex(raw))
    if f.kind == "uuid":
        from sedira.functions.text import uuid_be, uuid_le

        return (uuid_le if order == "le" else uuid_be)(raw)
    if f.kind == "struct":
        return parse(raw, f.layout)
    return raw


def parse(data: Column, layout: Layout, size: Column | None = None) -> Column:
    """A struct of the layout's fields. `size`: the structure's own size, for fields that depend on it."""
    out, at = [], 0
    for f in layout.fields:
        order = f.order or layout.order
        step = f.width // max(1, f.count)
        value = F.array(*(_one(data, f, at + k * step, order) for k in range(f.count))) if f.count else _one(data, f, at, order)
        if f.when and size is not None:
            value = F.when(size >= f.when, value)
        out.append(value.alias(f.name))
        at += f.width
    return F.struct(*out)
