"""Paths, escaping, modes, sizes, identifiers and dumps as Column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- paths ----------------------------------------------------------------------------------------------------------


def path_split(path: Column, separator: str = "/") -> Column:
    """Components; of an absolute path the first is empty (the root), and the root alone is one empty component."""
    parts = F.split(path, "\\\\" if separator == "\\" else separator, -1)
    return F.when(path == separator, F.array(F.lit(""))).otherwise(parts)


def path_join(components: Column, separator: str = "/") -> Column:
    return F.when((F.size(components) == 1) & (components[0] == ""), F.lit(separator)).otherwise(F.array_join(components, separator))


def path_parent(components: Column) -> Column:
    return F.slice(components, F.lit(1), F.greatest(F.size(components) - 1, F.lit(0)))


def path_filename(components: Column) -> Column:
    return F.element_at(components, -1)


def file_extension(name: Column) -> Column:
    """Behind the last dot that is not the first character; null without one."""
    found = F.regexp_extract(name, r"(?s)^.[^\x00]*\.([^.]*)$", 1)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), found)


def file_stem(name: Column) -> Column:
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name)


# ---- display ----------------------------------------------------------------------------------------------------------

#: Code points that are no characters, and others that were seen not to print.
UNPRINTABLE = [
    *range(0xFDD0, 0xFDE0),
    *(plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF)),
    0x2028, 0x2029, 0xE000, 0xF8FF, 0xF0000, 0xFFFFD, 0x100000, 0x10FFFD,
]


_RARE = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f" + "".join(f"\\x{{{c:x}}}" for c in UNPRINTABLE) + "]"
#: What most texts are made of; only one that holds something else is looked at more closely.
_UNUSUAL = "[^\\x20-\\x7e\\t\\n\\r\\x{a0}-\\x{1fff}\\x{2030}-\\x{d7ff}]"
#: What is escaped in nearly every text, and how.
_COMMON = [("\\", "\\\\"), ("/", "\\/"), (":", "\\:"), ("\n", "\\x0a"), ("\r", "\\x0d"), ("\t", "\\x09")]


def display_escape(text: Column) -> Column:
    r"""Escapes / : \ by a backslash, control characters as \xNN, what does not print as \UNNNNNNNN: plain replacements for what is common; of the others, only in texts that have any, the distinct ones are found by one pattern and replaced one by one."""
    plain = reduce(lambda t, ab: F.replace(t, F.lit(ab[0]), F.lit(ab[1])), _COMMON, text)

    def code(c: Column) -> Column:
        n = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")
        return F.concat(F.when(n < 0xA0, F.lit("\\x")).otherwise(F.lit("\\U")), F.lpad(F.lower(F.hex(n)), F.when(n < 0xA0, 2).otherwise(8), F.lit("0")))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_RARE})")))
    return F.when(text.rlike(_UNUSUAL), F.aggregate(found, plain, lambda t, c: F.replace(t, c, code(c)))).otherwise(plain)


def display_path(components: Column) -> Column:
    """Escaped components, joined by /; a lone empty one is /."""
    return F.when((F.size(components) == 1) & (components[0] == ""), F.lit("/")).otherwise(F.array_join(F.transform(components, display_escape), "/"))


def layer_display_path(vfs_type: Column, path: Column, identifier: Column | None = None) -> Column:
    """Of a volume: /p1 for /gpt1, /mbr1 and /apm1; with an identifier, /gpt{...}. Other layers add nothing."""
    by_index = F.when(vfs_type.isin("APM", "GPT", "MBR"), F.regexp_replace(path, "apm|gpt|mbr", "p")).otherwise("")
    return by_index if identifier is None else F.when((vfs_type == "GPT") & identifier.isNotNull(), F.concat(F.lit("/gpt{"), identifier, F.lit("}"))).otherwise(by_index)


# ---- modes ------------------------------------------------------------------------------------------------------------

_TYPES = {0x1000: "p", 0x2000: "c", 0x4000: "d", 0x6000: "b", 0xA000: "l", 0xC000: "s"}
_NAMES = {"block_device": "b", "character_device": "c", "directory": "d", "named_pipe": "p", "socket": "s", "symbolic_link": "l", "whiteout": "w"}


def _case(value: Column, table: dict, default: str = "-") -> Column:
    return reduce(lambda c, kv: c.when(value == kv[0], kv[1]), list(table.items())[1:], F.when(value == next(iter(table)), next(iter(table.values())))).otherwise(default)


def mode_string_posix(mode: Column) -> Column:
    bits = [F.when(mode.bitwiseAND(F.lit(0o400 >> k)) != 0, "rwx"[k % 3]).otherwise("-") for k in range(9)]
    return F.concat(_case(mode.bitwiseAND(F.lit(0xF000)), _TYPES), *bits)


def mode_string_dos(file_type: Column, attributes: Column) -> Column:
    """Read-only (1) and system (4) files cannot be written."""
    kind = F.when(file_type == "directory", "d").when(file_type == "symbolic_link", "l").otherwise("-")
    return F.concat(kind, F.when(attributes.bitwiseAND(F.lit(5)) != 0, "r-xr-xr-x").otherwise("rwxrwxrwx"))


def mode_string_type(file_type: Column) -> Column:
    return F.concat(_case(file_type, _NAMES), F.lit("rwxrwxrwx"))


# ---- sizes ------------------------------------------------------------------------------------------------------------

_UNITS = ["", "K", "M", "G", "T", "P", "E"]


def bytesize(value: Column, base: int = 1024) -> Column:
    """One decimal: `512 B`, `2.0 MiB`, `2.1 MB`, as C rounds the quotient's exact double. For base 1024 that is half to even on integers, in the JVM; for base 1000 the double itself decides, by Arrow."""
    if base == 1000:
        return _bytesize_1000(value)
    out = F.concat(value.cast("string"), F.lit(" B"))
    for k, unit in enumerate(_UNITS[1:], 1):
        factor = F.lit(base**k).cast("decimal(20,0)")
        scaled = value.cast("decimal(20,0)") * 10
        q = F.floor(scaled / factor).cast("decimal(20,0)")
        r = (scaled - q * factor) * 2
        tenths = q + ((r > factor) | ((r == factor) & (q % 2 == 1))).cast("int")
        out = F.when(value >= base**k, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("int").cast("string"), F.lit(f" {unit}iB"))).otherwise(out)
    return out


def _bytesize_1000(value: Column) -> Column:
    def of(v: int) -> str:
        k = max((k for k in range(len(_UNITS)) if 1000**k <= v), default=0)
        return f"{v / 1000**k:.1f} {_UNITS[k]}B" if k else f"{v} B"

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else of(int(x)))

    return run(value)


# ---- identifiers, bytes ------------------------------------------------------------------------------------------------


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def _dashed(hex32: Column) -> Column:
    return F.regexp_replace(hex32, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_be(data: Column) -> Column:
    return _dashed(hex_lower(data))


def uuid_le(data: Column) -> Column:
    """The first three fields are little-endian."""
    b = lambda *at: F.concat(*(F.substring(data, k + 1, 1) for k in at))
    return _dashed(hex_lower(F.concat(b(3, 2, 1, 0, 5, 4, 7, 6), F.substring(data, 9, 8))))


def uuid_parse(text: Column) -> Column:
    """16 bytes of a UUID text, with or without braces; null if it is none."""
    plain = F.regexp_extract(text, r"^\{?([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})\}?$", 1)
    return F.when(plain != "", F.unhex(F.replace(plain, F.lit("-"), F.lit(""))))


NIL_UUID = "00000000-0000-0000-0000-000000000000"
MAX_UUID = "ffffffff-ffff-ffff-ffff-ffffffffffff"


def array_text(values: Column) -> Column:
    """[v; n] if all values are equal (two at least), else all of them; over 16, in lines of 16, the last line holding the last 16."""
    n = F.size(values)
    same = (n > 1) & (F.size(F.array_distinct(values)) == 1)
    lines = F.concat(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 17) / 16), F.lit(0)).cast("int")), lambda k: F.array_join(F.slice(values, k * 16 + 1, F.lit(16)), ", ")), F.array(F.array_join(F.slice(values, F.greatest(n - 15, F.lit(1)), F.lit(16)), ", ")))
    return F.when(same, F.concat(F.lit("["), values[0], F.lit("; "), n.cast("string"), F.lit("]"))).when(n > 16, F.concat(F.lit("[\n        "), F.array_join(lines, ",\n        "), F.lit("\n    ]"))).otherwise(F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")))


def hexdump_line(data: Column, offset: int = 0) -> Column:
    """One line of up to 16 bytes: offset, two groups of eight, and the printable characters."""
    h = F.lower(F.hex(F.substring(data, 1, 16)))
    n = (F.length(h) / 2).cast("int")
    cell = lambda k: F.when(n > k, F.concat(F.substring(h, 2 * k + 1, 2), F.lit(" "))).otherwise("   ")
    ascii_ = F.concat(*(F.when(n > k, F.when(F.substring(h, 2 * k + 1, 2).between("20", "7e"), F.decode(F.unhex(F.substring(h, 2 * k + 1, 2)), "US-ASCII")).otherwise(".")).otherwise("") for k in range(16)))
    return F.concat(F.lit(f"{offset:08x}  "), *(cell(k) for k in range(8)), F.lit(" "), *(cell(k) for k in range(8, 16)), F.lit(" "), ascii_)


def hexdump(data: Column, group: bool = False) -> Column:
    """The whole dump, with runs of equal full lines as `...` if asked for. By Arrow: its lines depend on those before."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else dump(bytes(v), group))

    return run(data)


def dump(data: bytes, group: bool = False) -> str:
    out, full = [], len(data) // 16
    shown = 0
    for k in range(0, len(data), 16):
        line, row = data[k : k + 16], k // 16
        if group and row and row < full - 1 and line == data[shown * 16 : shown * 16 + 16]:
            if row == shown + 1:
                out.append("...")
            continue
        shown = row
        cells = [f"{b:02x} " for b in line]
        text = f"{k:08x}  " + "".join(cells[:8]) + (" " if len(line) >= 8 else "") + "".join(cells[8:])
        if len(line) < 16:
            text += "   " * (16 - len(line)) + (" " if len(line) < 8 else "")
        out.append(text + " " + "".join(chr(b) if 32 <= b < 127 else "." for b in line))
    return "".join(f"{x}\n" for x in out) + "\n"
