"""Character encodings and base64.

Code pages that the JDK has are decoded in the JVM if the session opens them (spark.sql.legacy.javaCharsets) and replaces
what has no character (spark.sql.legacy.codingErrorAction); else, and for the few it lacks, by Python's tables over Arrow. Case folding is by single UCS-2 units, as file systems compare names, not by upper().
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Names of encodings here, and the JDK's; None where it has none.
CHARSETS = {
    "ascii": "US-ASCII", "utf8": "UTF-8", "utf16le": "UTF-16LE", "utf16be": "UTF-16BE",
    "iso8859_1": "ISO-8859-1", "iso8859_2": "ISO-8859-2", "iso8859_3": "ISO-8859-3", "iso8859_4": "ISO-8859-4",
    "iso8859_5": "ISO-8859-5", "iso8859_6": "ISO-8859-6", "iso8859_7": "ISO-8859-7", "iso8859_8": "ISO-8859-8",
    "iso8859_9": "ISO-8859-9", "iso8859_10": None, "iso8859_11": "x-iso-8859-11", "iso8859_13": "ISO-8859-13",
    "iso8859_14": None, "iso8859_15": "ISO-8859-15", "iso8859_16": "ISO-8859-16",
    "koi8_r": "KOI8-R", "koi8_u": "KOI8-U",
    "mac_arabic": None, "mac_celtic": None, "mac_centraleurope": "x-MacCentralEurope", "mac_croatian": "x-MacCroatian",
    "mac_cyrillic": "x-MacCyrillic", "mac_dingbats": "x-MacDingbat", "mac_farsi": None, "mac_gaelic": None, "mac_greek": "x-MacGreek",
    "mac_icelandic": "x-MacIceland", "mac_roman": "x-MacRoman", "mac_romanian": "x-MacRomania", "mac_russian": "x-MacCyrillic", "mac_symbol": "x-MacSymbol",
    "mac_thai": "x-MacThai", "mac_turkish": "x-MacTurkish", "mac_ukrainian": "x-MacUkraine",
    "windows874": "x-windows-874", "windows932": "windows-31j", "windows936": "GBK", "windows949": "x-windows-949", "windows950": "x-windows-950",
    "windows1250": "windows-1250", "windows1251": "windows-1251", "windows1252": "windows-1252", "windows1253": "windows-1253",
    "windows1254": "windows-1254", "windows1255": "windows-1255", "windows1256": "windows-1256", "windows1257": "windows-1257", "windows1258": "windows-1258",
}
#: Those that Python has, for the JDK's gaps and for row-wise use inside readers.
PYTHON = {"iso8859_10": "iso8859_10", "iso8859_14": "iso8859_14", "mac_arabic": "mac_arabic", "mac_farsi": "mac_farsi", "windows932": "cp932", "windows936": "gbk", "windows949": "cp949", "windows950": "cp950", "windows874": "cp874", "utf16le": "utf-16-le", "utf16be": "utf-16-be", "iso8859_11": "iso8859_11", "mac_centraleurope": "mac_centeuro", "mac_icelandic": "mac_iceland", "mac_russian": "mac_cyrillic", "ascii": "ascii", "utf8": "utf-8"} | {f"windows{n}": f"cp{n}" for n in range(1250, 1259)}
#: Those that only the JDK has.
JDK_ONLY = ("mac_dingbats", "mac_symbol", "mac_thai", "mac_ukrainian")
#: Where Mac Celtic and Mac Gaelic differ from Mac Roman (byte: code point).
MAC_CELTIC = {0xDE: 0x0176, 0xDF: 0x0177, 0xE2: 0x1EF2, 0xE3: 0x1EF3, 0xF0: 0x2663, 0xF5: 0x00DD, 0xF6: 0x00FD, 0xF7: 0x0174, 0xF8: 0x0175, 0xF9: 0x1E84, 0xFA: 0x1E85, 0xFB: 0x1E80, 0xFC: 0x1E81, 0xFD: 0x1E82, 0xFE: 0x1E83}
MAC_GAELIC = {
    0xAE: 0x1E02, 0xB0: 0x1E03, 0xB2: 0x010A, 0xB3: 0x010B, 0xB4: 0x1E0A, 0xB5: 0x1E0B, 0xB6: 0x1E1E, 0xB7: 0x1E1F, 0xB8: 0x0120, 0xB9: 0x0121,
    0xBA: 0x1E40, 0xBC: 0x1E41, 0xBD: 0x1E56, 0xBE: 0x1E57, 0xC2: 0x027C, 0xC3: 0x0192, 0xC4: 0x017F, 0xC5: 0x1E60, 0xC6: 0x1E61, 0xD6: 0x1E9B,
    0xDA: 0x1E6A, 0xDB: 0x20AC, 0xDC: 0x1E6B, 0xDE: 0x0176, 0xDF: 0x0177, 0xE0: 0x1E6B, 0xE2: 0x1EF2, 0xE3: 0x1EF3, 0xF0: 0x2663, 0xF5: 0x00DD,
    0xF6: 0x00FD, 0xF7: 0x0174, 0xF8: 0x0175, 0xF9: 0x1E84, 0xFA: 0x1E85, 0xFB: 0x1E80, 0xFC: 0x1E81, 0xFD: 0x1E82, 0xFE: 0x1E83,
}


def table(charset: str) -> dict[int, str]:
    """byte to character, of a single-byte encoding; undefined bytes are left out."""
    if charset in ("mac_celtic", "mac_gaelic"):
        base = {b: bytes([b]).decode("mac_roman") for b in range(256)}
        return base | {b: chr(c) for b, c in (MAC_CELTIC if charset == "mac_celtic" else MAC_GAELIC).items()}
    name, out = PYTHON.get(charset, charset), {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            pass
    return out


def decode_bytes(data: bytes, charset: str) -> str:
    """In Python, for readers; undefined bytes are U+FFFD."""
    if charset in ("mac_celtic", "mac_gaelic"):
        t = table(charset)
        return "".join(t.get(b, "�") for b in data)
    return codecs.decode(data, PYTHON.get(charset, charset), "replace")


def decode(data: Column, charset: str) -> Column:
    """Text of bytes. The JVM decodes unless the JDK lacks the charset or the session keeps to the short list."""
    java = CHARSETS[charset]
    session = SparkSession.getActiveSession()
    every = session is not None and all(session.conf.get(f"spark.sql.legacy.{x}", "false") == "true" for x in ("javaCharsets", "codingErrorAction"))
    if java and (every or java in ("US-ASCII", "UTF-8", "UTF-16LE", "UTF-16BE", "ISO-8859-1")):
        return F.decode(data, java)
    if charset in JDK_ONLY:
        raise ValueError(f"{charset} needs spark.sql.legacy.javaCharsets")

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else decode_bytes(bytes(x), charset))

    return run(data)


def encode(text: Column, charset: str) -> Column:
    """Bytes of text; null if a character has none."""
    back = {c: bytes([b]) for b, c in table(charset).items()} if charset in ("mac_celtic", "mac_gaelic") else None

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        def of(x):
            if x is None:
                return None
            try:
                return b"".join(back[c] for c in x) if back else x.encode(PYTHON.get(charset, charset))
            except (KeyError, UnicodeEncodeError):
                return None

        return v.map(of)

    return F.encode(text, "UTF-8") if charset == "utf8" else run(text)


def fold(unit: int) -> int:
    """Case folding of one UCS-2 unit: its upper case if that is one unit too."""
    u = chr(unit).upper() if not 0xD800 <= unit < 0xE000 else chr(unit)
    return ord(u) if len(u) == 1 and ord(u) < 0x10000 else unit


def fold_name(name: str, upcase: list[int] | None = None) -> tuple[int, ...]:
    """A name's comparison key, by the given table (as a volume has it) or the rule."""
    raw = name.encode("utf-16-le", "surrogatepass")
    units = [raw[k] | raw[k + 1] << 8 for k in range(0, len(raw), 2)]
    return tuple(upcase[u] if upcase and u < len(upcase) else fold(u) for u in units)


def casefold(name: Column) -> Column:
    """A comparison key of names, by Arrow."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else "".join(chr(u) for u in fold_name(x) if not 0xD800 <= u < 0xE000))

    return run(name)


def base64_decode(text: Column) -> Column:
    """Strict: letters of the alphabet only, padding optional but right if there; null otherwise."""
    fine = text.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}(==)?|[A-Za-z0-9+/]{3}=?)?$")
    return F.when(fine, F.unbase64(text))


def base64_stream(text: Column) -> Column:
    """As base64_decode, with white space anywhere."""
    return base64_decode(F.regexp_replace(text, r"\s", ""))
