"""Rules of formats that are integer or byte logic, as Column expressions, and property lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sedira.functions.binary import Field, Layout
from sedira.sources.ext import EXT3, EXT4
from sedira.sources.images import ewf_segment_name, plist_json

MBR_ENTRY = Layout("mbr_entry", (Field("flags", "u8"), Field("start_chs", "hex", 3), Field("type", "u8"), Field("end_chs", "hex", 3), Field("start_lba", "u32"), Field("sectors", "u32")))
GPT_ENTRY = Layout("gpt_entry", (Field("type", "uuid"), Field("identifier", "uuid"), Field("first_lba", "u64"), Field("last_lba", "u64"), Field("flags", "u64"), Field("name", "ucs2", 72)))
VHD_FOOTER = Layout("vhd_footer", (
    Field("signature", "char", 8), Field("features", "u32"), Field("version", "u32"), Field("next_offset", "u64"), Field("modification_time", "u32"), Field("creator", "char", 4), Field("creator_version", "u32"),
    Field("creator_os", "char", 4), Field("original_size", "u64"), Field("size", "u64"), Field("geometry", "hex", 4), Field("disk_type", "u32"), Field("checksum", "u32"), Field("identifier", "uuid"), Field("saved_state", "u8"),
), "be")
NTFS_STANDARD = Layout("standard_information", (Field("created", "u64"), Field("modified", "u64"), Field("changed", "u64"), Field("accessed", "u64"), Field("attributes", "u32")))


def ext_version(compatible: Column, incompatible: Column, read_only: Column) -> Column:
    has = lambda c, mask: c.bitwiseAND(F.lit(mask)) != 0
    return F.when(has(compatible, EXT4[0]) | has(incompatible, EXT4[1]) | has(read_only, EXT4[2]), 4).when(has(compatible, EXT3[0]) | has(incompatible, EXT3[1]), 3).otherwise(2)


def fat_bits(clusters: Column, root_cluster: Column) -> Column:
    return F.when((root_cluster != 0) | (clusters >= 65525), 32).when(clusters >= 4085, 16).otherwise(12)


def ntfs_reference(reference: Column) -> Column:
    """`entry-sequence` of a 64-bit file reference."""
    return F.concat_ws("-", reference.bitwiseAND(F.lit((1 << 48) - 1)).cast("string"), F.shiftrightunsigned(reference, 48).cast("string"))


def vhdx_block(entry: Column, differential: Column) -> Column:
    """struct(state, offset, kind) of a block allocation entry."""
    state = entry.bitwiseAND(F.lit(7))
    kind = F.when(state == 6, "in_file").when(differential & (state == 7), "by_bitmap").when(differential & (state == 0), "in_parent").otherwise("sparse")
    return F.struct(state.alias("state"), F.shiftleft(F.shiftrightunsigned(entry, 20), 20).alias("offset"), kind.alias("kind"))


def segment_name(first: Column, number: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([ewf_segment_name(x, int(k)) for x, k in zip(a, n)])

    return run(first, number)


def plist(data: Column) -> Column:
    """A property list as JSON text; data in base64."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else plist_json(bytes(x)))

    return run(data)
