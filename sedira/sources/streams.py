"""Byte streams: what readers of images and file systems read from.

A stream has a size and read_at(offset, size). Files are opened where they are read (in a task), through fsspec-free
plain paths; paths of other stores are read by Spark as chunks instead (see sources.datasources).
"""

from __future__ import annotations

import os
from bisect import bisect_right
from dataclasses import dataclass

from sedira.functions.compression import decompress_bytes


class Stream:
    size: int = 0

    def read_at(self, offset: int, size: int) -> bytes:
        raise NotImplementedError

    def chunks(self, size: int = 1 << 20):
        for at in range(0, self.size, size):
            yield self.read_at(at, min(size, self.size - at))

    def read_all(self) -> bytes:
        return b"".join(self.chunks())


class FileStream(Stream):
    def __init__(self, path: str):
        self.path, self.size = path, os.stat(path).st_size
        self._file = open(path, "rb")  # noqa: SIM115  lives as long as the stream

    def read_at(self, offset: int, size: int) -> bytes:
        self._file.seek(offset)
        return self._file.read(max(0, size))


class BytesStream(Stream):
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read_at(self, offset: int, size: int) -> bytes:
        return self.data[offset : offset + max(0, size)]


class RangeStream(Stream):
    """A window of another stream."""

    def __init__(self, parent: Stream, offset: int, size: int | None = None):
        if offset >= parent.size and (offset or size is None):
            raise ValueError(f"offset {offset} is not within {parent.size} bytes")
        self.parent, self.offset = parent, offset
        self.size = min(parent.size - offset, parent.size if size is None else size)

    def read_at(self, offset: int, size: int) -> bytes:
        return self.parent.read_at(self.offset + offset, max(0, min(size, self.size - offset)))


@dataclass
class Block:
    """A range of a medium. kind: in_file, sparse, in_parent, or compressed by `codec`."""

    media_offset: int
    size: int
    data_offset: int = 0
    data_size: int = 0
    kind: str = "in_file"
    segment: int = 0
    codec: str = ""


class BlockStream(Stream):
    """A medium of blocks in one or more files; gaps are zero, in_parent ranges are the parent's, compressed blocks are decoded whole, the last few of them kept."""

    KEPT = 64

    def __init__(self, blocks: list[Block], files: list[Stream], size: int, parent: Stream | None = None):
        self.blocks = sorted((b for b in blocks if b.size), key=lambda b: b.media_offset)
        self.starts = [b.media_offset for b in self.blocks]
        self.files, self.size, self.parent = files, size, parent
        self._decoded: dict[int, bytes] = {}

    def _decode(self, k: int) -> bytes:
        if k not in self._decoded:
            b = self.blocks[k]
            data = decompress_bytes(self.files[b.segment].read_at(b.data_offset, b.data_size), b.codec, b.size)
            if len(self._decoded) >= self.KEPT:
                del self._decoded[next(iter(self._decoded))]
            self._decoded[k] = data.ljust(b.size, b"\0")
        return self._decoded[k]

    def read_at(self, offset: int, size: int) -> bytes:
        end, out = min(self.size, offset + size), []
        while offset < end:
            k = bisect_right(self.starts, offset) - 1
            b = self.blocks[k] if k >= 0 else None
            if b is None or offset >= b.media_offset + b.size:
                n = (self.starts[k + 1] if k + 1 < len(self.starts) else end) - offset
                out.append(b"\0" * min(n, end - offset))
            else:
                skip = offset - b.media_offset
                n = min(b.size - skip, end - offset)
                if b.kind == "in_file":
                    part = self.files[b.segment].read_at(b.data_offset + skip, n)
                elif b.kind == "compressed":
                    part = self._decode(k)[skip : skip + n]
                elif b.kind == "in_parent" and self.parent is not None:
                    part = self.parent.read_at(offset, n)
                else:
                    part = b""
                out.append(part.ljust(n, b"\0"))
            offset += len(out[-1])
        return b"".join(out)
