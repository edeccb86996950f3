"""What the readers of file systems give: entries, their times and data forks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from sedira.sources.streams import BytesStream, Stream


@dataclass
class Time:
    """kind: filetime (ticks), posix32 (seconds), posix64ns (seconds and nanos), fat (date << 16 | time in ticks, 10 ms in nanos), not_set."""

    kind: str
    ticks: int = 0
    nanos: int = 0


@dataclass
class Fork:
    name: str | None
    stream: Stream


@dataclass
class Entry:
    identifier: str
    name: str
    raw_name: bytes = b""
    file_type: str = "file"
    size: int = 0
    mode: int | None = None
    attributes: int | None = None
    owner_id: int | None = None
    group_id: int | None = None
    atime: Time | None = None
    mtime: Time | None = None
    ctime: Time | None = None
    btime: Time | None = None
    link_target: str | None = None
    device: tuple[int, int] | None = None
    n_attributes: int = 0
    path: list[str] = field(default_factory=list)
    forks: list[Fork] = field(default_factory=list)
    error: str | None = None
    key: Any = None  # what the reader needs to list it

    @property
    def data(self) -> Stream | None:
        return next((f.stream for f in self.forks if f.name is None), None)


class FileSystem:
    """root, children(entry) and lookup; walk gives all entries, children before their directory, the root last."""

    format = ""
    info: dict[str, str]

    def root(self) -> Entry:
        raise NotImplementedError

    def children(self, entry: Entry) -> Iterator[Entry]:
        raise NotImplementedError

    def same(self, a: str, b: str) -> bool:
        return a == b

    def walk(self, entry: Entry | None = None, seen: frozenset = frozenset()) -> Iterator[Entry]:
        entry = entry or self.root()
        if not entry.path:
            entry.path = [""]
        if entry.file_type == "directory":
            if entry.identifier in seen:
                entry.error = "a directory within itself"
            else:
                try:
                    for child in self.children(entry):
                        child.path = [*entry.path, child.name]
                        yield from self.walk(child, seen | {entry.identifier})
                except (ValueError, IndexError, KeyError, OSError) as e:  # damaged: what was read stays, and the directory says so
                    entry.error = str(e) or type(e).__name__
        yield entry

    def by_path(self, path: str) -> Entry | None:
        now = self.root()
        now.path = [""]
        for part in [p for p in path.split("/") if p]:
            child = next((c for c in self.children(now) if self.same(c.name, part)), None) if now.file_type == "directory" else None
            if child is None:
                return None
            child.path = [*now.path, child.name]
            now = child
        return now

    def by_identifier(self, identifier: str) -> Entry | None:
        return next((e for e in self.walk() if e.identifier == identifier), None)


def resident(data: bytes) -> Stream:
    return BytesStream(data)
