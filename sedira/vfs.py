"""A facade over the data sources: what an image holds, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedira.sources import datasources

TYPES = ("APM", "EWF", "EXT", "FAKE", "FAT", "GPT", "MBR", "NTFS", "OS", "QCOW", "SPARSEIMAGE", "UDIF", "VHD", "VHDX")


@dataclass(frozen=True)
class Location:
    """A path in a stack of layers, outermost first: ((vfs_type, path), ...)."""

    layers: tuple[tuple[str, str], ...]

    @staticmethod
    def base(path: str, vfs_type: str = "OS") -> Location:
        return Location(((_known(vfs_type), path),))

    def layer(self, vfs_type: str, path: str) -> Location:
        return Location((*self.layers, (_known(vfs_type), path)))

    @property
    def path(self) -> str:
        return self.layers[-1][1]

    @property
    def vfs_type(self) -> str:
        return self.layers[-1][0]

    @property
    def parent(self) -> Location | None:
        return Location(self.layers[:-1]) if len(self.layers) > 1 else None

    @property
    def volume(self) -> int | None:
        """The number of the volume that the location lies in, if it names one."""
        for kind, path in self.layers:
            if kind in ("APM", "GPT", "MBR") and path.strip("/").lower().startswith(kind.lower()):
                return int(path.strip("/")[len(kind) :])
        return None


def _known(vfs_type: str) -> str:
    if vfs_type.upper() not in TYPES:
        raise ValueError(f"unknown type {vfs_type}")
    return vfs_type.upper()


class Resolver:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        datasources.register(spark)

    def _load(self, kind: str, path: str, **options: str) -> DataFrame:
        return self.spark.read.format(kind).options(path=path, **options).load()

    def scan(self, path: str) -> DataFrame:
        """The tree of layers."""
        return self._load("scan_nodes", path)

    def _at(self, df: DataFrame, location: Location) -> DataFrame:
        df = df if location.volume is None else df.where(F.col("volume") == location.volume)
        return df.where(F.col("display_path") == location.path) if location.vfs_type in ("EXT", "FAT", "NTFS") else df

    def entries(self, location: Location, with_md5: bool = False) -> DataFrame:
        """The entry at a location in a file system; of a location outside of one, all entries."""
        return self._at(self._load("file_entries", location.layers[0][1], with_md5=str(with_md5).lower()), location)

    def exists(self, location: Location) -> bool:
        return not self.entries(location).where("display_path is not null").isEmpty()

    def children(self, location: Location) -> DataFrame:
        """Entries directly below a directory, which is all that is read."""
        e = self._load("file_entries", location.layers[0][1], children_of=location.path)
        return e if location.volume is None else e.where(F.col("volume") == location.volume)

    def data(self, location: Location, fork: str | None = None) -> DataFrame:
        """The bytes of a stream of an entry: the unnamed one, or the one of that name."""
        d = self._at(self._load("data_forks", location.layers[0][1], with_content="true", fork=fork or ""), location)
        return d.select("volume", "display_path", "fork_name", "size", "content")
