"""A data source for image cubes in HDF5 files, one input partition for each file. It needs h5py, which may be absent."""

from __future__ import annotations

from collections.abc import Iterator
from glob import glob

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..schemas import FRAMES_SCHEMA

try:
    import h5py
except ImportError:
    h5py = None


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class CubeReader(DataSourceReader):
    """Options: path (a glob), channel, layout: "index" (dataset ``id`` and one cube for the channel), "group" (a group for each event)
    or "first" (a single event under the file's first key). Filters on event_id are applied before an array is read."""

    def __init__(self, options: dict[str, str]):
        self.options, self.wanted = options, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("event_id",):
                self.wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("event_id",):
                self.wanted = set(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p) for p in sorted(glob(self.options["path"], recursive=True))]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if h5py is None:
            raise RuntimeError("reading HDF5 needs h5py")
        channel, layout = self.options.get("channel", "vil"), self.options.get("layout", "index")
        with h5py.File(partition.path, "r") as f:
            for event_id, cube in cubes(f, channel, layout, self.wanted):
                for t, frame in enumerate(frames_first(cube)):
                    yield event_id, channel, t, frame.shape[0], frame.shape[1], frame.astype("float32").ravel().tolist()


def cubes(f, channel: str, layout: str, wanted: set[str] | None) -> Iterator[tuple[str, object]]:
    """(event id, array) of the wanted events of an open file, or of any mapping of the same shape."""
    text = lambda b: b.decode() if isinstance(b, bytes) else str(b)
    if layout == "index":
        for i, b in enumerate(f["id"][:]):
            if wanted is None or text(b) in wanted:
                yield text(b), f[channel][i]
    elif layout == "group":
        for k in f:
            if k != "id" and (wanted is None or k in wanted):
                yield k, f[k][channel][:]
    else:
        k = next(iter(f))
        if wanted is None or k in wanted:
            yield k, f[k][:]


def frames_first(cube):
    """The cube with time as its first axis: the last axis is time if it is the shortest."""
    return cube.transpose(2, 0, 1) if cube.ndim == 3 and cube.shape[2] < min(cube.shape[:2]) else cube


class CubeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stormcubes"

    def schema(self) -> str:
        return FRAMES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CubeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CubeSource)
