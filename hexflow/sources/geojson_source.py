"""GeoJSON cells as a Spark data source: ``spark.dataSource.register(CellGeoJson)``, then format("cell_geojson").

Files hold a feature a line.  A reader's partition is a range of a file's bytes, whose lines are those that begin in it.  A
writer's task writes one file under a hidden folder of its own run; the driver moves the files of the tasks that made it into
place once all are done, so a task that is run again leaves nothing twice and a failed job leaves nothing.

The path is one that driver and executors share: a mounted folder or a URI that pyarrow's file systems know.
"""

from __future__ import annotations

import io
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "cell_id long, q int, r int, score long, affordance double, friction double"
#: Bytes of a reader's partition.
RANGE = 32 << 20
SUFFIX = ".geojsonl"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _ring(q: int, r: int) -> list[list[float]]:
    x, y, size = q + r / 2.0, math.sqrt(3) / 2 * r, 1 / math.sqrt(3)
    corner = [[x + size * math.cos(math.radians(60 * i + 30)), y + size * math.sin(math.radians(60 * i + 30))] for i in range(6)]
    return [*corner, corner[0]]


def feature(row) -> str:
    """One cell as a polygon feature."""
    properties = {"h3": row.cell_id, "q": row.q, "r": row.r, "desireScore": row.score, "affordance": row.affordance, "friction": row.friction}
    geometry = {"type": "Polygon", "coordinates": [_ring(row.q, row.r)]} if row.q is not None and row.r is not None else None
    return json.dumps({"type": "Feature", "geometry": geometry, "properties": properties}, separators=(",", ":"))


def parsed(line: str) -> tuple:
    """A line's values in the order of SCHEMA; members that are not there are null."""
    p = json.loads(line).get("properties") or {}
    number = lambda v: None if v is None else float(v)
    return (p.get("h3"), p.get("q"), p.get("r"), p.get("desireScore"), number(p.get("affordance")), number(p.get("friction")))


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


class CellReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, at = _store(self.path)
        found = store.get_file_info(fs.FileSelector(at)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(SUFFIX))
        return [Range(p, a, min(a + self.size, n)) for p, n in files for a in range(0, n, self.size)]

    def read(self, part: Range | None) -> Iterator[tuple]:
        if part is None:  # a folder without files
            return
        store, _ = _store(self.path)
        with io.BufferedReader(store.open_input_file(part.file), 1 << 20) as f:
            # a line belongs to the range that holds its first byte; the one begun before is the last range's
            f.seek(max(part.start - 1, 0))
            if part.start:
                f.readline()
            while f.tell() < part.stop:
                line = f.readline()
                if line.strip():
                    yield parsed(line.decode())


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class CellWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def _hidden(self, at: str) -> str:
        return f"{at}/_run-{self.run}"

    def write(self, rows: Iterator) -> Written:
        store, at = _store(self.path)
        store.create_dir(self._hidden(at), recursive=True)
        name, n = f"part-{uuid.uuid4().hex}{SUFFIX}", 0
        with store.open_output_stream(f"{self._hidden(at)}/{name}") as out:
            for row in rows:
                out.write(feature(row).encode() + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        for m in messages:
            if m is not None and m.rows:
                store.move(f"{self._hidden(at)}/{m.file}", f"{at}/{m.file}")
        self._clear(store, at)
        with store.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, at: str) -> None:
        from pyarrow import fs

        if store.get_file_info(self._hidden(at)).type == fs.FileType.Directory:
            store.delete_dir(self._hidden(at))


class CellGeoJson(DataSource):
    """Options: path; range (bytes of a reader's partition)."""

    @classmethod
    def name(cls) -> str:
        return "cell_geojson"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CellReader:
        return CellReader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> CellWriter:
        return CellWriter(self.options["path"], overwrite)
