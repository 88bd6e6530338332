"""Files of a folder as a data source of Spark's own kind, for batches and for streams.

    folder.register(spark)
    spark.read.format("ravelin_folder").option("glob", "*.md,*.html").load("/data/docs")
    spark.readStream.format("ravelin_folder").load("/data/docs")

Rows are files: path (below the folder), name, extension, bytes, modified (microseconds since 1970) and content. The driver lists the folder
and deals the files to partitions of SPLIT_BYTES or so, largest first to the one that holds least;
tasks read them a batch at a time. Conditions on path, name, extension, bytes and modified are taken
over by the source: files that fail them are not dealt, hence not read.

A stream's offset is the (modified, path) of the last file of a batch, so each new or changed file is read
once, in that order, and a query goes on from where its checkpoint stands. At most files_per_batch files are
taken at a time. A file that is changed while older ones are still arriving is read again as it is then.

The folder is an address that driver and executors reach alike (a path, or a URI that pyarrow's file
systems know). A missing folder has no files; one that vanishes between listing and reading fails its task, which Spark repeats.
"""

from __future__ import annotations

import fnmatch
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from ..shipping import ship

SCHEMA = "path string, name string, extension string, bytes bigint, modified bigint, content binary"
ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("extension", pa.string()), ("bytes", pa.int64()), ("modified", pa.int64()), ("content", pa.binary())])
#: Bytes of files that a partition holds, and that a batch of rows carries.
SPLIT_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
FILES_PER_BATCH = 1000

File = tuple[str, int, int]  # path below the folder, bytes, modified


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    return system, path.rstrip("/")


def listed(folder: str, globs: list[str]) -> list[File]:
    """Files whose name matches one of globs, hidden ones left out."""
    system, base = _opened(folder)
    found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
    out = []
    for f in found:
        path = f.path[len(base) :].lstrip("/")
        hidden = any(p.startswith((".", "_")) for p in path.split("/"))
        if f.type == pafs.FileType.File and not hidden and any(fnmatch.fnmatch(f.base_name, g) for g in globs):
            out.append((path, f.size, (f.mtime_ns or 0) // 1000))
    return sorted(out)


def described(file: File) -> dict[str, object]:
    name = file[0].rsplit("/", 1)[-1]
    return {"path": file[0], "name": name, "extension": name.rsplit(".", 1)[-1].lower() if "." in name else "", "bytes": file[1], "modified": file[2]}


class Files(ds.InputPartition):
    def __init__(self, files: list[File]):
        super().__init__(None)
        self.files = files


def dealt(files: list[File], split: int) -> list[Files]:
    """Files over partitions, so that their bytes are even."""
    n = max(1, min(len(files), -(-sum(f[1] for f in files) // split)))
    heap = [(0, k) for k in range(n)]
    parts: list[list[File]] = [[] for _ in range(n)]
    for f in sorted(files, key=lambda f: (-f[1], f[0])):
        size, k = heapq.heappop(heap)
        parts[k].append(f)
        heapq.heappush(heap, (size + f[1], k))
    return [Files(p) for p in parts if p]


def read_files(folder: str, files: list[File]) -> Iterator[pa.RecordBatch]:
    system, base = _opened(folder)
    rows, size = [], 0
    for f in files:
        with system.open_input_stream(f"{base}/{f[0]}", compression=None) as stream:
            rows.append({**described(f), "content": stream.read()})
        size += f[1]
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ARROW)


_COMPARE: dict[type, Callable] = {
    ds.EqualTo: lambda x, v: x == v, ds.GreaterThan: lambda x, v: x > v, ds.GreaterThanOrEqual: lambda x, v: x >= v, ds.LessThan: lambda x, v: x < v,
    ds.LessThanOrEqual: lambda x, v: x <= v, ds.In: lambda x, v: x in v, ds.StringStartsWith: lambda x, v: x.startswith(v),
    ds.StringEndsWith: lambda x, v: x.endswith(v), ds.StringContains: lambda x, v: v in x,
}


def condition(f: ds.Filter) -> Callable[[dict], bool] | None:
    """f as a test of what is known of a file without reading it, or None if it cannot be one."""
    if isinstance(f, ds.Not):
        inner = condition(f.child)
        return inner and (lambda row: not inner(row))
    if isinstance(f, ds.IsNotNull):
        return (lambda row: True) if len(f.attribute) == 1 and f.attribute[0] in ARROW.names else None
    test = _COMPARE.get(type(f))
    if not test or len(f.attribute) != 1 or f.attribute[0] not in ARROW.names or f.attribute[0] == "content" or f.value is None:
        return None
    return lambda row: test(row[f.attribute[0]], f.value)


class FolderReader(ds.DataSourceReader):
    def __init__(self, folder: str, globs: list[str], split: int):
        self.folder, self.globs, self.split = folder, globs, split
        self.conditions: list[Callable[[dict], bool]] = []

    def pushFilters(self, filters):
        for f in filters:
            test = condition(f)
            if test:
                self.conditions.append(test)
            else:
                yield f

    def partitions(self):
        files = [f for f in listed(self.folder, self.globs) if all(test(described(f)) for test in self.conditions)]
        self.conditions = []  # what travels to the tasks is the files alone
        return dealt(files, self.split) if files else [Files([])]

    def read(self, partition):
        return read_files(self.folder, partition.files)


class FolderStreamReader(ds.DataSourceStreamReader):
    def __init__(self, folder: str, globs: list[str], split: int, most: int):
        self.folder, self.globs, self.split, self.most = folder, globs, split, most
        self.at: tuple[int, str] | None = None

    def initialOffset(self):
        return {"modified": -1, "path": ""}

    def _between(self, start: tuple[int, str], end: tuple[int, str] | None) -> list[File]:
        files = sorted(listed(self.folder, self.globs), key=lambda f: (f[2], f[0]))
        return [f for f in files if (f[2], f[0]) > start and (end is None or (f[2], f[0]) <= end)]

    def latestOffset(self, start=None, limit=None):
        begin = self.at or ((start["modified"], start["path"]) if start else (-1, ""))
        new = self._between(begin, None)[: self.most]
        self.at = (new[-1][2], new[-1][0]) if new else begin
        return {"modified": self.at[0], "path": self.at[1]}

    def partitions(self, start, end):
        a, b = ((x["modified"], x["path"]) for x in (start, end))
        self.at = max(self.at or b, b)  # after a restart: behind what the checkpoint planned
        return dealt(self._between(a, b), self.split)

    def read(self, partition):
        return read_files(self.folder, partition.files)

    def commit(self, end):
        pass


class FolderSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "ravelin_folder"

    def schema(self):
        return SCHEMA

    def _parts(self) -> tuple[str, list[str], int]:
        if "path" not in self.options:
            raise ValueError("a folder must be given to load()")
        return self.options["path"], [g.strip() for g in self.options.get("glob", "*").split(",")], int(self.options.get("split_bytes", SPLIT_BYTES))

    def reader(self, schema: StructType):
        return FolderReader(*self._parts())

    def streamReader(self, schema: StructType):
        return FolderStreamReader(*self._parts(), int(self.options.get("files_per_batch", FILES_PER_BATCH)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session; conditions reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
