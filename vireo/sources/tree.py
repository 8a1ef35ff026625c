"""Image trees as a data source: ``spark.read.format("image_tree").load(root)`` and ``spark.readStream.format("image_tree")``.

Rows are filepath, rel (below the root), size, mtime and ctime (seconds; ctime null where a store has none), and with option
content=true the bytes (null where a file can't be read). Names that begin with ``_`` are listed, which Spark's own sources hide;
whatever has a part that begins with a dot is not, and neither is what isn't an image by its ending. root is a folder of a mounted
file system, or a URI that PyArrow knows (hdfs, s3, file): the driver's and the executors' listing is the same code.

Each folder is a partition and listed by a task. The driver lists folders only, breadth first; beyond ``partitions`` of them (10,000
unless set) tasks walk the rest below their folder. Rows go to Spark in Arrow batches of bounded size.

The stream gives each path once, whatever became of its file later. What was given is written below option ``log`` (a folder that
all executors share): a task writes down what is new in its folder, by folder and number of the scan, before it passes it on. A scan
that is run again reads what it wrote, so a stream that resumes gives the same rows; nobody ever holds the paths of more than one
folder. A scan is made when a folder has come, gone or changed, which its modification time tells.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from vireo.functions.scalar import EXTENSIONS

LISTING = "filepath string, rel string, size long, mtime double, ctime double"
MAX_PARTITIONS = 10_000
BATCH_ROWS = 4096
BATCH_BYTES = 64 << 20  # of file contents in an Arrow batch, unless one file has more


@dataclass
class Folder(InputPartition):
    """A folder to list (relative to the root; empty for the root itself), with all below it if ``deep``. scan: the stream's number of the scan."""

    rel: str
    deep: bool = False
    scan: int = 0


class Tree:
    """The folders and images below a root, by PyArrow's file systems."""

    def __init__(self, root: str) -> None:
        if len(urlsplit(root).scheme) > 1:
            self.fs, self.root = pafs.FileSystem.from_uri(root)
        else:
            self.fs, self.root = pafs.LocalFileSystem(), os.path.abspath(root)
        self.local = isinstance(self.fs, pafs.LocalFileSystem)

    def path(self, rel: str) -> str:
        return posixpath.join(self.root, rel) if rel else self.root

    def entries(self, rel: str) -> list[pafs.FileInfo]:
        """What a folder holds but for dot names, by name; nothing if it is gone by now."""
        found = self.fs.get_file_info(pafs.FileSelector(self.path(rel), allow_not_found=True))
        return sorted((f for f in found if not f.base_name.startswith(".")), key=lambda f: f.base_name)

    def folders(self, rel: str) -> list[tuple[str, int]]:
        """Names below a folder of its own folders, and their modification times."""
        return [(posixpath.join(rel, f.base_name) if rel else f.base_name, f.mtime_ns or 0) for f in self.entries(rel) if f.type == pafs.FileType.Directory]

    def images(self, folder: Folder) -> Iterator[tuple[str, str, int, float | None, float | None]]:
        """Rows of the image files of a folder; files that vanish meanwhile are no rows."""
        todo = deque([folder.rel])
        while todo:
            rel = todo.popleft()
            for f in self.entries(rel):
                name = posixpath.join(rel, f.base_name) if rel else f.base_name
                if f.type == pafs.FileType.Directory and folder.deep:
                    todo.append(name)
                elif f.type == pafs.FileType.File and f.base_name.lower().endswith(EXTENSIONS) and f.base_name.lower() not in EXTENSIONS:
                    try:
                        ctime = os.stat(f.path).st_ctime if self.local else None
                    except FileNotFoundError:
                        continue
                    yield f.path, name, f.size, None if f.mtime_ns is None else f.mtime_ns / 1e9, ctime

    def content(self, path: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(path) as f:
                return f.read()
        except OSError:
            return None

    def planned(self, most: int) -> Iterator[tuple[Folder, int]]:
        """All folders and their modification times, breadth first; those that would be more than ``most`` are left to be walked from above."""
        todo, made = deque([("", self.fs.get_file_info(self.root).mtime_ns or 0)]), 0
        while todo:
            rel, mtime = todo.popleft()
            below = self.folders(rel)
            made += 1
            deep = made + len(todo) + len(below) > most
            if not deep:
                todo.extend(below)
            yield Folder(rel, deep and bool(below)), mtime


class _Listing:
    """What batch and stream readers share: rows as Arrow batches of the asked columns."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("image_tree needs the path of a folder")
        self.options, self.names = dict(options), schema.names
        self.most = int(options.get("partitions", MAX_PARTITIONS))

    def tree(self) -> Tree:
        return Tree(self.options["path"])

    def batches(self, tree: Tree, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        types = {"filepath": pa.string(), "rel": pa.string(), "size": pa.int64(), "mtime": pa.float64(), "ctime": pa.float64(), "content": pa.binary()}
        schema = pa.schema([(n, types[n]) for n in self.names])
        held, weight = [], 0
        for row in rows:
            record = dict(zip(("filepath", "rel", "size", "mtime", "ctime"), row))
            if "content" in self.names:
                record["content"] = tree.content(record["filepath"])
                weight += len(record["content"] or b"")
            held.append(record)
            if len(held) >= BATCH_ROWS or weight >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class _Reader(_Listing, DataSourceReader):
    """The tree as it is. Filters on rel that fix how it begins leave out folders that can't hold it."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        super().__init__(schema, options)
        self.within: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("rel",) and isinstance(f.value, str):
                self.within.append(f.value)
            yield f  # rows are still Spark's to filter

    def _may_hold(self, folder: Folder) -> bool:
        inside = folder.rel + "/" if folder.rel else ""
        return all(w.startswith(inside) or inside.startswith(w) for w in self.within)

    def partitions(self) -> list[Folder]:
        return [f for f, _ in self.tree().planned(self.most) if self._may_hold(f)] or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        tree = self.tree()
        return self.batches(tree, tree.images(partition))


class _Log:
    """What a stream has given: files scans/N (what the tree looked like) and given/<folder>/N (names), each put in place whole."""

    def __init__(self, path: str) -> None:
        self.tree = Tree(path)

    def _names(self, rel: str) -> list[str]:
        return [f.base_name for f in self.tree.fs.get_file_info(pafs.FileSelector(self.tree.path(rel), allow_not_found=True)) if f.base_name.isdigit()]

    def read(self, rel: str) -> str | None:
        data = self.tree.content(self.tree.path(rel))
        return None if data is None else data.decode()

    def write(self, rel: str, text: str) -> None:
        path = self.tree.path(rel)
        part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.part"
        self.tree.fs.create_dir(posixpath.dirname(path), recursive=True)
        with self.tree.fs.open_output_stream(part) as f:
            f.write(text.encode())
        self.tree.fs.move(part, path)

    def last_scan(self) -> int:
        return max(map(int, self._names("scans")), default=0)

    def fresh(self, folder: str, scan: int, names: list[str]) -> list[str]:
        """Names of a folder that no scan before gave; the same ones whenever this scan is run."""
        place = "given/" + hashlib.sha256(folder.encode()).hexdigest()
        scans = self._names(place)
        if str(scan) in scans:
            return json.loads(self.read(f"{place}/{scan}"))
        given = {n for s in scans for n in json.loads(self.read(f"{place}/{s}"))}
        new = [n for n in names if n not in given]
        if new:
            self.write(f"{place}/{scan}", json.dumps(new))
        return new


class _StreamReader(_Listing, DataSourceStreamReader):
    """Scans as offsets. A folder's new images are what its log lacks."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        super().__init__(schema, options)
        if "log" not in options:
            raise ValueError("a stream of image_tree needs option log, a folder that all executors share")

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        log, state, deep = _Log(self.options["log"]), hashlib.sha256(), False
        for folder, mtime in self.tree().planned(self.most):
            state.update(f"{folder.rel}\0{mtime}\n".encode())
            deep = deep or folder.deep
        last = log.last_scan()
        # folders that are walked from above don't tell that they have changed
        if deep or last == 0 or log.read(f"scans/{last}") != state.hexdigest():
            last += 1
            log.write(f"scans/{last}", state.hexdigest())
        return {"scan": last}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(f.rel, f.deep, end["scan"]) for f, _ in self.tree().planned(self.most)] if start != end else []

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        tree, log = self.tree(), _Log(self.options["log"])

        def new() -> Iterator[tuple]:
            for folder, found in groupby(tree.images(partition), key=lambda row: posixpath.dirname(row[1])):
                rows = {row[1]: row for row in found}
                yield from (rows[n] for n in log.fresh(folder, partition.scan, list(rows)) if n in rows)

        return self.batches(tree, new())


class ImageTree(DataSource):
    """See the module's text. Options: path, content, partitions, and for streams log."""

    @classmethod
    def name(cls) -> str:
        return "image_tree"

    def schema(self) -> str:
        return LISTING + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make image_tree known to the session; filters then reach it too."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageTree)
