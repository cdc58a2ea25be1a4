"""A data source of documents' segments: spark.read.format("document_segments"), and readStream of the files that arrive.

Files are listed by the driver and dealt to partitions by their bytes; each is read once, by one task, and parsed by its
extension. Stores are those that pyarrow opens: local and shared folders, hdfs, s3 and others by their URI.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from corpusloom.sources.readers import SEGMENT_SCHEMA, parsed_file

NAME = "document_segments"
#: Bytes of files that one partition takes, unless a single file has more.
PARTITION_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    """Paths for one task."""

    paths: tuple[str, ...]


def document_id(uri: str) -> int:
    """The same number as Spark's xxhash64 of the path."""
    n = xxhash.xxh64_intdigest(uri, seed=42)
    return n - 2**64 if n >= 2**63 else n


def dealt(sizes: list[tuple[str, int]], most: int) -> list[Files]:
    """Files in their order, a partition as long as its bytes fit."""
    out: list[list[str]] = []
    room = 0
    for path, size in sizes:
        if not out or size > room:
            out.append([])
            room = most
        out[-1].append(path)
        room -= size
    return [Files(tuple(p)) for p in out]


class _Folder:
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        if "path" not in options:
            raise ValueError("a folder's path is needed")
        self.root, self.kb_id = options["path"], int(options.get("kbid", 0))
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root) if ":/" in self.root else (pafs.LocalFileSystem(), self.root)

    def listed(self) -> list[pafs.FileInfo]:
        """All files below the folder but hidden ones, by time and path."""
        store, path = self._store()
        found = store.get_file_info(pafs.FileSelector(path, recursive=True))
        files = [f for f in found if f.is_file and not any(p[:1] in "._" for p in f.path[len(path) :].split("/") if p)]
        return sorted(files, key=lambda f: (f.mtime_ns, f.path))

    def uri(self, path: str) -> str:
        scheme = self.root.split(":/")[0] if ":/" in self.root else "file"
        return f"{scheme}:{'//' if scheme != 'file' else ''}{path}"

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                content = f.read()
            name = path.rsplit("/", 1)[-1]
            rows = [{"kb_id": self.kb_id, "document_id": document_id(self.uri(path)), "file_name": name, "seg_no": k, **s} for k, s in enumerate(parsed_file(name, content))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


_ARROW = pa.schema([
    ("kb_id", pa.int32()), ("document_id", pa.int64()), ("file_name", pa.string()), ("seg_no", pa.int32()), ("text", pa.string()),
    ("section_path", pa.string()), ("page", pa.int32()), ("is_heading", pa.bool_()), ("is_table", pa.bool_()),
])


class FolderReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt([(f.path, f.size) for f in self.listed()], self.most) or [Files(())]


class FolderStream(_Folder, DataSourceStreamReader):
    """A batch has the files that have come, or changed, since the last one, by their time of change; those of the same instant by their path."""

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.listed()
        return {"at": found[-1].mtime_ns, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        since, until = (start["at"], start["path"]), (end["at"], end["path"])
        return dealt([(f.path, f.size) for f in self.listed() if since < (f.mtime_ns, f.path) <= until], self.most) or [Files(())]


class DocumentFolder(DataSource):
    """Options: path, kbId (0), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SEGMENT_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFolder)
