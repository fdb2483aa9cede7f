"""A folder of JSON documents as a Spark data source: read in parts, written as one indented object per file, whole or not at all.

    spark.dataSource.register(JsonFolder)
    spark.read.format("json_folder").load(folder)
    docs.write.format("json_folder").mode("append").save(folder)
"""

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .workers import find_package

SCHEMA = "doc_name string, model_id string, api_version string, content string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
#: Files of a part that is read by one task.
FILES = 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def json_files(path: str) -> list[str]:
    """*.json of the folder itself, in order; hidden files aren't documents."""
    files, at = opened(path)
    found = files.get_file_info(fs.FileSelector(at))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".json") and f.base_name[0] not in "._")


@dataclass
class Part(InputPartition):
    files: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        found = json_files(self.path)
        return [Part(found[a : a + self.size]) for a in range(0, len(found), self.size)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        files, _ = opened(self.path)
        for name in partition.files:
            with files.open_input_stream(name) as f:
                held = json.loads(f.read().decode("utf-8-sig"))
            held = held if isinstance(held, dict) else {}
            held.setdefault("doc_name", posixpath.basename(name))
            yield tuple(held.get(c) if held.get(c) is None or isinstance(held.get(c), str) else json.dumps(held[c]) for c in FIELDS)


@dataclass
class Written(WriterCommitMessage):
    folder: str


class Writer(DataSourceWriter):
    """Tasks write below a hidden folder; the commit moves the files out of it, an abort removes it. A task that runs twice has a
    folder for each attempt, and only that of the attempt that Spark accepts is moved."""

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite, self.staging = path.rstrip("/"), columns, overwrite, f"_staging-{uuid.uuid4().hex}"

    def _at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        files, at = opened(self.path)
        return files, "/".join([at.rstrip("/"), *parts])

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        task = TaskContext.get()
        folder = f"{task.partitionId()}-{task.taskAttemptId()}"
        files, at = self._at(self.staging, folder)
        files.create_dir(at, recursive=True)
        for row in iterator:
            held = dict(zip(self.columns, row, strict=True))
            name = held.get("doc_name")
            if not name or "/" in name or name[0] in "._":
                raise ValueError(f"not a file name: {name!r}")
            target = f"{at}/{name if name.endswith('.json') else name + '.json'}"
            if files.get_file_info(target).type != fs.FileType.NotFound:
                raise ValueError(f"two documents are named {name!r}")
            with files.open_output_stream(target) as f:
                f.write(json.dumps(held, indent=2, ensure_ascii=False).encode())
        return Written(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = self._at()
        base = base.rstrip("/")
        moves = [(f.path, f"{base}/{f.base_name}") for m in messages if m for f in files.get_file_info(fs.FileSelector(f"{base}/{self.staging}/{m.folder}"))]
        targets = {to for _, to in moves}
        there = set(json_files(self.path))
        if len(targets) < len(moves) or (not self.overwrite and targets & there):
            self.abort(messages)
            raise ValueError("documents of the same name; nothing is written")
        for gone in (there - targets) if self.overwrite else ():
            files.delete_file(gone)
        for at, to in moves:
            files.move(at, to)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, at = self._at(self.staging)
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)


class JsonFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("files", FILES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], schema.names, overwrite)


def write_folder(docs: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A file for each document (doc_name, content, or more fields), named after it. Without overwrite, a name that is taken is an
    error before anything is written; with it, other documents of the folder go."""
    spark = find_package(docs.sparkSession)
    spark.dataSource.register(JsonFolder)
    docs.write.format("json_folder").mode("overwrite" if overwrite else "append").save(folder)


def read_folder(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """(doc_name, model_id, api_version, content) of the folder's JSON files, so many to a task."""
    find_package(spark).dataSource.register(JsonFolder)
    return spark.read.format("json_folder").option("files", files).load(folder)
