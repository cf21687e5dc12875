"""A data source that writes documents as files of their own: `text_documents`, for rows of name and text.

A task writes each of its files under another name and moves it to its own, so a file is whole or absent; a repeated task
puts the same files in place again. Each attempt lists its files in a part of its own below _manifest. The commit names
the parts of the attempts that count in _manifest.json, which holds a line for each task, not for each file; files are
published by it (committed_files() reads it), and a folder that has one isn't written again. An aborted job takes its marker
away and deletes what its attempts have listed; a task that runs on without the marker takes back its last file and stops.
Nothing is collected: tasks send the name of their part and two numbers.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "name string, text string"
PARTS, MANIFEST, WRITING = "_manifest", "_manifest.json", "_writing"
LISTED = "name string, bytes bigint, crc32 bigint"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def checked(name: str | None) -> str:
    """A relative path below the folder; other names are errors, as are those that the commit uses."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") for p in parts) or parts[0].startswith("_"):
        raise ValueError(f"not a file name below the folder: {name!r}")
    return name


def replaced(store: fs.FileSystem, root: str, name: str, data: bytes, attempt: str) -> None:
    """The file put in place in one step."""
    target, own = posixpath.join(root, name), posixpath.join(root, WRITING, f"{attempt}-{uuid.uuid4().hex}")
    store.create_dir(posixpath.dirname(target), recursive=True)
    store.create_dir(posixpath.dirname(own), recursive=True)
    with store.open_output_stream(own) as f:
        f.write(data)
    if store.get_file_info(target).type != fs.FileType.NotFound and not isinstance(store, fs.LocalFileSystem):
        # Some stores don't move onto a file.
        store.delete_file(target)
    store.move(own, target)


@dataclass
class Written(WriterCommitMessage):
    part: str
    files: int
    bytes: int


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.marker = path, f"{WRITING}/{uuid.uuid4().hex}.job"
        store, root = opened(path)
        replaced(store, root, self.marker, b"", "job")

    def stopped(self, store: fs.FileSystem, root: str) -> bool:
        return store.get_file_info(posixpath.join(root, self.marker)).type == fs.FileType.NotFound

    def write(self, iterator) -> Written:
        (store, root), attempt = opened(self.path), uuid.uuid4().hex
        files = size = 0
        store.create_dir(posixpath.join(root, PARTS), recursive=True)
        part = f"{PARTS}/{attempt}.jsonl"
        with store.open_output_stream(posixpath.join(root, part)) as listing:
            for row in iterator:
                name, data = checked(row["name"]), (row["text"] or "").encode()
                # Listed first, so that an abort finds every file that there can be.
                listing.write(json.dumps({"name": name, "bytes": len(data), "crc32": zlib.crc32(data)}).encode() + b"\n")
                listing.flush()
                if not self.stopped(store, root):
                    replaced(store, root, name, data, attempt)
                if self.stopped(store, root):
                    if store.get_file_info(posixpath.join(root, name)).type == fs.FileType.File:
                        store.delete_file(posixpath.join(root, name))
                    raise RuntimeError("the job was aborted")
                files, size = files + 1, size + len(data)
        return Written(part, files, size)

    def commit(self, messages) -> None:
        store, root = opened(self.path)
        done = [m for m in messages if m is not None]
        text = json.dumps({"parts": [m.part for m in done], "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)})
        replaced(store, root, MANIFEST, text.encode(), "commit")
        self.clear(store, root, WRITING)

    def abort(self, messages) -> None:
        store, root = opened(self.path)
        self.clear(store, root, WRITING)
        for info in store.get_file_info(fs.FileSelector(posixpath.join(root, PARTS), allow_not_found=True)):
            with store.open_input_stream(info.path) as f:
                for line in f.read().splitlines():
                    name = posixpath.join(root, json.loads(line)["name"])
                    if store.get_file_info(name).type == fs.FileType.File:
                        store.delete_file(name)
        self.clear(store, root, PARTS)

    @staticmethod
    def clear(store: fs.FileSystem, root: str, folder: str) -> None:
        if store.get_file_info(posixpath.join(root, folder)).type == fs.FileType.Directory:
            store.delete_dir(posixpath.join(root, folder))


class TextDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_documents"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> Writer:
        store, root = opened(self.options["path"])
        if store.get_file_info(posixpath.join(root, MANIFEST)).type != fs.FileType.NotFound:
            raise ValueError(f"already written: {self.options['path']}")
        return Writer(self.options["path"])


def write_files(named: DataFrame, path: str) -> None:
    """Rows of name and text as UTF-8 files of those names below path, without a mark. Names that occur twice are an error, found
    before anything is written."""
    twice = named.groupBy("name").count().where("count > 1 or name is null").head()
    if twice:
        raise ValueError(f"not the name of one document: {twice.name!r}")
    named.sparkSession.dataSource.register(TextDocuments)
    named.select("name", "text").write.format("text_documents").mode("append").save(path)


def committed_files(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, crc32 of the files that the commit has published."""
    store, root = opened(path)
    with store.open_input_stream(posixpath.join(root, MANIFEST)) as f:
        parts = json.loads(f.read())["parts"]
    return spark.read.schema(LISTED).json([f"{path.rstrip('/')}/{p}" for p in parts]) if parts else spark.createDataFrame([], LISTED)
