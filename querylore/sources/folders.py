"""Folders of real files as a Spark data source: one row, one file.

    files.write.format("named_files").mode("overwrite").save(path)     # (name, content)
    spark.read.format("named_files").load(path)

Tasks write their files into a folder beside the target. A file that is there already, from another run of the task, is replaced by a whole
one, so a task that is run again leaves the same files. Every task also lists what it wrote in files of ``LIST`` (a list names about ``PART_BYTES`` of content). The commit renames the
folder to its place: until then, and if the write is killed, nobody sees a page. A reader deals out the lists to its tasks, so
neither side ever lists the files themselves and there is nothing to be found out about partitions.

Any other folder can be read as well; its files are then listed once, and dealt out ``LISTED`` at a time.

A folder takes new files one after another, whatever the number of tasks, so many files are best dealt out to folders (``dealt_name``).

The folder must be on a store that all executors share and whose folders can be renamed (a mounted path, HDFS).
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

LIST = "_list"
PART_BYTES = 8 << 20
LISTED = 256
# a batch of files that go to Spark together ends at the first of these
BATCH_FILES = 1_000
BATCH_BYTES = 1 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), os.path.abspath(path)


def safe_name(name: str) -> str:
    """A file name that stays below its folder."""
    parts = name.split("/")
    if not name or any(p in ("", ".", "..") for p in parts) or parts[0] == LIST:
        raise ValueError(f"not a file name below a folder: {name!r}")
    return name


def _put(store: fs.FileSystem, path: str, content: bytes, made: set[str] | None = None, below: str | None = None) -> None:
    """The file appears whole or not at all. Folders in ``made`` are there; those made here are added, if the folder ``below`` is there."""
    folder, _, name = path.rpartition("/")
    made = set() if made is None else made
    if folder not in made:
        if below and store.get_file_info(below).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{below} is gone: the write has ended")
        store.create_dir(folder, recursive=True)
        made.add(folder)
    unfinished = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(unfinished, compression=None) as out:
        out.write(content)
    store.move(unfinished, path)


def _make_folder(folder: str, made: set[str], below: str) -> None:
    """A folder below one that must be there: ``mkdir`` fails where it is gone."""
    if folder in made:
        return
    if folder != below:
        _make_folder(folder.rpartition("/")[0], made, below)
        with contextlib.suppress(FileExistsError):
            os.mkdir(folder)
    elif not os.path.isdir(folder):
        raise FileNotFoundError(f"{below} is gone: the write has ended")
    made.add(folder)


def _put_new(store: fs.FileSystem, path: str, content: bytes, made: set[str], below: str) -> None:
    """A file nobody reads before the whole folder is there. On a mounted store it is written in its place when the place is free, which spares two
    changes of its folder. A place that is taken, be it by half a file of a task that was killed, gets a whole file by rename."""
    if not isinstance(store, fs.LocalFileSystem):
        return _put(store, path, content, made, below)
    _make_folder(path.rpartition("/")[0], made, below)
    try:
        file = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o666)
    except FileExistsError:
        return _put(store, path, content, made, below)
    try:
        left = memoryview(content)
        while left:
            left = left[os.write(file, left) :]
    finally:
        os.close(file)


def put_file(path: str, content: bytes) -> None:
    """One file, whole or not at all; an older one of the name is replaced."""
    store, at = _store(path)
    _put(store, at, content)


def open_file(path: str):
    store, at = _store(path)
    return store.open_input_stream(at)


def folder_names(path: str) -> list[str]:
    """The names right below a folder."""
    store, at = _store(path)
    return [f.base_name for f in store.get_file_info(fs.FileSelector(at))]


@dataclass
class Written(WriterCommitMessage):
    files: int


class FolderWriter(DataSourceArrowWriter):
    """Writes what ``files`` makes of a task's rows."""

    def __init__(self, path: str, overwrite: bool):
        store, root = _store(path)
        if not overwrite and store.get_file_info(root).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists; folders of files are written whole")
        self.path, self.unseen = path, f"{root.rstrip('/')}.{uuid.uuid4().hex}"
        store.create_dir(self.unseen, recursive=True)  # made here alone, so that no task brings it back after an abort

    def files(self, batches: Iterator[pa.RecordBatch], task: int) -> Iterator[tuple[str, bytes]]:
        """(name, content) of each file. Names are unique over all tasks."""
        raise NotImplementedError

    def write(self, iterator):
        store, task = _store(self.path)[0], TaskContext.get().partitionId()
        names, size, lists, count, made = [], 0, 0, 0, set()

        def listed():
            _put(store, f"{self.unseen}/{LIST}/{task:06d}-{lists:06d}", "\n".join(json.dumps(n) for n in names).encode(), made, self.unseen)

        for name, content in self.files(iterator, task):
            _put_new(store, f"{self.unseen}/{safe_name(name)}", content, made, self.unseen)
            names.append(name)
            size, count = size + len(content), count + 1
            if size >= PART_BYTES:
                listed()
                names, size, lists = [], 0, lists + 1
        if names:
            listed()
        return Written(count)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        store.create_dir(f"{self.unseen}/{LIST}", recursive=True)
        old = f"{self.unseen}.old"
        replaced = store.get_file_info(root).type != fs.FileType.NotFound
        if replaced:
            store.move(root, old)
        else:
            store.create_dir(root.rpartition("/")[0], recursive=True)
        store.move(self.unseen, root)
        if replaced:
            store.delete_dir(old)

    def abort(self, messages) -> None:
        store = _store(self.path)[0]
        for _ in range(10):  # a task that is just making a folder can bring it back
            if store.get_file_info(self.unseen).type != fs.FileType.NotFound:
                with contextlib.suppress(OSError):
                    store.delete_dir(self.unseen)
            time.sleep(0.1)


@dataclass
class ListPart(InputPartition):
    path: str | None
    names: list[str]


class FolderReader(DataSourceReader):
    """Reads the files of each list, in the order they were written, through ``rows``."""

    def __init__(self, path: str):
        self.path = path

    def rows(self, files: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def partitions(self):
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{LIST}").type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(f"{root}/{LIST}"))
            return [ListPart(f.path, []) for f in sorted(found, key=lambda f: f.path) if not f.base_name.startswith(".")]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path[len(root.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File)
        names = [n for n in names if not any(p.startswith((".", "_")) for p in n.split("/"))]
        return [ListPart(None, names[i : i + LISTED]) for i in range(0, len(names), LISTED)]

    def read(self, partition):
        if partition is None:  # a folder without files
            return
        store, root = _store(self.path)

        def files():
            names = partition.names
            if partition.path:
                with store.open_input_stream(partition.path) as listed:
                    names = [json.loads(line) for line in listed.read().decode().split("\n")]
            for name in names:
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    yield name, file.read()

        yield from self.rows(files())


class _NamedWriter(FolderWriter):
    def files(self, batches, task):
        for batch in batches:
            names, contents = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "content"))
            for i in sorted(range(len(names)), key=names.__getitem__):  # the files of a folder one after another; of one name the last still comes last
                yield names[i], contents[i] or b""


class _NamedReader(FolderReader):
    def rows(self, files):
        def batch():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])

        names, contents, size = [], [], 0
        for name, content in files:
            names.append(name)
            contents.append(content)
            size += len(content)
            if len(names) >= BATCH_FILES or size >= BATCH_BYTES:
                yield batch()
                names, contents, size = [], [], 0
        if names:
            yield batch()


class NamedFiles(DataSource):
    """(name string, content binary): a file for each row. Names are unique and not null; a null content is an empty file."""

    @classmethod
    def name(cls):
        return "named_files"

    def schema(self):
        return "name string, content binary"

    def reader(self, schema):
        return _NamedReader(self.options["path"])

    def writer(self, schema, overwrite):
        return _NamedWriter(self.options["path"], overwrite)


def dealt_name(name: Column) -> Column:
    """The name in one of 256 folders, by its hash."""
    return F.concat(F.left(F.md5(name), F.lit(2)), F.lit("/"), name)


def write_files(files: DataFrame, path: str) -> str:
    """Rows (name, content as text or binary) as real files of these names; an older folder of that path is replaced."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select(files["name"].cast("string"), files["content"].cast("binary")).write.format("named_files").mode("overwrite").save(path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content binary) of the files of a folder; names are paths below it."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").load(path)
