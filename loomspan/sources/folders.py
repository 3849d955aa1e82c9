"""Folders and the names of their files as a table, listed by Spark's tasks.

Spark's own readers list files alone and never see an empty folder. This source lists
each root's first level once; every folder found there is a task's to walk, however deep
it goes. Paths are those that pyarrow's file systems read (local ones and URIs), so
tasks need to see them, as files on a shared store are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root string, folder string, depth int, files array<string>, real string"
_ARROW = pa.schema([("root", pa.string()), ("folder", pa.string()), ("depth", pa.int32()), ("files", pa.list_(pa.string())), ("real", pa.string())])


class _Below(InputPartition):
    """A folder of a root; deep: with all below it."""

    def __init__(self, root: str, folder: str, deep: bool):
        self.root, self.folder, self.deep = root, folder, deep


def _opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


def _listed(root: str, folder: str) -> tuple[list[str], list[str]]:
    """Names of a folder's files and folders, sorted, without hidden ones; none where there is no such folder."""
    from pyarrow import fs

    system, base = _opened(root)
    found = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
    names = lambda kind: sorted(x.base_name for x in found if x.type == kind and not x.base_name.startswith("."))
    return names(fs.FileType.File), names(fs.FileType.Directory)


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], most: int | None):
        self.roots, self.most = roots, most

    def partitions(self) -> list[_Below]:
        out = []
        from pyarrow import fs

        for root in self.roots:
            system, base = _opened(root)
            if system.get_file_info(base).type != fs.FileType.Directory:
                continue
            _, folders = _listed(root, "")
            out += [_Below(root, "", False), *(_Below(root, f, True) for f in folders)]
        return out

    def read(self, partition: _Below | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no root is there
            return
        waiting, rows = [partition.folder], []
        while waiting:
            folder = waiting.pop()
            files, folders = _listed(partition.root, folder)
            depth = folder.count("/") + 1 if folder else 0
            base = _opened(partition.root)[1]
            path = f"{base}/{folder}".rstrip("/")
            rows.append((partition.root, folder, depth, files, os.path.realpath(path) if "://" not in partition.root else path))
            if partition.deep and (self.most is None or depth < self.most):
                waiting += [f"{folder}/{f}" for f in reversed(folders)]
            if len(rows) >= 4096 or not waiting:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                rows = []


class FolderSource(DataSource):
    """Options: roots (a JSON list of paths) and most (the depth to which folders are walked)."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        most = self.options.get("most")
        return _Reader(json.loads(self.options["roots"]), int(most) if most else None)


def read_folders(spark: SparkSession, roots: list[str], most: int | None = None) -> DataFrame:
    """(root, folder, depth, files, real) of every folder below the roots, empty ones and the roots themselves too.

    folder is the path below the root, files the sorted names of its own files, real the
    physical path. Hidden files and folders, and roots that aren't there, are left out.
    """
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("folders").option("roots", json.dumps(roots))
    return (reader if most is None else reader.option("most", most)).load()
