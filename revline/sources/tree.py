"""A folder tree as a Python data source: (path, content, error), a row for every file, empty ones included.

The driver lists only the folders of the first ``depth`` levels: each is one partition, which walks what lies below it
on an executor, a file at a time. The files that lie in a listed folder itself come with that folder's partition.
Links to folders are not followed; what cannot be listed or read is a row with an error.
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "revline_tree"

    def schema(self) -> str:
        return "path string, content binary, error string"

    def reader(self, schema):
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["root"])
        self.suffixes = tuple(options.get("suffixes", "").split("\n"))
        self.depth = int(options.get("depth", "1"))
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no such folder: {self.root}")

    def partitions(self):
        out, level = [], [self.root]
        for _ in range(self.depth):
            out += [Folder(p, False) for p in level]
            level = [e.path for p in level for e in self._entries(p) if e.is_dir(follow_symlinks=False)]
        return out + [Folder(p, True) for p in level]

    @staticmethod
    def _entries(path: str):
        try:
            with os.scandir(path) as found:
                return sorted(found, key=lambda e: e.name)
        except OSError:
            return []

    def _told(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")

    def read(self, partition):
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            try:
                os.scandir(folder).close()
            except OSError as e:
                yield self._told(folder), None, f"cannot list: {e.strerror}"
                continue
            for entry in self._entries(folder):
                if entry.is_dir(follow_symlinks=False):
                    if partition.deep:
                        todo.append(entry.path)
                elif entry.name.endswith(self.suffixes) and entry.is_file():
                    try:
                        with open(entry.path, "rb") as f:
                            yield self._told(entry.path), f.read(), None
                    except OSError as e:
                        yield self._told(entry.path), None, f"cannot read: {e.strerror}"
