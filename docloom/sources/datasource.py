"""Files as a Python data source: listed in partitions, read by the tasks, and a row for each file even
where it can't be read.

    spark.dataSource.register(FileSource)
    spark.read.format("document_files").option("folder", folder).load()  # path, content, error

The driver lists only as many folders as make `SPREAD` parts; each task walks its own ones, hidden names
included, and reads what it finds there. What a task can't open, or what vanished since it was listed, gets
an `error` and no content, and stops no other file. Executors need the same mount as the driver.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "document_files"
SCHEMA = "path string, content binary, error string"
#: Folders that are listed apart at least, files of a partition, and bytes of a batch.
SPREAD, FILES, BYTES = 64, 64, 16 << 20


@dataclass
class Part(InputPartition):
    files: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(None)


class FileSource(DataSource):
    """Options: `folder`, or `paths` (JSON list); `extensions` (JSON list, small letters) of the files to take."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(dict(self.options))


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.paths = options.get("folder"), json.loads(options.get("paths", "[]"))
        self.extensions = frozenset(json.loads(options["extensions"])) if "extensions" in options else None

    def wanted(self, name: str) -> bool:
        return self.extensions is None or os.path.splitext(name)[1].lower() in self.extensions

    def partitions(self) -> list[Part]:
        files, folders = list(self.paths), deque([self.folder] if self.folder else [])
        while folders and len(folders) < SPREAD:
            at = folders.popleft()
            try:
                entries = sorted(os.scandir(at), key=lambda e: e.name)
            except OSError:
                files.append(at)  # its task says why
                continue
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    folders.append(e.path)
                elif self.wanted(e.name):
                    files.append(e.path)
        parts = [Part(files=files[i : i + FILES]) for i in range(0, len(files), FILES)]
        return (parts + [Part(folders=[f]) for f in folders]) or [Part()]

    def found(self, part: Part) -> Iterator[tuple[str, str | None]]:
        """(path, error) of the part's files."""
        yield from ((p, None) for p in part.files)
        for top in part.folders:
            bad: list[OSError] = []
            for at, _, names in os.walk(top, onerror=bad.append):
                yield from ((os.path.join(at, n), None) for n in sorted(names) if self.wanted(n))
            yield from ((e.filename, str(e)) for e in bad)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, bytes | None, str | None]] = []
        held = 0
        for path, error in self.found(part):
            content = None
            if error is None:
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
            rows.append((path, content, error))
            held += len(content or b"")
            if held >= BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.binary(), pa.string()))], ["path", "content", "error"])
