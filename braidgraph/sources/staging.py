"""Staged texts as files, one for each document, through Spark's data source writer (format ``braid_staged``).

Rows are (staged_path, text). Each task attempt writes into a folder of its own under
``<path>/_staging/<job>``; when the job commits, the files of the attempts that count
are moved to their places and the folder goes, with whatever lost attempts left there.
A job that fails leaves nothing: its folder is moved away first, so that a task that is
still running finds no place to write to. ``overwrite`` also removes files that the job did not
write. The folder must be one that driver and tasks share.

A null text is an empty file; a null path, or one that leaves the folder, is an error.
Of rows that share a path the last one stays. Only file names reach the driver.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from braidgraph.sources.caches import safe_join

_WORK = "_staging"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class StagedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "braid_staged"

    def schema(self) -> str:
        return "staged_path string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return StagedWriter(self.options["path"], overwrite)


class StagedWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.removeprefix("file://"), overwrite
        self.work = os.path.join(self.path, _WORK, uuid.uuid4().hex)
        os.makedirs(self.work)  # on the driver; tasks make folders in it only while it is there

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, names = os.path.join(self.work, uuid.uuid4().hex), {}
        os.mkdir(folder)
        for row in iterator:
            if row.staged_path is None or row.staged_path.partition("/")[0] == _WORK:
                raise ValueError(f"{row.staged_path!r} is no place for a text")
            safe_join(self.path, row.staged_path)
            number = names.setdefault(row.staged_path, len(names))
            with open(os.path.join(folder, str(number)), "w", encoding="utf-8", newline="") as f:
                f.write(row.text or "")
        return Written(folder, list(names))

    def commit(self, messages: list[Written | None]) -> None:
        kept = set()
        for m in filter(None, messages):
            for number, name in enumerate(m.names):
                to = safe_join(self.path, name)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                os.replace(os.path.join(m.folder, str(number)), to)
                kept.add(os.path.normpath(to))
        self._clean()
        if self.overwrite:
            for d, folders, names in os.walk(self.path):
                if os.path.normpath(d) == os.path.normpath(self.path):
                    folders[:] = [f for f in folders if f != _WORK]  # another job's
                for n in names:
                    if os.path.normpath(os.path.join(d, n)) not in kept:
                        os.remove(os.path.join(d, n))

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        try:
            os.rename(self.work, f"{self.work}-gone")
            shutil.rmtree(f"{self.work}-gone", ignore_errors=True)
            os.rmdir(os.path.dirname(self.work))
        except OSError:
            pass  # it is gone, or another job is at work beside it


def write_staged(staged: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write (staged_path, text) rows as files under ``path``."""
    staged.sparkSession.dataSource.register(StagedFiles)
    staged.select("staged_path", "text").write.format(StagedFiles.name()).mode("overwrite" if overwrite else "append").option("path", path).save()
