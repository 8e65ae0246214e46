"""Several tables replaced together: all of them are new afterwards, or all of them old, whatever fails in between.

New tables are written beside the old ones and checked. A journal then names the tables; from there on each old table is
moved aside and the new one put in its place. One rename of the journal is the commit: before it, :func:`recover` brings every old table
back; after it, it only clears away what is left over. A process that died is recovered from the journal by the next one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Files:
    """The operations on a Hadoop file system that a promotion consists of; every one either happens or raises."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def move(self, a: str, b: str) -> None:
        p, fs = self._at(a)
        if self.exists(b) or not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(b)):
            raise OSError(f"can't move {a} to {b}")

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        if fs.exists(p) and not fs.delete(p, True):
            raise OSError(f"can't delete {path}")

    def write(self, path: str, text: str) -> None:
        """A whole file or none: written under another name and moved."""
        p, fs = self._at(f"{path}.new")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.move(f"{path}.new", path)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        found = fs.open(p)
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()


def recover(files: Files, journal: str) -> str:
    """Ends a promotion that was cut short: ``back`` (old tables stand again), ``on`` (new ones stay) or ``clean`` (there was none). May itself be repeated."""
    files.remove(f"{journal}.new")
    if files.exists(f"{journal}.committed"):
        for t in json.loads(files.read(f"{journal}.committed")):
            files.remove(f"{t['path']}.backup")
        files.remove(f"{journal}.committed")
        return "on"
    if not files.exists(journal):
        return "clean"
    for t in json.loads(files.read(journal)):
        path = t["path"]
        if files.exists(f"{path}.backup"):
            files.remove(path)
            files.move(f"{path}.backup", path)
        elif not t["old"]:
            files.remove(path)
        files.remove(f"{path}.staged")
    files.remove(journal)
    return "back"


def promote(frames: dict[str, DataFrame], journal: str, check: Callable[[dict[str, DataFrame]], None] = lambda _: None, files: Files | None = None) -> None:
    """Replaces the tables at the paths of ``frames`` together; ``check`` gets what was written and raises to refuse it.

    A promotion that was cut short under the same journal is ended first. If anything fails, the old tables stand as they were and the error is raised.
    """
    if not frames:
        return
    spark = next(iter(frames.values())).sparkSession
    files = files or Files(spark)
    recover(files, journal)
    try:
        for path, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{path}.staged")
        check({path: spark.read.parquet(f"{path}.staged") for path in frames})
        for path in frames:
            files.remove(f"{path}.backup")  # of a process that died before its journal
        files.write(journal, json.dumps([{"path": path, "old": files.exists(path)} for path in frames]))
        for path in frames:
            if files.exists(path):
                files.move(path, f"{path}.backup")
            files.move(f"{path}.staged", path)
        files.move(journal, f"{journal}.committed")
    except BaseException:
        if recover(files, journal) == "clean":
            for path in frames:
                files.remove(f"{path}.staged")
        raise
    recover(files, journal)
