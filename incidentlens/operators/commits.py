"""Tables as folders of Parquet parts with an optimistic log of commits, on any file system that Hadoop opens.

A table's folder holds its parts and ``_commits/<number>.json``, each a whole list of the parts that make up that version.  A
writer writes new parts first, then tries to create the next number.  Whoever creates it has committed; whoever
comes second reads the newer version and starts over, so no write is lost and readers see a version whole or not at all.

Creation is atomic where the file system's is: a rename that refuses an existing target (HDFS and its kin) or, on local disks,
a hard link.  Object stores need a connector whose rename refuses existing targets.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

VERSION = 2
#: Versions whose parts stay for readers that began before the last commits; parts of a table before they are written as one.
KEEP, MOST_PARTS, TRIES = 3, 24, 50


class Conflict(RuntimeError):
    """Other writers were faster every time."""


class Files:
    """What the log needs of a file system; paths are Hadoop's, with or without a scheme."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = self._path(folder)
        self._fs = path.getFileSystem(self._conf)
        self.folder = self._fs.makeQualified(path).toString()
        self.local = self._fs.getScheme() == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def at(self, *names: str) -> str:
        return "/".join([self.folder, *names])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """What lies in a folder; nothing in one that is missing."""
        try:
            return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))
        except Exception as e:  # the JVM's FileNotFoundException comes wrapped
            if "FileNotFoundException" in str(e):
                return []
            raise

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a whole file unless there is one by that name; whether it did."""
        fresh = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp"
        self._write(fresh, text)
        try:
            if self.local:
                plain = lambda p: self._path(p).toUri().getPath()
                try:
                    os.link(plain(fresh), plain(path))
                except FileExistsError:
                    return False
                return True
            return self._renamed(fresh, path)
        finally:
            self.delete(fresh)

    def _renamed(self, fresh: str, path: str) -> bool:
        """Only one of several renames to a name that is free moves its file; the others are refused by the file system itself."""
        return not self.exists(path) and self._fs.rename(self._path(fresh), self._path(path))

    def move(self, source: str, target: str) -> None:
        if self.exists(target) or not self._fs.rename(self._path(source), self._path(target)):
            raise ValueError(f"{target} exists")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0


class Table:
    """One table below ``files.folder``."""

    def __init__(self, spark: SparkSession, files: Files, name: str):
        self.spark, self.files, self.name = spark, files, name
        self.log = files.at(name, "_commits")

    def latest(self) -> tuple[int, dict | None]:
        """(number, content) of the last commit; (0, None) before the first."""
        for _ in range(TRIES):
            numbers = [int(n[:-5]) for n in self.files.names(self.log) if n.endswith(".json") and n[:-5].isdigit()]
            if not numbers:
                return 0, None
            try:
                return max(numbers), json.loads(self.files.read(f"{self.log}/{max(numbers):08d}.json"))
            except Exception as e:  # two commits later its file may be gone: look again
                if "FileNotFoundException" not in str(e):
                    raise
        raise Conflict(f"{self.name} changes faster than it can be read")

    def frame(self, content: dict) -> DataFrame:
        schema = StructType.fromJson(content["schema"])
        if not content["parts"]:
            return self.spark.createDataFrame([], schema)
        # Each part is its own root, so that partition folders in it are columns.
        paths = [self.files.at(self.name, p) for p in content["parts"]]
        found = None
        for path in paths if content.get("slots") else [paths]:
            some = self.spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path))
            found = some if found is None else found.unionByName(some)
        return found

    def read(self) -> DataFrame | None:
        _, content = self.latest()
        return None if content is None else self.frame(content)

    def write_part(self, df: DataFrame, by: str | None = None, **options) -> dict:
        """Writes ``df`` as a part that no version has yet."""
        part = f"part-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd").options(**options)
        (writer.partitionBy(by) if by else writer).parquet(self.files.at(self.name, part))
        return {"parts": [part], "schema": df.schema.jsonValue(), "slots": by}

    def commit(self, change: Callable[[dict | None], dict]) -> dict:
        """Commits what ``change`` makes of the last version's content.  It may be called again, with a newer version."""
        for _ in range(TRIES):
            number, content = self.latest()
            wanted = change(content) | {"schema_version": VERSION}
            if self.files.create(f"{self.log}/{number + 1:08d}.json", json.dumps(wanted)):
                self._forget(number + 1, wanted)
                return wanted
            for part in set(wanted["parts"]) - set((content or {}).get("parts", [])):
                if part.startswith("part-"):  # written for this commit: nobody has seen it
                    self.files.delete(self.files.at(self.name, part))
        raise Conflict(f"{TRIES} commits to {self.name} lost to other writers")

    def replace(self, df: DataFrame, by: str | None = None, **options) -> None:
        self.commit(lambda _: self.write_part(df, by, **options))

    def append(self, rows: Callable[[DataFrame | None], DataFrame]) -> None:
        """Adds the rows that ``rows`` makes, given the table as it is; after many small parts all are written as one."""

        def change(content: dict | None) -> dict:
            before = None if content is None else self.frame(content)
            fresh = rows(before)
            if content is None or not content["parts"]:
                return self.write_part(fresh.coalesce(1))
            if len(content["parts"]) >= MOST_PARTS:
                return self.write_part(before.unionByName(fresh).coalesce(1))
            made = self.write_part(fresh.coalesce(1))
            return content | {"parts": content["parts"] + made["parts"]}

        self.commit(change)

    def _forget(self, number: int, content: dict) -> None:
        """Drops versions over KEEP commits old and the parts that only they list.  A part that no commit lists is another writer's."""
        old = [n for n in self.files.names(self.log) if n.endswith(".json") and n[:-5].isdigit() and int(n[:-5]) <= number - KEEP]
        held = set(content["parts"])
        for n in range(max(1, number - KEEP + 1), number):
            try:
                held |= set(json.loads(self.files.read(f"{self.log}/{n:08d}.json"))["parts"])
            except Exception as e:
                if "FileNotFoundException" not in str(e):
                    raise
        for name in old:
            try:
                parts = json.loads(self.files.read(f"{self.log}/{name}"))["parts"]
            except Exception as e:  # another writer forgets too
                if "FileNotFoundException" not in str(e):
                    raise
                continue
            for part in set(parts) - held:
                self.files.delete(self.files.at(self.name, part))
            self.files.delete(f"{self.log}/{name}")

    def drop(self) -> None:
        """The table with all its versions."""
        self.files.delete(self.files.at(self.name))
