"""Files through Spark's own file systems, namespaces, and versioned tables: data files named by manifests.

A version of a table is a manifest that lists its data folders. Manifests are numbered; making the next one fails if another
writer took its number, so a version appears at once or not at all, and what was computed from an older version is refused.
Old data stays for readers that hold an old version, until it is swept.
"""

from __future__ import annotations

import json
import os
import random
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class StoreError(RuntimeError):
    """A table that is damaged or was written by another at the same time."""


class Conflict(StoreError):
    """Another writer made the version that this one would have made."""


Result = TypeVar("Result")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; where that is unset, below a temporary folder if the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarn-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def namespace(text: str) -> str:
    """A folder name of the words between characters that no folder name should have; without any, "records"."""
    return "-".join(re.findall(r"[\w.-]+", text, re.ASCII)).strip("-.") or "records"


def partition_folder(ms: int, by: str) -> str:
    """The folder of a log that is opened at a time: a UTC day or month."""
    forms = {"daily": "%Y-%m-%d", "monthly": "%Y-%m"}
    if by not in forms:
        raise ValueError(f"unknown partition: {by!r}")
    return datetime.fromtimestamp(ms / 1000, UTC).strftime(forms[by])


class Files:
    """Small files of any Hadoop file system, from the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.root = spark, spark._jvm, root.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def names(self, folder: str) -> list[str]:
        path = self.path(self.at(folder))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def size(self, name: str) -> int:
        path = self.path(self.at(name))
        return self.fs.getContentSummary(path).getLength() if self.fs.exists(path) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(self.at(name)))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file was made; an existing one is left as it is. The file appears whole, to one of any writers.

        On a local file system a part file is linked to the name and on HDFS moved to it, both of which fail if the name is
        taken; an object store creates an object at once, if its create without overwrite is conditional."""
        target = self.path(self.at(name))
        scheme = self.fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            return self._written(target, text)
        part = self.path(self.at(f"{name}.{uuid.uuid4().hex}.part"))
        self._written(part, text)
        if scheme != "file":
            made = not self.fs.exists(target) and self.fs.rename(part, target)
        else:
            try:
                os.link(part.toUri().getPath(), target.toUri().getPath())
                made = True
            except FileExistsError:
                made = False
        if scheme == "file" or not made:
            self.fs.delete(part, False)
        return made

    def _written(self, path: object, text: str) -> bool:
        try:
            stream = self.fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def age(self, name: str) -> float:
        """Seconds since the file or folder was last written."""
        return time.time() - self.fs.getFileStatus(self.path(self.at(name))).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(self.at(name)), True)


class Versions:
    """The manifests of a table; a version's content is any JSON object."""

    WIDTH = 20

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def latest(self) -> tuple[int, dict]:
        found = [n for n in self.files.names("_versions") if n.endswith(".json")]
        return (int(found[-1][: self.WIDTH]), json.loads(self.files.read(f"_versions/{found[-1]}"))) if found else (0, {})

    def commit(self, after: int, content: dict) -> int:
        """Makes the version after the one that was read."""
        if not self.files.create(f"_versions/{after + 1:0{self.WIDTH}d}.json", json.dumps(content)):
            raise Conflict(f"another writer made version {after + 1} of {self.files.root}")
        return after + 1

    def exclusively(self, step: Callable[[int], Result], tries: int = 20) -> Result:
        """step(version), again as long as another writer comes in between. The step reads the table after the version was taken
        and commits after exactly that version, so what it decided holds for the table that it changes."""
        for n in range(tries):
            try:
                return step(self.latest()[0])
            except Conflict:
                time.sleep(random.random() * 0.05 * (n + 1))
        raise Conflict(f"{self.files.root} is written too often")

    def sweep(self, keep: int = 2, seconds: float = 86_400) -> dict:
        """Deletes manifests but the last ones, and folders and part files that those do not name; nothing younger than the
        given age goes, so a writer that has not committed yet keeps its folder."""
        numbers = [n for n in self.files.names("_versions") if n.endswith(".json")]
        old, kept = numbers[:-keep], numbers[-keep:]
        named = {f for n in kept for f in _folders(json.loads(self.files.read(f"_versions/{n}")))}
        gone = [f"_versions/{n}" for n in (*old, *(n for n in self.files.names("_versions") if n.endswith(".part")))]
        gone += [n for n in self.files.names("") if re.match("(commit|data)-", n) and n not in named]
        gone = [n for n in gone if self.files.age(n) >= seconds]
        for n in gone:
            self.files.delete(n)
        return {"manifests": sum(n.endswith(".json") for n in gone), "parts": sum(n.endswith(".part") for n in gone), "folders": sum("/" not in n for n in gone)}


def _folders(content: dict) -> list[str]:
    return [content["data"]] if "data" in content else [f["path"] for f in content.get("folders", [])]


class VersionedTable:
    """A table that is replaced as a whole: a full copy each version."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.schema, self.versions = spark, schema, Versions(spark, root)

    def read(self) -> DataFrame:
        _, content = self.versions.latest()
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(self.versions.files.at(content["data"])) if content.get("data") else self.spark.createDataFrame([], self.schema)

    def replace(self, frame: DataFrame, after: int | None = None) -> None:
        """The frame becomes the table. With `after`, the version from which it was made, another writer's version is refused."""
        number = self.versions.latest()[0] if after is None else after
        folder = f"data-{uuid.uuid4().hex}"
        frame.select(*self.schema.names).write.parquet(self.versions.files.at(folder))
        self.versions.commit(number, {"data": folder})
