"""Files of an index: the few operations that Spark's readers and writers lack, and numbered manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Manifests that are kept, the newest included.
KEEP = 3


class Conflict(RuntimeError):
    """Another writer has changed the index meanwhile."""


class Files:
    """File operations in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path, self.root = jvm.org.apache.hadoop.fs.Path, root
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.io = jvm.org.apache.commons.io.IOUtils

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, content: str) -> None:
        """A new file, whole from the moment that it has its name."""
        part = f".part-{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(part), True)
        stream.write(content.encode())
        stream.close()
        self.move(part, name)

    def move(self, old: str, new: str) -> None:
        """One rename; what has the new name already stays and is a conflict."""
        self.fs.mkdirs(self.at(new).getParent())
        if self.exists(new) or not self.fs.rename(self.at(old), self.at(new)):
            self.delete(old)
            raise Conflict(f"{self.root}/{new} is there already")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(folder))) if self.exists(folder) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength()


class Manifests:
    """The manifest's versions, each a file of its own: a reader finds the old one or the new one, never none."""

    def __init__(self, files: Files, folder: str = "manifest"):
        self.files, self.folder = files, folder

    def newest(self) -> dict | None:
        """The newest one that can be read; one that is torn is passed over."""
        for name in reversed(self.files.names(self.folder)):
            if name.endswith(".json") and not name.startswith("."):
                try:
                    return json.loads(self.files.read(f"{self.folder}/{name}"))
                except ValueError:
                    continue
        return None

    def save(self, manifest: dict) -> None:
        """Under the next version's name; raises ``Conflict`` if that is taken."""
        self.files.create(f"{self.folder}/{manifest['version']:012d}.json", json.dumps(manifest, indent=1))
        for name in [n for n in self.files.names(self.folder) if n.endswith(".json") and not n.startswith(".")][:-KEEP]:
            self.files.delete(f"{self.folder}/{name}")
