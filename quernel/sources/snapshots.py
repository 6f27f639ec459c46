"""Snapshots of tables as Parquet under one folder: a commit writes new table versions, then one manifest that names them."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A folder of any file system that Spark can reach; all access goes through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self) -> list[str]:
        """What lies in the folder itself."""
        return [x.getPath().getName() for x in self._fs.listStatus(self._at(""))] if self.exists() else []

    def create_text(self, name: str, text: str) -> None:
        """A new file, whole or not at all: written beside, then renamed. An existing one stays and raises FileExistsError."""
        beside = f".{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(name) or not self._fs.rename(self._at(beside), self._at(name)):
            self._fs.delete(self._at(beside), False)
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def write_frame(self, name: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return self.read_frame(name)

    def read_frame(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


_MANIFEST = re.compile(r"manifest-(\d{12})\.json")
#: Manifests that are kept, the current one included.
KEPT = 3


class Store:
    """Versioned tables: the manifest of the highest number names the current folder of each, so readers see one commit or the next.

    Manifests are only ever added; a commit is the appearance of the next one. A crash before that leaves the old commit, one after it
    the new. Of two writers that commit the same number the second fails.
    """

    def __init__(self, folder: Folder):
        self.folder = folder

    def load(self) -> dict:
        found = self._manifests()
        return json.loads(self.folder.read_text(found[-1])) if found else {"version": 0, "user_version": 0, "tables": {}}

    def _manifests(self) -> list[str]:
        return sorted(n for n in self.folder.names() if _MANIFEST.fullmatch(n))

    def commit(self, manifest: dict) -> None:
        new = manifest | {"version": manifest["version"] + 1}
        self.folder.create_text(f"manifest-{new['version']:012d}.json", json.dumps(new, indent=1, sort_keys=True))
        manifest["version"] = new["version"]
        for old in self._manifests()[:-KEPT]:
            self.folder.delete(old)

    def write(self, space: str, table: str, frame: DataFrame) -> tuple[str, DataFrame]:
        name = f"{space}/{table}/{uuid.uuid4().hex}"
        return name, self.folder.write_frame(name, frame)

    def sweep(self, manifest: dict, spaces: list[str]) -> None:
        """Deletes versions that no manifest entry names."""
        live = {t["folder"] for t in manifest["tables"].values() if t.get("folder")}
        fs = self.folder._fs
        for space in spaces:
            if not self.folder.exists(space):
                continue
            for table in fs.listStatus(self.folder._at(space)):
                for version in fs.listStatus(table.getPath()):
                    p = version.getPath()
                    if f"{space}/{table.getPath().getName()}/{p.getName()}" not in live:
                        fs.delete(p, True)
