"""Sets of tables with versions: data first, then a manifest that makes them visible together."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def create(self, name: str, text: str) -> bool:
        """Write a small file that must not exist yet; False if it does."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:  # noqa: BLE001  # whatever the store says, the question is whether the file is there
            if self._fs.exists(self._at(name)):
                return False
            raise e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def text(self, name: str) -> str:
        source = self._fs.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode("utf-8", "replace")
        finally:
            source.close()


class Versions:
    """Versions of a set of tables below ``path``.

    Each attempt writes to folders of its own. A version exists from the moment its manifest does, which is one
    small file created by one writer; readers see all tables of a version or none. A run that fails deletes what it
    wrote and leaves the versions before it as they were; if the driver dies before it can, ``vacuum`` does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def manifests(self) -> list[dict[str, Any]]:
        """Manifests, oldest first. One cut off in the middle of its writing is none."""
        found = []
        for name in self.folder.names("_manifests"):
            if name.startswith("v"):
                try:
                    found.append(json.loads(self.folder.text(f"_manifests/{name}")))
                except json.JSONDecodeError:
                    continue
        return found

    def commit(self, frames: dict[str, DataFrame], **facts: Any) -> int:
        """Write a version and return its number; ``facts`` go into the manifest."""
        attempt = f"data/{uuid.uuid4().hex}"
        try:
            for name, df in frames.items():
                df.write.parquet(f"{self.path}/{attempt}/{name}")
        except BaseException:
            self.folder.delete(attempt)
            raise
        tables = {n: {"folder": f"{attempt}/{n}", "schema": df.schema.json()} for n, df in frames.items()}
        taken = [int(n[1:].split(".")[0]) for n in self.folder.names("_manifests") if n.startswith("v")]
        version = max(taken, default=0) + 1
        while not self.folder.create(f"_manifests/v{version:012d}.json", json.dumps({"version": version, "tables": tables, **facts})):
            version += 1
        return version

    def latest(self, **facts: Any) -> dict[str, Any] | None:
        """Newest manifest with these facts."""
        fits = [m for m in self.manifests() if all(m.get(k) == v for k, v in facts.items())]
        return fits[-1] if fits else None

    def read(self, name: str, **facts: Any) -> DataFrame:
        """A table of the newest version, or of the newest with these facts."""
        manifest = self.latest(**facts)
        if manifest is None or name not in manifest["tables"]:
            raise ValueError(f"{self.path} has no version of {name} with {facts}")
        return self.open(manifest, name)

    def open(self, manifest: dict[str, Any], name: str) -> DataFrame:
        entry = manifest["tables"][name]
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{entry['folder']}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions and what belongs to none. Not while another writer is at work."""
        manifests = self.manifests()
        for m in manifests[:-keep]:
            self.folder.delete(f"_manifests/v{m['version']:012d}.json")
        held = {t["folder"].split("/")[1] for m in manifests[-keep:] for t in m["tables"].values()}
        for name in self.folder.names("data"):
            if name not in held:
                self.folder.delete(f"data/{name}")
