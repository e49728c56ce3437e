"""The index as Parquet tables of versions, with a manifest that says which of them are current."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

INDEX_DIR = ".weftgraph"
TABLES = ("files", "nodes", "edges", "derived", "refs", "embeddings", "postings")


class Store:
    """Writers make new tables and then move the manifest, so readers see all of a change or none; a failed write leaves the old state.

    Everything goes through Hadoop's file systems, so ``location`` may be on any of them
    (by default a folder in the project). The manifest names a folder for each table: tables
    that a commit does not touch stay where they are. Folders that neither the current nor
    the previous manifest names are deleted; the previous ones are for readers that still
    hold them.
    """

    def __init__(self, spark: SparkSession, root: str, location: str | None = None):
        self.spark = spark
        self.dir = (location or f"{root}/{INDEX_DIR}").rstrip("/")
        if not re.match(r"[a-z][a-z0-9+.-]*:/", self.dir):
            self.dir = "file://" + self.dir
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.dir}/{name}" if name else self.dir)

    @property
    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, name: str = "CURRENT") -> dict | None:
        fs, path = self._fs, self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, manifest: dict) -> None:
        """Writes a manifest beside its place and renames it, which replaces the old one at once."""
        out = self._fs.create(self._path(f"{name}.next"), True)
        out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        out.close()
        rename = self._hadoop.Options.Rename
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(f"{name}.next"), self._path(name), options)

    def version(self) -> int | None:
        manifest = self._manifest()
        return manifest and manifest["version"]

    def committed(self, batch: int | None, stream: str = "") -> bool:
        """Whether a batch of a stream (named by its checkpoint) has been committed already."""
        return batch is not None and (self._manifest() or {"batches": {}})["batches"].get(stream, -1) >= batch

    def read(self, table: str) -> DataFrame:
        manifest = self._manifest()
        if manifest is None:
            raise FileNotFoundError(f"no index in {self.dir}; build one first")
        return self.spark.read.parquet(f"{self.dir}/{manifest['tables'][table]}")

    def has(self, table: str) -> bool:
        return table in (self._manifest() or {"tables": {}})["tables"]

    def commit(self, tables: dict[str, DataFrame], batch: int | None = None, stream: str = "") -> int:
        """A new version with these tables and the others as they were. A batch that was committed already changes nothing."""
        before = self._manifest()
        if self.committed(batch, stream):
            return before["version"]
        after = (before["version"] if before else 0) + 1
        folder = self._path(f"v{after}")
        self._fs.delete(folder, True)  # of a writer that did not finish
        try:
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{self.dir}/v{after}/{name}")
        except BaseException:
            self._fs.delete(folder, True)
            raise
        places = (before["tables"] if before else {}) | {name: f"v{after}/{name}" for name in tables}
        if before:
            self._put("PREVIOUS", before)
        batches = (before["batches"] if before else {}) | ({stream: batch} if batch is not None else {})
        self._put("CURRENT", {"version": after, "batches": batches, "tables": places})
        self._clean({*places.values(), *(before["tables"] if before else {}).values()})
        return after

    def _clean(self, used: set[str]) -> None:
        fs = self._fs
        for version in fs.listStatus(self._path("")):
            top = version.getPath().getName()
            if version.isDirectory() and re.fullmatch(r"v\d+", top):
                inner = [x.getPath().getName() for x in fs.listStatus(version.getPath())]
                for name in inner:
                    if f"{top}/{name}" not in used:
                        fs.delete(self._path(f"{top}/{name}"), True)
                if not any(f"{top}/{name}" in used for name in inner):
                    fs.delete(version.getPath(), True)

    def transaction(self, work: Callable[[], dict[str, DataFrame]]) -> int:
        return self.commit(work())

    def remove(self) -> bool:
        return bool(self._fs.delete(self._path(""), True))
