"""Size-tiered compaction of immutable shards under a versioned manifest.

An arrival is appended as a run of small files. Runs of similar size stand in one tier, the logarithm
of their bytes to the base ``fan``; when a tier has ``fan`` runs they are merged into one run of files
of about ``target`` bytes. Every change writes a new manifest under a temporary name and renames it to
the next version, which fails if that version exists: readers see the old or the new set of files,
never a part of either, and of two writers one repeats its commit. Data pass through DataFrame scans
and writes alone; files are listed, renamed and deleted by the file system's own interface.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFESTS, DATA = "_manifests", "data"


@dataclass(frozen=True)
class Run:
    """Files written together."""

    path: str
    files: tuple[tuple[str, int], ...]  # name, bytes

    @property
    def size(self) -> int:
        return sum(n for _, n in self.files)

    def paths(self) -> list[str]:
        return [f"{self.path}/{name}" for name, _ in self.files]


class CommitConflict(RuntimeError):
    """Another writer has merged or removed a run that this commit builds on."""


class ShardStore:
    """A table of shards under ``root``, on any file system that Spark's executors share."""

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, fan: int = 4, codec: str = "zstd"):
        self.spark, self.root, self.target, self.fan, self.codec = spark, root.rstrip("/"), target, fan, codec
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._fs.mkdirs(self._path(f"{self.root}/{MANIFESTS}"))

    # manifests

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        found = self._fs.listStatus(self._path(f"{self.root}/{MANIFESTS}"))
        names = [x.getPath().getName() for x in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, str | None, list[Run]]:
        """(version, schema as JSON, runs) of the latest or a given version; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, None, []
        stream = self._fs.open(self._path(self._file(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        body = json.loads(text)
        return version, body["schema"], [Run(r["path"], tuple((n, b) for n, b in r["files"])) for r in body["runs"]]

    def _file(self, version: int) -> str:
        return f"{self.root}/{MANIFESTS}/v{version:010d}.json"

    def commit(self, added: list[Run], removed: list[Run] = [], schema: str | None = None, tries: int = 20) -> int:  # noqa: B006
        """Add and remove runs at once; returns the new version. Raises CommitConflict if a removed run is gone."""
        for _ in range(tries):
            version, known, runs = self.manifest()
            gone = {r.path for r in removed}
            if gone - {r.path for r in runs}:
                raise CommitConflict("a run of this commit has been merged by another writer")
            kept = [r for r in runs if r.path not in gone] + added
            body = json.dumps({"schema": known or schema, "runs": [{"path": r.path, "files": r.files} for r in kept]})
            draft = self._path(f"{self.root}/{MANIFESTS}/.draft-{uuid.uuid4().hex}")
            stream = self._fs.create(draft, False)
            stream.write(bytearray(body.encode()))
            stream.close()
            try:
                self._context.rename(draft, self._path(self._file(version + 1)), self._options())
                return version + 1
            except Exception as e:  # the version exists: look again
                self._fs.delete(draft, False)
                if version + 1 not in self.versions():
                    raise e
        raise CommitConflict("the manifest changed at every try")

    def _options(self):
        kind = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        kind[0] = self._rename.NONE
        return kind

    # data

    def _write(self, df: DataFrame) -> Run:
        path = f"{self.root}/{DATA}/{uuid.uuid4().hex}"
        df.write.option("compression", self.codec).parquet(path)
        files = [(x.getPath().getName(), x.getLen()) for x in self._fs.listStatus(self._path(path))]
        return Run(path, tuple(sorted((n, b) for n, b in files if n.endswith(".parquet"))))

    def append(self, df: DataFrame) -> int:
        """Write an arrival as one run and commit it. An empty arrival commits a run without rows.

        Any columns, nulls and repeated rows are kept as they are. The first arrival fixes the schema.
        """
        return self._committed(self._write(df), schema=df.schema.json())

    def _committed(self, run: Run, removed: list[Run] = [], schema: str | None = None) -> int:  # noqa: B006
        """Commit a run of our own; if that fails its files go, as no manifest will ever name them."""
        try:
            return self.commit([run], removed, schema)
        except Exception:
            self._fs.delete(self._path(run.path), True)
            raise

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, as committed, whatever else lies in the folder: all columns, nulls and repeats. A store without commits has no schema to read: ValueError."""
        _, schema, runs = self.manifest(version)
        if schema is None:
            raise ValueError("nothing has been appended")
        return self._rows(runs, schema)

    def _rows(self, runs: list[Run], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        paths = [p for r in runs for p in r.paths()]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def tier(self, run: Run) -> int:
        return int(math.log(max(1, run.size), self.fan) + 1e-9)

    def due(self) -> list[list[Run]]:
        """Groups of similarly sized runs to merge: of each tier that has ``fan`` runs, all, but for runs of a single full file."""
        tiers: dict[int, list[Run]] = {}
        for run in self.manifest()[2]:
            if len(run.files) > 1 or run.size < self.target:
                tiers.setdefault(self.tier(run), []).append(run)
        return [runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fan]

    def merge(self, runs: list[Run]) -> int:
        """Merge runs into one of target-sized files. No shuffle: scan tasks are joined into as many writers as there are files."""
        _, schema, _ = self.manifest()
        files = max(1, round(sum(r.size for r in runs) / self.target))
        return self._committed(self._write(self._rows(runs, schema).coalesce(files)), runs)

    def compact(self, keep: int | None = None) -> int:
        """Merge until no tier is due; returns the number of merges. ``keep``: vacuum after each, keeping so many versions."""
        merges = 0
        while groups := self.due():
            for runs in groups:
                try:
                    self.merge(runs)
                except CommitConflict:
                    continue  # another writer was first: its manifest is read next
                merges += 1
                if keep:
                    self.vacuum(keep)
        return merges

    def sweep(self, older: float = 86_400.0) -> int:
        """Delete runs that no manifest names and whose folder has not changed for so many seconds; returns their number.

        They are what writers that died have left; ``older`` must exceed the time that a write takes.
        """
        folder = self._path(f"{self.root}/{DATA}")
        if not self._fs.exists(folder):
            return 0
        found = [(f"{self.root}/{DATA}/{x.getPath().getName()}", x.getModificationTime() / 1000) for x in self._fs.listStatus(folder)]
        named = {r.path for v in self.versions() for r in self.manifest(v)[2]}  # after the listing: a run committed since is named
        dead = [path for path, changed in found if path not in named and changed <= time.time() - older]
        for path in dead:
            self._fs.delete(self._path(path), True)
        return len(dead)

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests before the latest ``keep``, and runs that only those name; returns the runs deleted.

        Runs that no manifest has named yet belong to writers at work and stay; see ``sweep``.
        """
        versions = self.versions()
        old, new = versions[:-keep], versions[-keep:]
        live = {r.path for v in new for r in self.manifest(v)[2]}
        dead = {r.path for v in old for r in self.manifest(v)[2]} - live
        for path in dead:
            self._fs.delete(self._path(path), True)
        for v in old:
            self._fs.delete(self._path(self._file(v)), False)
        return len(dead)
