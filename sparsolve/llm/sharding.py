"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small parquet shards.  Where a tier (sizes within a factor of `fanout`) has `fanout` shards or more, they are merged,
in order of arrival, into files of about the target size; each merged file is written by one task that reads
its shards one after the other, so nothing is shuffled, and a compaction writes a row once, however many tiers it rises.  A version is a manifest file,
listing its shards; it is committed under an exclusive claim by a rename, so readers see whole versions only.  Writers that come second
take the newer version up and try again.

The claim needs a file system that creates a file for one caller only (HDFS and local ones do; object stores need a committer of their own).

Rows are stored as they are: nulls in any column, empty and very long texts, repeated rows and columns of any name (also _shard and _row) come back
unchanged; an empty table appends no shard.  Shards of equal size keep their order of arrival.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, spare

#: Merged files of one job.
WAVE = 64
#: A claim on a version that led to no manifest for so long is void.
CLAIM_SECONDS = 3600
#: Files that no version lists are taken for another writer's, not committed yet, for so long.
RETENTION_SECONDS = 24 * 3600
#: How often a commit is tried.
TRIES = 20


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    bytes: int
    rows: int


class ShardStore:
    """A folder of shards: `data/` with the files, `manifests/` with a file per committed version."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, arrival_rows: int = 2000, fanout: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.arrival_rows, self.fanout = target_bytes, arrival_rows, fanout
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self, folder: str) -> list[tuple[str, int]]:
        if not self._fs.exists(self._path(folder)):
            return []
        out, it, top = [], self._fs.listFiles(self._path(folder), True), self._fs.makeQualified(self._path("")).toString()
        while it.hasNext():
            f = it.next()
            if f.getPath().getName().endswith(".parquet"):
                out.append((f.getPath().toString().removeprefix(top).lstrip("/"), f.getLen()))
        return sorted(out)

    def version(self) -> int:
        """The newest committed version; 0: none."""
        return max([0, *(int(s.getPath().getName()[1:9]) for s in self._fs.listStatus(self._path("manifests")) if s.getPath().getName().startswith("v"))])

    def manifest(self, version: int | None = None) -> tuple[list[Shard], T.StructType | None]:
        version = self.version() if version is None else version
        if not version:
            return [], None
        got = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream := self._fs.open(self._path(f"manifests/v{version:08d}.json")), "UTF-8"))
        stream.close()
        return [Shard(**s) for s in got["shards"]], T.StructType.fromJson(got["schema"])

    def commit(self, version: int, shards: list[Shard], schema: T.StructType) -> int:
        """Publishes the version, all of it or nothing."""
        tmp, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{version:08d}.json")
        out = self._fs.create(tmp)
        out.write(json.dumps({"shards": [asdict(s) for s in shards], "schema": schema.jsonValue()}).encode())
        out.close()
        # create() without overwriting claims the version where a rename would silently replace a file
        claim = self._path(f"manifests/.claim-{version:08d}")
        if self._fs.exists(claim) and not self._fs.exists(final) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
            self._fs.delete(claim, False)  # its writer is gone
        claimed = self._fs.createNewFile(claim)
        if not claimed or self._fs.exists(final) or not self._fs.rename(tmp, final):
            self._fs.delete(tmp, False)
            if claimed and not self._fs.exists(final):
                self._fs.delete(claim, False)  # the next one may try
            raise CommitConflict(f"version {version} of {self.root} is already there")
        return version

    def _publish(self, change: Callable[[list[Shard], T.StructType | None], tuple[list[Shard], T.StructType]]) -> int:
        """Commits what `change` makes of the newest version; again, if another writer was first."""
        for left in range(TRIES, 0, -1):
            version = self.version()
            try:
                return self.commit(version + 1, *change(*self.manifest(version)))
            except CommitConflict:
                if left == 1:
                    raise
                time.sleep(0.1)
        raise CommitConflict(self.root)

    def _sized(self, folder: str, schema: T.StructType) -> list[Shard]:
        files = self._files(folder)
        if not files:
            return []
        held = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{folder}")
        file = held.metadataColumn("_metadata")["file_name"].alias("f")  # even if the rows have such a column
        rows = {r["f"]: r["n"] for r in held.select(file).groupBy("f").agg(F.count("*").alias("n")).collect()}  # a row per shard, as in the manifest
        return [Shard(p, n, rows.get(p.rpartition("/")[2], 0)) for p, n in files if rows.get(p.rpartition("/")[2])]

    def append(self, rows: DataFrame) -> int:
        """Writes the rows as small shards and commits a version with them."""
        folder = f"data/a-{uuid.uuid4().hex}"

        def add(shards: list[Shard], schema: T.StructType | None) -> tuple[list[Shard], T.StructType]:
            if schema is not None and schema.jsonValue() != rows.schema.jsonValue():
                raise ValueError("arrivals have the columns of the store")
            return [*shards, *new], rows.schema

        new: list[Shard] = []
        add(*self.manifest())  # before anything is written
        try:
            rows.write.option("maxRecordsPerFile", self.arrival_rows).parquet(f"{self.root}/{folder}")
            new = self._sized(folder, rows.schema)
            return self._publish(add)
        except BaseException:
            delete(self.spark, f"{self.root}/{folder}")
            raise

    def tier(self, size: int) -> int:
        tier, limit = 0, max(1, self.target // self.fanout**4)
        while size > limit:
            tier, limit = tier + 1, limit * self.fanout
        return tier

    def groups(self, shards: list[Shard]) -> list[list[Shard]]:
        """What to merge into one file each: tiers of `fanout` shards or more, in runs of about the target size; then, on the sizes
        that this is expected to give, whatever tiers that makes."""
        held = [([s], s.bytes) for s in shards]
        while True:
            tiers = defaultdict(list)
            for k, (_, size) in enumerate(held):
                if 2 * size <= self.target:
                    tiers[self.tier(size)].append(k)
            merged, gone = [], set()
            for own in tiers.values():
                if len(own) < self.fanout:
                    continue
                run, total = [], 0
                for k in [*own, None]:
                    if run and (k is None or total + held[k][1] > self.target):
                        if len(run) > 1:
                            merged.append((run[0], [s for x in run for s in held[x][0]], total))
                            gone.update(run)
                        run, total = [], 0
                    if k is not None:
                        run.append(k)
                        total += held[k][1]
            if not merged:
                return [own for own, _ in held if len(own) > 1]
            at = {first: (own, size) for first, own, size in merged}
            held = [at.get(k, x) for k, x in enumerate(held) if k in at or k not in gone]

    def compact(self) -> int:
        """Merges what `groups` says and commits one version.  Replaced files stay until `vacuum`."""
        shards, schema = self.manifest()
        todo, made = self.groups(shards), []
        if not todo:
            return self.version()
        gone = {s.path for g in todo for s in g}
        folders = []

        def swap(now: list[Shard], schema: T.StructType) -> tuple[list[Shard], T.StructType]:
            if not gone <= {s.path for s in now}:
                raise CommitConflict("another compaction has taken these shards")
            return [s for s in now if s.path not in gone] + made, schema

        try:
            for start in range(0, len(todo), WAVE):
                folders.append(f"data/m-{uuid.uuid4().hex}")
                parts = [self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in g)).coalesce(1) for g in todo[start : start + WAVE]]
                with self._apart():
                    reduce(DataFrame.union, parts).write.parquet(f"{self.root}/{folders[-1]}")
                made += self._sized(folders[-1], schema)
            return self._publish(swap)
        except BaseException:
            for folder in folders:
                delete(self.spark, f"{self.root}/{folder}")
            raise

    @contextmanager
    def _apart(self) -> Iterator[None]:
        """A union of single partitions stays one partition per input, so one task and one file per group."""
        name = "spark.sql.unionOutputPartitioning"
        was = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "false")
        try:
            yield
        finally:
            if was is None:
                self.spark.conf.unset(name)
            else:
                self.spark.conf.set(name, was)

    def vacuum(self, retention: float = RETENTION_SECONDS) -> None:
        """Deletes files that older versions list and the newest doesn't, and those versions' manifests; and files that no version lists, if they are older than
        `retention` seconds: younger ones may be another writer's, who hasn't committed yet."""
        newest = self.version()
        versions = [int(x.getPath().getName()[1:9]) for x in self._fs.listStatus(self._path("manifests")) if x.getPath().getName().startswith("v")]
        old = [v for v in versions if v < newest]
        listed = {s.path for v in old for s in self.manifest(v)[0]}
        kept = {s.path for s in self.manifest(newest)[0]}
        for path, _ in self._files("data"):
            if path in kept or path not in listed and time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000 < retention:
                continue
            self._fs.delete(self._path(path), False)
        for v in old:
            self._fs.delete(self._path(f"manifests/v{v:08d}.json"), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The version's rows, and last the shard and the place in it: _shard and _row, with underscores added if there are such columns."""
        shards, schema = self.manifest(version)
        names = (schema or T.StructType()).names
        shard, row = spare(names, "_shard"), spare(names, "_row")
        if not shards:
            return self.spark.createDataFrame([], T.StructType([*(schema or T.StructType()), T.StructField(shard, T.StringType()), T.StructField(row, T.LongType())]))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in shards))
        hidden = rows.metadataColumn("_metadata")
        return rows.select(*(F.col(f"`{c}`") for c in names), hidden["file_name"].alias(shard), hidden["row_index"].alias(row))
