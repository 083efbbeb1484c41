"""Sharding by size-tiered compaction.

A store is a folder with immutable Parquet shards and numbered manifests.
Arrivals are appended as small shards.  Shards of similar size form a tier
(tier = whole part of log_FANOUT(size / smallest)); when a tier holds
``FANOUT`` shards or more, they are read together and written as shards of the
target size, without a shuffle (``coalesce`` packs whole input splits).  One
job merges all due shards of a tier, so a store of any size needs a job for
each tier, of which there are log(target / smallest).  Shards of at least half
the target size are final.

Manifests are a log: version n tells which shards it adds and removes, and
every ``FULL``-th version lists all, so a commit costs what it changes and a
reader opens at most ``FULL`` files.  A commit is exclusive: on a local file
system the manifest is linked to its name (a link fails if the name exists), on
HDFS renamed to it (a rename to an existing file is refused), on other stores
created without overwriting.  A writer that is second plans its change again on
the newer version.  Readers take the newest manifest, or an older version, and
see only its shards.

Replaced shards are deleted by ``vacuum`` alone, which a writer calls when no
reader holds an older version.  It spares what writers are about to commit:
each writer names its folder in ``intents`` before it writes there and takes
the name away after its commit; names older than ``GRACE`` seconds count as
left by writers that died.

Edge cases: an empty arrival commits a version without new shards; an empty
store reads as an empty table of the store's schema; nulls, repeated rows and
any further columns, whatever their names, are stored as they are; a very long
text stays one row, so a shard may exceed the target by a row; shards of equal
size are merged in the order of the manifest.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wirefold.llm.common import Scratch, bounded, text_session

FANOUT = 4
SMALLEST = 64 << 10
TARGET = 128 << 20
#: Every so many versions a manifest lists all shards.
FULL = 16
#: Seconds after which a writer that has not committed counts as dead.
GRACE = 24 * 3600


class Conflict(Exception):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    rows: int


class Store:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, target: int = TARGET, smallest: int = SMALLEST, fanout: int = FANOUT):
        self.spark, self.root, self.schema = text_session(spark), root.rstrip("/"), schema
        self.target, self.smallest, self.fanout = target, smallest, fanout
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # --- manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        source = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        if version == 0:
            return []
        # back to the last full list, then forward over the changes
        log = [self._manifest(version)]
        while "all" not in log[-1]:
            log.append(self._manifest(log[-1]["version"] - 1))
        held = {s["path"]: Shard(**s) for s in log[-1]["all"]}
        for change in log[-2::-1]:
            for p in change["removed"]:
                held.pop(p)
            held |= {s["path"]: Shard(**s) for s in change["added"]}
        return list(held.values())

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Make ``shards`` version base + 1, or raise Conflict if that exists."""
        version = base + 1
        if base % FULL == 0:
            body = {"version": version, "all": [asdict(s) for s in shards]}
        else:
            before, now = {s.path for s in self.shards(base)}, {s.path for s in shards}
            body = {"version": version, "added": [asdict(s) for s in shards if s.path not in before], "removed": sorted(before - now)}
        raw = bytearray(json.dumps(body).encode())
        place = self._path(f"{self.root}/manifests/v{version:08d}.json")
        if not self._create(place, raw):
            raise Conflict(f"version {version} exists")
        return version

    def _create(self, place, raw: bytearray) -> bool:
        """Make a file with this content, unless one of the name exists."""
        scheme = self._fs.getUri().getScheme()
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}") if scheme in ("file", "hdfs", "viewfs") else place
        try:
            out = self._fs.create(aside, False)
            try:
                out.write(raw)
            finally:
                out.close()
            if scheme == "file":
                paths = self._jvm.java.nio.file.Paths
                local = lambda p: paths.get(self._jvm.java.io.File(p.toUri().getPath()).toURI())
                self._jvm.java.nio.file.Files.createLink(local(place), local(aside))
            elif aside is not place and not self._fs.rename(aside, place):
                return False
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            if aside is not place:
                self._fs.delete(aside, False)

    def _change(self, plan) -> int:
        """Commit plan(newest shards); plan again if another writer was first."""
        while True:
            found = self.versions()
            base = found[-1] if found else 0
            try:
                return self.commit(base, plan(self.shards(base)))
            except Conflict:
                continue

    # --- data

    def _write(self, df: DataFrame) -> tuple[str, list[Shard]]:
        """Announce a folder, write a frame there as shards, and count them; the folder's name and the shards."""
        name = uuid.uuid4().hex
        folder = f"{self.root}/data/{name}"
        self._fs.create(self._path(f"{self.root}/intents/{name}"), False).close()
        bounded(df).write.option("compression", "zstd").parquet(folder)
        rows = self.spark.read.schema(self.schema).parquet(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        counted = {r[0]: r[1] for r in rows.collect()}
        found = [(s.getPath(), s.getLen()) for s in self._fs.listStatus(self._path(folder))]
        return name, sorted((Shard(str(p), size, counted[p.getName()]) for p, size in found if p.getName() in counted), key=lambda s: s.path)

    def _settled(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/intents/{name}"), False)

    def append(self, df: DataFrame) -> int:
        name, new = self._write(df.select([F.col(f"`{c}`") for c in self.schema.names]))
        version = self._change(lambda shards: [*shards, *new])
        self._settled(name)
        return version

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.smallest, self.fanout))) if size > self.smallest else 0

    def due(self, shards: list[Shard]) -> dict[int, list[Shard]]:
        """Tiers that are to be merged."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.size < self.target:
                tiers.setdefault(self.tier(s.size), []).append(s)
        return {t: run for t, run in tiers.items() if len(run) >= self.fanout}

    def compact(self, vacuum: bool = False) -> int:
        """Merge due tiers, the smallest first, until none is due; the newest version."""
        while due := self.due(self.shards()):
            run = due[min(due)]
            # a tier's shards become shards of the target size, or one shard of a higher tier
            total = sum(s.size for s in run)
            name, merged = self._write(self.spark.read.schema(self.schema).parquet(*[s.path for s in run]).coalesce(max(1, math.ceil(total / self.target))))
            if sum(s.rows for s in merged) != sum(s.rows for s in run):
                raise RuntimeError("a merge lost rows")
            gone = {s.path for s in run}

            def plan(shards, gone=gone, merged=merged):
                if not gone <= {s.path for s in shards}:
                    return shards  # another writer has merged some of them; its result stands
                return [*(s for s in shards if s.path not in gone), *merged]

            self._change(plan)
            self._settled(name)
            if vacuum:
                self.vacuum()
        found = self.versions()
        return found[-1] if found else 0

    def vacuum(self, grace: float = GRACE) -> None:
        """Delete data folders that neither the newest manifest nor a living writer names."""
        listed = lambda name: list(self._fs.listStatus(self._path(f"{self.root}/{name}"))) if self._fs.exists(self._path(f"{self.root}/{name}")) else []
        # in this order: a folder whose intent is gone by the second step is in the manifest by the third, if it is to stay
        folders = [s.getPath() for s in listed("data")]
        oldest = (time.time() - grace) * 1000
        intents = [(s.getPath(), s.getModificationTime()) for s in listed("intents")]
        spared = {p.getName() for p, at in intents if at >= oldest}
        spared |= {s.path.rstrip("/").split("/")[-2] for s in self.shards()}
        for f in folders:
            if f.getName() not in spared:
                self._fs.delete(f, True)
        for p, at in intents:
            if at < oldest:
                self._fs.delete(p, False)

    def read(self, version: int | None = None) -> DataFrame:
        shards = self.shards(version)
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[s.path for s in shards])


ARRIVALS = 4


def op6(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """Append the documents in ARRIVALS parts, compact after each, and read the newest version back."""
    spark = docs.sparkSession
    store = Store(spark, Scratch(spark, "shards").path("store"), docs.schema, target)
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        store.compact(vacuum=True)
    text = F.coalesce(F.col("text"), F.lit(""))
    return store.read().select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), "lang", "source", "n_chars")


OP6_SQL = """
SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, lang, source, n_chars
FROM documents
"""
