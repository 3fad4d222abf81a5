"""Size-tiered compaction of immutable shards under a versioned manifest.

An arrival is written as small shards (Parquet files that are never changed) and
becomes visible by a manifest of the next version.  Compaction puts the shards
below half the target into tiers by size; a tier that holds ``fanout`` shards is
one run of similar sizes, which a single job without a shuffle rewrites as files
of about the target.  A version is claimed by creating its claim file, which only
one writer can, and published by renaming a finished file, so readers see the old
or the new state and nothing between.  A claim without a manifest lapses after
``lease_s`` seconds, so a writer that dies between the two holds nobody up for
longer.  Writers mark the folders that they fill until their version is out;
``vacuum`` deletes what no manifest names and no mark within the lease covers.

The manifest holds a line for each shard: some hundred thousand for 100 TB.

Defined results
* rows, nulls, repeated rows and all columns are kept as they are;
* an empty arrival adds no shard; a store without shards reads as an empty table.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, scratch_path

TARGET_BYTES = 128 << 20
#: Shards of one tier that are merged, and the ratio of sizes between tiers.
FANOUT = 4
#: Upper size of the lowest tier.
BASE_BYTES = 256 << 10
#: Seconds after which a claim or a mark of a writer that doesn't finish counts no more.
LEASE_S = 3600.0


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class ShardStore:
    """Shards of one table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, lease_s: float = LEASE_S) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.fanout, self.lease_s = target_bytes, fanout, lease_s
        self.fs, path = filesystem(spark, f"{self.root}/manifest")
        self.fs.mkdirs(path)
        self.fs.mkdirs(self._path("marks"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _listed(self, name: str) -> list[tuple[str, int]]:
        """(file name, bytes) in a folder of the store."""
        if not self.fs.exists(self._path(name)):
            return []
        return [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._path(name))]

    def version(self) -> int:
        """The newest published version; 0 before the first."""
        return max([0, *(int(n[1:-5]) for n, _ in self._listed("manifest") if n.endswith(".json") and n[0] == "v")])

    def manifest(self, version: int | None = None) -> list[dict]:
        """The shards of a version: path within the store, bytes and rows."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._path(f"manifest/v{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [json.loads(line) for line in text.splitlines()]

    def _publish(self, base: int, shards: list[dict]) -> int:
        """Make the shards version base + 1, or raise Conflict if there is one."""
        temporary = self._path(f"manifest/.{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, True)
        stream.write(bytearray("".join(json.dumps(s) + "\n" for s in shards).encode()))
        stream.close()
        if not self._claim(base + 1) or not self.fs.rename(temporary, self._path(f"manifest/v{base + 1}.json")):
            self.fs.delete(temporary, False)
            raise Conflict(f"version {base + 1} is taken")
        return base + 1

    def _claim(self, version: int) -> bool:
        """Whether this writer may publish the version; a lapsed claim is moved away, which only one writer can."""
        claim = self._path(f"manifest/v{version}.claim")
        if self.fs.exists(self._path(f"manifest/v{version}.json")):
            return False
        if self.fs.createNewFile(claim):
            return True
        lapsed = self._lapsed(claim) and not self.fs.exists(self._path(f"manifest/v{version}.json"))
        return bool(lapsed and self.fs.rename(claim, self._path(f"manifest/.lapsed-{uuid.uuid4().hex}")) and self.fs.createNewFile(claim))

    def _lapsed(self, path) -> bool:
        return time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000 > self.lease_s

    def _write(self, df: DataFrame) -> list[dict]:
        """Write a table as shards, a file for each partition with rows."""
        folder = f"shards-{uuid.uuid4().hex}"
        self.fs.createNewFile(self._path(f"marks/{folder}"))
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        files = {f"{folder}/{n}": size for n, size in self._listed(folder) if n.endswith(".parquet")}
        if not files:
            self.fs.delete(self._path(f"marks/{folder}"), False)
            return []
        names = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{p}" for p in files]).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("n"))
        rows = {r["n"]: r["rows"] for r in names.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect()}
        return [{"path": p, "bytes": size, "rows": rows[p.split("/")[1]]} for p, size in sorted(files.items()) if rows.get(p.split("/")[1])]

    def append(self, df: DataFrame) -> int:
        """Add an arrival; returns the new version."""
        base = self.version()
        return self._add(base, self.manifest(base), self._write(df.select(*self.schema.names)))

    def _add(self, base: int, shards: list[dict], written: list[dict]) -> int:
        """Publish shards and those just written; if that fails the marks of the latter go, so that vacuum may take them."""
        try:
            return self._publish(base, shards + written)
        finally:
            for folder in {s["path"].split("/")[0] for s in written}:
                self.fs.delete(self._path(f"marks/{folder}"), False)

    def tier(self, size: int) -> int:
        return 0 if size <= BASE_BYTES else 1 + int(math.log(size / BASE_BYTES, self.fanout))

    def runs(self, shards: list[dict], everything: bool = False) -> list[list[dict]]:
        """Runs of similar sizes that are to be merged; with ``everything``, what is left below half the target too."""
        small = [s for s in shards if s["bytes"] < self.target / 2]
        tiers: dict[int, list[dict]] = {}
        for s in small:
            tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        full = [run for _, run in sorted(tiers.items()) if len(run) >= self.fanout]
        return full or ([small] if everything and len(small) > 1 else [])

    def compact(self, everything: bool = False) -> int:
        """Merge runs until no tier is full; each round is a version of its own.  Returns the newest version."""
        base = self.version()
        while True:
            shards = self.manifest(base)
            runs = self.runs(shards, everything)
            if not runs:
                return base
            merged = []
            for run in runs:
                files = max(1, min(len(run) - 1, round(sum(s["bytes"] for s in run) / self.target)))
                merged += self._write(self.read(run).coalesce(files))
            gone = {s["path"] for run in runs for s in run}
            base = self._add(base, [s for s in shards if s["path"] not in gone], merged)

    def read(self, shards: list[dict] | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        shards = self.manifest() if shards is None else shards
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{s['path']}" for s in shards])

    def _mark_lapsed(self, name: str) -> bool:
        try:
            return self._lapsed(self._path(f"marks/{name}"))
        except Py4JJavaError:  # published and unmarked meanwhile
            return False

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards that none of the newest ``keep`` versions names; returns how many.

        Folders are listed before marks and marks before manifests: a folder whose
        mark is gone by then has been published, so a manifest names it.
        """
        folders = [n for n, _ in self._listed("") if n.startswith("shards-")]
        marked = {n for n, _ in self._listed("marks")}
        lapsed = {n for n in marked if self._mark_lapsed(n)}
        newest = self.version()
        named = {s["path"] for v in range(max(1, newest - keep + 1), newest + 1) for s in self.manifest(v)}
        gone = 0
        for n in lapsed:
            self.fs.delete(self._path(f"marks/{n}"), False)
        for folder in folders:
            if folder not in marked - lapsed:
                files = [n for n, _ in self._listed(folder) if n.endswith(".parquet")]
                dead = [n for n in files if f"{folder}/{n}" not in named]
                if len(dead) == len(files):
                    self.fs.delete(self._path(folder), True)
                else:
                    for n in dead:
                        self.fs.delete(self._path(f"{folder}/{n}"), False)
                gone += len(dead)
        return gone


def assignments(store: ShardStore) -> DataFrame:
    """Each row's doc_id with its shard's number in the manifest, rows and bytes, and the version."""
    shards = store.manifest()
    if not shards:
        return store.read().select("doc_id", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("shard_rows"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(store.version()).alias("version"))
    table = store.spark.createDataFrame([(s["path"].split("/")[1], k, s["rows"], s["bytes"]) for k, s in enumerate(shards)], "__name string, shard int, shard_rows long, shard_bytes long")
    rows = store.read(shards).select("doc_id", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("__name"))
    side = F.broadcast(table) if len(shards) <= 100_000 else table
    return rows.join(side, "__name").select("doc_id", "shard", "shard_rows", "shard_bytes", F.lit(store.version()).alias("version"))


def report(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The query's rows: the documents arrive in three parts, are compacted after each, and are read from the last version."""
    spark = docs.sparkSession
    store = ShardStore(spark, scratch_path(spark, "shards"), docs.schema, target_bytes)
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    for which in (arrival < 2, arrival == 2, arrival == 3):
        store.append(docs.where(which))
        store.compact()
        store.vacuum()
    store.compact(everything=True)
    store.vacuum()
    return assignments(store)
