"""Sharding: arrivals append small immutable shards, runs of similar size are merged, a versioned manifest is committed.

A store is a folder: data/ holds Parquet files that never change, manifests/<version>.json lists the live shards. A manifest
is written whole under another name and then takes its own, which only one writer can: on a local disk by a link, elsewhere
by a rename, which has to fail where the name is taken, as HDFS does. Object stores without such a rename need a lock.
"""

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a file that merging aims at, the ratio between tiers, and how many runs of a tier are merged at once.
TARGET_BYTES = 128 << 20
GROWTH, FAN_IN = 4, 4
#: Shards smaller than this are of the lowest tier.
LEAST_BYTES = 1 << 20
#: A file of at least this part of the target isn't merged again. Small shards arrive at about the target divided by
#: ARRIVAL_PART, if Parquet makes a byte of PACKED bytes of values; their real sizes decide what is merged.
FULL, ARRIVAL_PART, PACKED = 0.75, 8, 3
#: Seconds that files which no manifest lists are left alone: a writer may be about to commit them.
GRACE = 86_400.0


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    """name: its file or folder below data/."""

    name: str
    rows: int
    bytes: int
    files: int
    merged: int


def tier(size: int, least: int = LEAST_BYTES) -> int:
    """0 below least, then one more for each factor of GROWTH."""
    t = 0
    while size >= least:
        size, t = size // GROWTH, t + 1
    return t


class Store:
    def __init__(self, spark: SparkSession, base: str, target: int = TARGET_BYTES, least: int = LEAST_BYTES):
        self.spark, self.base, self.target, self.least = spark, base.rstrip("/"), target, least
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("data", "manifests"):
            self.fs.mkdirs(self.path(f"{self.base}/{part}"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.base}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int:
        """The latest committed version; 0 is the empty store."""
        return max(self.versions(), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self.fs.open(self.path(f"{self.base}/manifests/{version:012d}.json"))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(raw)["shards"]]

    def commit(self, after: int, shards: list[Shard]) -> int:
        """Writes the version behind `after`; a Conflict if another writer has done so."""
        version = after + 1
        name = self.path(f"{self.base}/manifests/{version:012d}.json")
        draft = self.path(f"{self.base}/manifests/.{version:012d}-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        stream.close()
        try:
            taken = not self._claim(draft, name)
        finally:
            self.fs.delete(draft, False)
        if taken:
            raise Conflict(str(name))
        return version

    def _claim(self, draft, name) -> bool:
        if self.fs.getScheme() == "file":
            local = lambda p: self.spark._jvm.java.nio.file.Paths.get(self.fs.makeQualified(p).toUri())
            try:
                self.spark._jvm.java.nio.file.Files.createLink(local(name), local(draft))
            except Py4JJavaError as e:
                if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                    raise
                return False
            return True
        return not self.fs.exists(name) and self.fs.rename(draft, name)

    def _write(self, df: DataFrame, merged: int) -> Shard:
        name = uuid.uuid4().hex
        at = f"{self.base}/data/{name}"
        df.write.option("compression", "zstd").parquet(at)
        files = self._files(name)
        return Shard(name, sum(self._rows(name, df).values()), sum(files.values()), len(files), merged)

    def _files(self, name: str) -> dict[str, int]:
        found = ((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self.path(f"{self.base}/data/{name}")))
        return {file: size for file, size in found if file.endswith(".parquet")}

    def _rows(self, name: str, like: DataFrame) -> dict[str, int]:
        rows = self.spark.read.schema(like.schema).parquet(f"{self.base}/data/{name}")
        return {r["file"]: r["count"] for r in rows.groupBy(F.col("_metadata.file_name").alias("file")).count().collect()}

    def change(self, live: Callable[[list[Shard]], list[Shard] | None]) -> int:
        """Commits what `live` makes of the latest version's shards; where another writer has been faster, of that writer's
        version. None changes nothing."""
        while True:
            at = self.version()
            shards = live(self.shards(at))
            if shards is None:
                return at
            try:
                return self.commit(at, shards)
            except Conflict:
                continue

    def append(self, df: DataFrame) -> int:
        """One new shard with the rows of df."""
        shard = self._write(df, 0)
        return self.change(lambda live: [*live, shard])

    def draft(self, df: DataFrame, rows: int) -> list[Shard]:
        """The rows of df, written once as shards of one file and at most so many rows each. No version lists them yet."""
        name = f"{uuid.uuid4().hex}-each"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(f"{self.base}/data/{name}")
        counts = self._rows(name, df)
        return [Shard(f"{name}/{file}", counts.get(file, 0), size, 1, 0) for file, size in sorted(self._files(name).items())]

    def deliver(self, shards: list[Shard]) -> int:
        """A version with these drafted shards, too."""
        return self.change(lambda live: [*live, *shards])

    def due(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: FAN_IN or more of a tier, oldest first, cut so that a run doesn't pass the target by much. A shard is
        judged by the size of its files: those near the target stay as they are, many small ones in one shard are a run."""
        by_tier: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < FULL * self.target * s.files:
                by_tier.setdefault(tier(s.bytes // s.files, self.least), []).append(s)
        runs = []
        for own in by_tier.values():
            run: list[Shard] = []
            for s in own:
                run.append(s)
                full = sum(x.bytes for x in run) >= self.target and sum(x.files for x in run) >= FAN_IN
                if full or (len(run) >= FAN_IN and s is own[-1]):
                    runs.append(run)
                    run = []
        return runs

    def compact(self) -> int:
        """Merges until no tier has FAN_IN shards. Each merge reads its run once and writes files of about the target size;
        runs that are due together are merged side by side and committed as one version. Merged shards stay on disk for
        readers of older versions until vacuum(). Others may append and compact at the same time, see replace()."""
        width = self.spark.sparkContext.defaultParallelism
        while runs := self.due(self.shards()):
            for i in range(0, len(runs), width):
                wave = runs[i : i + width]
                with ThreadPoolExecutor(len(wave)) as pool:
                    made = list(pool.map(self._merge, wave))
                self.replace(wave, made)
        return self.version()

    def replace(self, runs: list[list[Shard]], made: list[Shard]) -> int:
        """A version with each merged shard in place of its run. A run of which a shard isn't live any more has been merged by
        another writer, whose copy has the rows: ours is dropped and its data deleted, so no row is there twice."""
        kept: list[Shard] = []

        def live(shards: list[Shard]) -> list[Shard] | None:
            names = {s.name for s in shards}
            held = [(run, new) for run, new in zip(runs, made, strict=True) if names.issuperset(s.name for s in run)]
            kept[:] = [new for _, new in held]
            gone = {s.name for run, _ in held for s in run}
            return [*(s for s in shards if s.name not in gone), *kept] if held else None

        version = self.change(live)
        for new in made:
            if new not in kept:
                self.fs.delete(self.path(f"{self.base}/data/{new.name}"), True)
        return version

    def _merge(self, run: list[Shard]) -> Shard:
        files = max(1, round(sum(s.bytes for s in run) / self.target))
        made = self._write(self._read(run).coalesce(files), 1 + max(s.merged for s in run))
        if made.rows != sum(s.rows for s in run):
            raise RuntimeError(f"merged {made.rows} rows of {sum(s.rows for s in run)}")
        return made

    def _read(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.base}/data/{s.name}" for s in shards))

    def read(self, version: int | None = None, name: str = "shard") -> DataFrame:
        """The rows of a version, with the shard that each is in as a column of that name, behind the table's own."""
        shards = self.shards(version)
        if not shards:
            raise ValueError("the store is empty")
        return self._read(shards).select("*", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32}(?:-each/[^/]+)?)", 1).alias(name))

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Removes the data of shards that an older version lists and none of the last `keep` versions does, and what no version
        lists and is older than grace seconds; how many. A writer's files are safe until it commits them or the grace is over."""
        versions = self.versions()
        listed = {v: {s.name for s in self.shards(v)} for v in versions}
        live = set().union(*(listed[v] for v in versions[-keep:]))
        known = set().union(*listed.values())
        oldest, gone = (time.time() - grace) * 1000, 0
        for folder in self.fs.listStatus(self.path(f"{self.base}/data")):
            name = folder.getPath().getName()
            if name in live:
                continue
            files = [s for s in self.fs.listStatus(folder.getPath()) if s.getPath().getName().endswith(".parquet")]
            places = {f"{name}/{s.getPath().getName()}": s for s in files}
            dead = [s for x, s in places.items() if x not in live and (x in known or s.getModificationTime() < oldest)]
            if name in known or (len(dead) == len(files) and (files or folder.getModificationTime() < oldest)):
                self.fs.delete(folder.getPath(), True)
                gone += max(1, len(dead)) if name not in known else 1
            else:
                for s in dead:
                    self.fs.delete(s.getPath(), False)
                gone += len(dead)
        for v in versions[:-keep]:
            self.fs.delete(self.path(f"{self.base}/manifests/{v:012d}.json"), False)
        return gone


def value_bytes(df: DataFrame) -> Column:
    """About how many bytes a row's values take: of strings their length, of arrays 8 for each element, else 8."""
    size = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        size = size + F.coalesce(F.octet_length(c) if kind in ("string", "binary") else F.greatest(F.size(c), F.lit(0)) * 8 if kind in ("array", "map") else F.lit(8), F.lit(0))
    return size


def shard_table(df: DataFrame, base: str, arrivals: int, target: int = TARGET_BYTES, least: int = LEAST_BYTES, keep: int | None = None) -> Store:
    """A new store to which the rows of df are delivered in so many arrivals, each of them as small shards and compacted.

    The rows of any frame are written once, as shards of about the target divided by ARRIVAL_PART or less, so that each
    arrival has one; their number grows with the table, not their size. All columns are stored as they are, nulls and
    repeated rows too; a table without rows gives shards without rows. keep: versions whose shards outlive later arrivals;
    all, if None.
    """
    store = Store(df.sparkSession, base, target, least)
    n, size = df.agg(F.count("*"), F.sum(value_bytes(df).cast("long"))).first()
    rows = max(1, min(n * target * PACKED // (ARRIVAL_PART * max(1, size or 1)), -(-n // arrivals)))
    shards = store.draft(df, rows)
    for i in range(min(arrivals, len(shards))):
        store.deliver(shards[i::arrivals])
        store.compact()
        if keep is not None:
            store.vacuum(keep)
    return store


def placement(store: Store, id_col: str = "doc_id") -> DataFrame:
    """(id_col, shard, tier, shard_rows, version): where each row of the latest version is; shard is its place in the manifest.
    The table may have columns of these names, too; they aren't read."""
    version = store.version()
    shards, own = store.shards(version), "_shard_name"
    # One row per shard of about the target size: Spark broadcasts them where they are few.
    listed = [(s.name, i, tier(s.bytes, store.least), s.rows, version) for i, s in enumerate(shards)]
    listed = store.spark.createDataFrame(listed, "name string, shard long, tier int, shard_rows long, version long")
    rows = store.read(version, own).select(F.col(id_col), F.col(own).alias("name"))
    return rows.join(listed, "name").select(id_col, "shard", "tier", "shard_rows", "version")
