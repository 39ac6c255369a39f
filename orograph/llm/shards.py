"""Size-tiered compaction of shards with a versioned manifest.

Every append writes its rows as small immutable files: a run. Runs whose files are of similar
size form a tier; once a tier has enough files, its runs are merged into files of the target
size. A merge deals whole neighbouring files to each new one, so that nothing is shuffled. The
manifest names the runs of a version and the columns; a new version is written beside its place
and moved there in one step that never replaces a file, then read back: a writer that finds
another's version in its place has lost. Readers see one version or the next, and a failed task
or job leaves only files that no manifest names.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orograph.llm.common import fresh

TARGET_BYTES = 64 << 20
#: Files of a tier that start a merge; also the ratio of sizes between tiers.
FAN_IN = 4


@dataclass(frozen=True)
class Run:
    """Immutable files of similar size in one folder; parts: one more than the highest part number of a file."""

    path: str
    files: int
    rows: int
    bytes: int
    parts: int = 0

    def tier(self, target: int, fan_in: int) -> int:
        """0 for files of the target size (half of it or more), 1 for those up to fan_in times smaller, and so on."""
        mean = self.bytes / max(1, self.files)
        return 0 if 2 * mean >= target else 1 + int(math.log(target / max(1.0, mean), fan_in))


@dataclass(frozen=True)
class Manifest:
    """schema: that of the first append, as JSON; None before it."""

    version: int
    runs: tuple[Run, ...] = ()
    schema: str | None = None


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Shards under one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> None:
        if target_bytes < 1 or fan_in < 2:
            raise ValueError("target_bytes must be positive and fan_in 2 at least")
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._file(self.path).getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)

    def _file(self, path: str):
        return self._hadoop.Path(path)

    # ---- manifest -------------------------------------------------------------------------

    def _held(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest/v{version:012d}.json", wholetext=True).first()[0])

    def manifest(self) -> Manifest:
        """The newest version; version 0 has no runs."""
        folder = self._file(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        versions = sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))
        if not versions:
            return Manifest(0)
        held = self._held(versions[-1])
        return Manifest(held["version"], tuple(Run(**r) for r in held["runs"]), held["schema"])

    def commit(self, old: Manifest, runs: tuple[Run, ...], schema: str | None = None) -> Manifest:
        """Makes runs the version after old, or raises Conflict."""
        new, writer = Manifest(old.version + 1, runs, old.schema or schema), uuid.uuid4().hex
        place, beside = (self._file(f"{self.path}/manifest/{n}") for n in (f"v{new.version:012d}.json", f"_{writer}"))
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps({"version": new.version, "writer": writer, "schema": new.schema, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        never_replace = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._context.rename(beside, place, never_replace)
        except Exception as problem:
            self._fs.delete(beside, False)
            if not self._fs.exists(place):
                raise
            raise Conflict(f"version {new.version} exists") from problem
        if self._held(new.version)["writer"] != writer:
            raise Conflict(f"version {new.version} is another writer's")
        return new

    # ---- writing --------------------------------------------------------------------------

    def _run(self, path: str) -> Run:
        files, size, parts = 0, 0, 0
        for s in self._fs.listStatus(self._file(path)):
            if found := re.match(r"part-(\d+)", s.getPath().getName()):
                files, size, parts = files + 1, size + s.getLen(), max(parts, int(found[1]) + 1)
        return Run(path, files, self.spark.read.parquet(path).count() if files else 0, size, parts)

    def append(self, docs: DataFrame, arrivals: int = 1) -> Manifest:
        """Adds all rows of docs, as so many runs of one file a task each, by a hash of the row.

        All columns and rows are kept, nulls, empty texts and repeated rows among them. An empty
        table adds nothing but a version, and its columns if it is the first.
        """
        old, home = self.manifest(), f"{self.path}/runs/{uuid.uuid4().hex}"
        by = fresh(docs, "arrival")
        # maps have no hash of their own
        values = [F.to_json(F.struct(c)) if "map<" in t else c for c, t in ((F.col("`" + n.replace("`", "``") + "`"), t) for n, t in docs.dtypes)]
        number = F.pmod(F.xxhash64(*values), F.lit(arrivals)).cast("int")
        docs.withColumn(by, number).write.option("compression", "zstd").partitionBy(by).parquet(home)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._file(home)) if s.isDirectory()]
        runs = [self._run(f"{home}/{n}") for n in sorted(found) if not n.startswith("_")]
        return self.commit(old, (*old.runs, *(r for r in runs if r.files)), docs.schema.json())

    def compact(self) -> Manifest:
        """Merges every tier that has fan_in files or more, smallest files first, until none has.

        A tier is one job, however large: each of its tasks writes one file of about the target size.
        """
        while True:
            old = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in old.runs:
                if (t := r.tier(self.target, self.fan_in)) > 0:
                    tiers.setdefault(t, []).append(r)
            ready = [t for t, runs in tiers.items() if sum(r.files for r in runs) >= self.fan_in]
            if not ready:
                return old
            runs = tiers[max(ready)]
            size, files = sum(r.bytes for r in runs), sum(r.files for r in runs)
            # as large as the target, or the next tier if there is not enough for one
            new_files = max(1, min(files // self.fan_in, math.ceil(size / self.target)))
            place = f"{self.path}/runs/{uuid.uuid4().hex}"
            with self._reading_by(max(1, size // new_files)):
                self.read(replace(old, runs=tuple(runs))).coalesce(new_files).write.option("compression", "zstd").parquet(place)
            kept = tuple(r for r in old.runs if r not in runs)
            self.commit(old, (*kept, self._run(place)))

    @contextmanager
    def _reading_by(self, size: int) -> Iterator[None]:
        """Scans begun meanwhile deal about so many bytes of files to a task, so that no task writes more."""
        conf, names = self.spark.conf, {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
        before = {k: conf.get(k) for k in names}
        try:
            for k, v in names.items():
                conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                conf.set(k, v)

    def vacuum(self) -> None:
        """Deletes runs that the newest version doesn't name. Readers of older versions must be done."""
        named = {r.path for r in self.manifest().runs}
        home = self._file(f"{self.path}/runs")
        for s in self._fs.listStatus(home) if self._fs.exists(home) else []:
            inner = [x.getPath() for x in self._fs.listStatus(s.getPath()) if x.isDirectory() and "=" in x.getPath().getName()]
            for p in inner or [s.getPath()]:
                if not any(p.toString().endswith(n.removeprefix(self.path)) for n in named):
                    self._fs.delete(p, True)

    # ---- reading --------------------------------------------------------------------------

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        """All rows of a version (the newest), with the columns that were appended; an error before the first append."""
        held = manifest or self.manifest()
        if held.schema is None:
            raise ValueError("nothing was appended yet")
        schema = StructType.fromJson(json.loads(held.schema))
        if not held.runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[r.path for r in held.runs])

    def shards(self, columns: list[str], manifest: Manifest | None = None) -> DataFrame:
        """The given columns of every row, with the number (shard) of the file that holds it, counted over the version's runs."""
        held = manifest or self.manifest()
        rows = self.read(held)
        name = fresh(rows.select(*columns), "shard")
        if not held.runs:
            return rows.select(*columns, F.lit(None).cast("long").alias(name))
        # a run's folder and its first number; runs are few, as a merge makes one of a tier
        first, at = [], 0
        for r in held.runs:
            first += [F.lit(r.path.rsplit("/runs/", 1)[-1]), F.lit(at)]
            at += r.parts
        path = F.element_at(F.split(F.input_file_name(), "/runs/"), -1)
        number = F.regexp_extract(path, r"/part-(\d+)", 1).cast("long") + F.element_at(F.create_map(*first), F.regexp_replace(path, r"/part-[^/]*$", ""))
        return rows.select(*columns, number.alias(name))
