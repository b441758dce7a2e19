"""Sharding by size-tiered compaction: small immutable shards, merged runs, and a versioned manifest."""

from __future__ import annotations

import json
import time
import uuid
from math import floor, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import contents, filesystem, forget, names_in, new_path, publish

#: Bytes of a full shard, how many shards of a tier make a run, and the factor between tiers.
TARGET, FAN_IN, FACTOR = 128 << 20, 4, 4
#: Rows of an arriving shard at most.
ARRIVAL_ROWS = 20_000
#: Of more shards than this the list is joined, not broadcast.
LISTED = 1 << 18

#: How often a commit is tried again after other writers' ones, and seconds after which files of no version are left over.
TRIES, LEFT_OVER = 20, 86_400

#: A shard in the manifest: {"id", "path", "bytes", "at"}; at: when it was written.
Shard = dict


class Store:
    """A table of shards under one path, with one manifest file per version.

    Shards are Parquet files that never change. A version becomes real when its manifest is renamed to its name,
    which fails if another writer was first; so readers see whole versions, and nothing is lost when a writer dies.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.manifests = filesystem(spark, f"{self.path}/_manifests")
        self.fs.mkdirs(self.manifests)

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        return max((int(x[1:-5]) for x in names_in(self.spark, f"{self.path}/_manifests") if x.startswith("v") and x.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        return self.manifest(version)["shards"]

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards"}; schema: of the rows, as JSON."""
        version = self.version() if version is None else version
        return json.loads(contents(self.spark, f"{self.path}/_manifests/v{version:08d}.json")) if version else {"version": 0, "schema": None, "shards": []}

    def commit(self, base: int, shards: list[Shard], schema: str | None = None) -> int:
        """Makes base + 1 the version with these shards; RuntimeError if another commit was first."""
        schema = schema or self.manifest(base)["schema"]
        text = json.dumps({"version": base + 1, "schema": schema, "shards": shards})
        if self.version() != base or not publish(self.spark, f"{self.path}/_manifests/v{base + 1:08d}.json", text):
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        return base + 1

    def exchange(self, gone: set[str], folder: str, schema: str | None = None) -> int:
        """Commits the shards written under folder instead of those with the ids in gone, on whatever version is the latest.

        RuntimeError, and nothing is left of folder, if one of gone is no longer there or others are always quicker.
        """
        new = self._written(folder)
        for _ in range(TRIES):
            base = self.version()
            known = self.shards(base)
            if not gone <= {x["id"] for x in known}:
                break
            try:
                return self.commit(base, [x for x in known if x["id"] not in gone] + new, schema)
            except RuntimeError:
                time.sleep(0.05)
        self.fs.delete(self._hadoop(folder), True)
        raise RuntimeError("other writers changed the same shards, or were always quicker")

    def _written(self, folder: str) -> list[Shard]:
        """The files that a job wrote under a folder, in order of their paths."""
        found, files = [], self.fs.listFiles(self._hadoop(folder), True)
        while files.hasNext():
            f = files.next()
            path = f.getPath().toString()
            if path.endswith(".parquet"):
                found.append((path, f.getLen(), f.getModificationTime()))
        return [{"id": f"{folder.rpartition('/')[2]}-{k:06d}", "path": p, "bytes": n, "at": t} for k, (p, n, t) in enumerate(sorted(found))]

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Writes rows as small shards, without a shuffle, and commits them beside those there are."""
        folder = f"{self.path}/arrived-{uuid.uuid4().hex[:12]}"
        rows.write.option("maxRecordsPerFile", arrival_rows).option("compression", "zstd").parquet(folder)
        return self.exchange(set(), folder, rows.schema.json())

    def compact(self, target: int = TARGET, fan_in: int = FAN_IN, factor: int = FACTOR, final: bool = False) -> int:
        """Merges runs of similar shards into shards of about the target size and commits; the version then.

        A run is fan_in shards or more of one tier, in order, of target bytes together at most; with `final` a tier's
        rest is merged too, whatever its number. All runs are merged by one job: each shard's rows go to the task of its run. Shards
        of the old version stay, for those who read it, until vacuum.
        """
        manifest = self.manifest()
        runs = plan_runs(manifest["shards"], target, fan_in, factor, final)
        if not runs:
            return manifest["version"]
        folder = f"{self.path}/merged-{uuid.uuid4().hex[:12]}"
        files = [(x, k) for k, run in enumerate(runs) for x in run]
        tagged, (run_col,) = self._tagged([x for x, _ in files], manifest["schema"], [("_run", "int", [k for _, k in files])])
        tagged.repartitionById(len(runs), F.col(run_col)).drop(run_col).write.option("compression", "zstd").parquet(folder)
        return self.exchange({x["id"] for x, _ in files}, folder)

    def _tagged(self, shards: list[Shard], schema: str, tags: list[tuple[str, str, list]]) -> tuple[DataFrame, list[str]]:
        """The rows of shards beside their shard's tags (name, type, values), and the names that these have in it: such as no column has."""
        kind = T.StructType.fromJson(json.loads(schema))
        file, *names = (next(x for k in range(len(kind) + 2) if (x := name + "_" * k) not in kind.names) for name in ("_file", *(t[0] for t in tags)))
        where = listed(self.spark, f"{self.path}/_lists/{uuid.uuid4().hex}", [{file: x["path"].rpartition("/")[2]} | {n: t[2][k] for n, t in zip(names, tags, strict=True)} for k, x in enumerate(shards)], ", ".join([f"{file} string", *(f"{n} {t[1]}" for n, t in zip(names, tags, strict=True))]))
        rows = self.spark.read.schema(kind).parquet(*(x["path"] for x in shards)).withColumn(file, F.element_at(F.split(F.input_file_name(), "/"), -1))
        return rows.join(F.broadcast(where) if len(shards) <= LISTED else where, file).drop(file), names

    def read(self, version: int | None = None, shard_col: str = "shard_id") -> DataFrame:
        """The rows of a version, each with its shard's id and bytes (shard_bytes); a version without shards can't be read."""
        manifest = self.manifest(version)
        shards = manifest["shards"]
        rows, names = self._tagged(shards, manifest["schema"], [(shard_col, "string", [x["id"] for x in shards]), ("shard_bytes", "long", [x["bytes"] for x in shards])])
        return rows.withColumnsRenamed(dict(zip(names, (shard_col, "shard_bytes"), strict=True)))

    def vacuum(self, left_over: float = LEFT_OVER) -> int:
        """Deletes shards that older versions have and the latest has not, and files of no version at all that are older than left_over seconds; their number."""
        version = self.version()
        now, old = {x["path"] for x in self.shards(version)}, set()
        for k in range(1, version):
            old |= {x["path"] for x in self.shards(k)}
        gone = old - now
        for name in names_in(self.spark, self.path):
            if name.startswith(("arrived-", "merged-")):
                for x in self._written(f"{self.path}/{name}"):
                    if x["path"] not in now | old and time.time() - x["at"] / 1000 > left_over:
                        gone.add(x["path"])
        for path in gone:
            self.fs.delete(self._hadoop(path), False)
        return len(gone)


def listed(spark: SparkSession, path: str, rows: list[dict], fields: str) -> DataFrame:
    """A table of plain values, from a file of one JSON text a line."""
    publish(spark, path, "\n".join(map(json.dumps, rows)))
    return spark.read.schema(fields).json(path)


def tier(size: int, target: int, factor: int) -> int:
    """0 for shards of over half the target, which are full; else 1 and up, a tier for each factor below."""
    return 0 if size > target // 2 else 1 + floor(log(max(target // 2, 1) / max(size, 1), factor))


def plan_runs(shards: list[Shard], target: int, fan_in: int, factor: int, final: bool = False) -> list[list[Shard]]:
    """The runs to merge, from the smallest tier; what a tier has too few of waits, or with `final` joins the next."""
    tiers: dict[int, list[Shard]] = {}
    for x in shards:
        tiers.setdefault(tier(x["bytes"], target, factor), []).append(x)
    tiers.pop(0, None)
    runs: list[list[Shard]] = []
    rest: list[Shard] = []
    for t in sorted(tiers, reverse=True):
        run: list[Shard] = []
        size = 0
        for x in [*rest, *tiers[t]]:
            if run and size + x["bytes"] > target:
                runs.append(run)
                run, size = [], 0
            run.append(x)
            size += x["bytes"]
        rest = []
        if len(run) >= fan_in:
            runs.append(run)
        elif final:
            rest = run
    if len(rest) > 1:
        runs.append(rest)
    return [run for run in runs if len(run) > 1]


def shard(rows: DataFrame, path: str | None = None, target: int = TARGET, fan_in: int = FAN_IN, factor: int = FACTOR, arrival_rows: int = ARRIVAL_ROWS, arrivals: int = 1) -> DataFrame:
    """rows once more, with shard_id and shard_bytes: appended to a store as arrivals, compacted, and read by its manifest.

    The store is at path, by default in the shared folder for as long as the driver runs. Rows are dealt by a hash of
    their plain columns to a number of arrivals, each of which is appended, then its tiers are compacted; at the end the
    rest is merged. All rows and columns stay as they are, nulls, empty and long texts and repeated rows too; an empty
    table gives an empty result; columns named shard_id or shard_bytes in rows are replaced. Shards differ by at most a
    run's size: where one source or key holds most rows makes no difference, as rows are merged by shard and never by key.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard_id", "shard_bytes")
    store = Store(spark, path or new_path(spark, "shards"))
    if path is None:
        forget(spark, store.path)
    plain = [F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
    for k in range(arrivals):
        store.append(rows.filter(F.pmod(F.xxhash64(*plain), F.lit(arrivals)) == k) if arrivals > 1 else rows, arrival_rows)
        store.compact(target, fan_in, factor, final=k == arrivals - 1)
    if path is None:
        store.vacuum()
    if not store.shards():
        return rows.withColumns({"shard_id": F.lit(None).cast("string"), "shard_bytes": F.lit(None).cast("long")}).filter(F.lit(False))
    return store.read().select(*(f"`{c}`" for c in rows.columns), "shard_id", "shard_bytes")
