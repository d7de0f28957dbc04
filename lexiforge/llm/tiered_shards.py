"""Size-tiered compaction of immutable Parquet shards under a versioned manifest, in DataFrame operations.

An arrival is appended as small shards by a narrow write. Compaction puts the live shards below the target
size in tiers by the logarithm of their bytes, packs neighbours of a tier into groups of at most the target
size, and rewrites each group of at least ``fan_in`` shards (or of half the target) as one file; a group's
result enters a higher tier and rounds go on until no group qualifies. A version is committed by renaming a
pointer file to the version's number without overwriting: of two writers one fails and nothing is seen half.
Every version stays readable until ``vacuum`` deletes the files that none of the kept versions names; a lost job leaves
files that no version names. Reading a version whose files are gone raises.

A job rewrites at most ``job_groups`` groups of at most ``group_files`` shards, which bounds the list of files that
the driver holds and the table of (file, group) that is broadcast. Groups are numbered and each number is one task's.

Defined results: any columns and values are kept as they are, whatever the columns' names, nulls, empty texts and
repeated rows too; an empty arrival commits a version without new shards; reading where there is no shard gives the
empty table of ``schema`` or raises without one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.llm.common import filesystem, free_name, materialise

ENTRY = "shard string, shard_rows long, shard_bytes long, tier int, since long"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, small_bytes: int = 1 << 20, fan_in: int = 4, rows_per_shard: int = 2000, job_groups: int = 256, group_files: int = 1000):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.small, self.fan_in, self.rows_per_shard, self.job_groups, self.group_files = target_bytes, small_bytes, fan_in, rows_per_shard, job_groups, group_files
        self.fs, self._path = filesystem(spark, self.root)

    # versions

    def versions(self) -> list[int]:
        """The versions that can be read, in order."""
        place = self._path(f"{self.root}/versions")
        names = [x.getPath().getName() for x in self.fs.listStatus(place)] if self.fs.exists(place) else []
        return sorted(int(n[1:].split(".")[0]) for n in names if n.startswith("v"))

    def version(self) -> int:
        """The number of the latest version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.sql("SELECT '' AS shard, 0L AS shard_rows, 0L AS shard_bytes, 0 AS tier, 0L AS since WHERE false")
        found = self.fs.open(self._path(f"{self.root}/versions/v{v:012d}"))
        name = bytearray()
        while (b := found.read()) >= 0:
            name.append(b)
        found.close()
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/manifests/{name.decode()}")

    def commit(self, entries: DataFrame, version: int) -> None:
        """Make entries version; raises where another writer has committed that version."""
        name = uuid.uuid4().hex
        entries.coalesce(1 + self.job_groups // 64).write.parquet(f"{self.root}/manifests/{name}")
        jvm, pending = self.spark.sparkContext._jvm, f"{self.root}/pending-{name}"
        out = self.fs.create(self._path(pending), False)
        out.write(bytearray(name.encode()))
        out.close()
        self.fs.mkdirs(self._path(f"{self.root}/versions"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(pending).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(self._path(pending)), self.fs.makeQualified(self._path(f"{self.root}/versions/v{version:012d}")), none)
        except Exception:
            self.fs.delete(self._path(pending), False)
            raise

    # writing

    def _entries(self, run: str, since: int) -> DataFrame:
        files = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/{run}")
        meta = files.metadataColumn("_metadata")
        files = files.select(meta["file_path"].alias("p"), meta["file_size"].alias("b"))
        sized = files.groupBy("p").agg(F.count("*").alias("shard_rows"), F.max("b").alias("shard_bytes"))
        return sized.select(F.concat(F.lit(f"{run}/"), F.substring_index("p", f"/{run}/", -1)).alias("shard"), "shard_rows", "shard_bytes", self._tier().alias("tier"), F.lit(since).cast("long").alias("since"))

    def _tier(self):
        return F.greatest(F.lit(0), F.floor(F.log(F.col("shard_bytes") / self.small) / F.log(F.lit(float(self.fan_in))))).cast("int")

    def append(self, df: DataFrame) -> int:
        """Write an arrival as small shards and commit them; gives the new version."""
        v = self.version() + 1
        run = f"data/run-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", self.rows_per_shard).parquet(f"{self.root}/{run}")
        self.commit(self.manifest(v - 1).unionByName(self._entries(run, v)), v)
        return v

    def plan(self) -> DataFrame:
        """shard, grp, of the shards that the next round rewrites.

        Prefix sums of bytes run within slices of a tier that have about 64 targets each.
        """
        live = self.manifest().filter(F.col("shard_bytes") < 0.75 * self.target)
        tiers = live.groupBy("tier").agg(F.greatest(F.lit(1), F.ceil(F.sum("shard_bytes") / (64 * self.target))).alias("slices"))  # a row for each tier: few dozen
        live = live.join(F.broadcast(tiers), "tier").withColumn("slice", F.pmod(F.xxhash64("shard"), F.col("slices")))
        order = Window.partitionBy("tier", "slice").orderBy("since", "shard")
        before = F.sum("shard_bytes").over(order) - F.col("shard_bytes")
        live = live.withColumn("nth", F.floor(F.greatest(before / self.target, (F.row_number().over(order) - 1) / self.group_files)))
        group = Window.partitionBy("tier", "slice", "nth")
        picked = live.withColumn("members", F.count("*").over(group)).withColumn("size", F.sum("shard_bytes").over(group))
        picked = picked.filter((F.col("members") >= self.fan_in) | (F.col("members") > 1) & (F.col("size") >= self.target / 2))
        return picked.select("shard", F.concat_ws("-", "tier", "slice", "nth").alias("grp"))

    def compact(self, keep: int | None = None) -> int:
        """Rounds of rewriting until no group qualifies; gives the last version. With ``keep``, each round ends with a vacuum."""
        while True:
            plan = materialise(self.spark, self.plan(), "compaction")
            names = [r["grp"] for r in plan.select("grp").distinct().orderBy("grp").limit(self.job_groups).collect()]
            if not names:
                return self.version()
            self._rewrite(plan.filter(F.col("grp").isin(names)), names)
            if keep is not None:
                self.vacuum(keep)

    def _rewrite(self, plan: DataFrame, names: list[str]) -> None:
        v = self.version() + 1
        number = {g: i for i, g in enumerate(names)}
        old = {r["shard"]: number[r["grp"]] for r in plan.collect()}  # the files of at most job_groups groups
        run = f"data/run-{uuid.uuid4().hex}"
        rows = self._files(list(old))
        group, file = free_name(rows, "group"), free_name(rows, "file")
        numbers = self.spark.createDataFrame([(s.split("data/", 1)[1], n) for s, n in old.items()], f"`{file}` string, `{group}` int")
        placed = rows.withColumn(file, F.substring_index(rows.metadataColumn("_metadata")["file_path"], "/data/", -1)).join(F.broadcast(numbers), file)
        placed.repartitionById(len(names), F.col(group)).drop(file, group).write.option("compression", "zstd").parquet(f"{self.root}/{run}")
        keep = self.manifest(v - 1).join(F.broadcast(plan.select("shard")), "shard", "left_anti")
        self.commit(keep.unionByName(self._entries(run, v)), v)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the data files that none of the last ``keep`` versions names, and the older versions; gives the number of files.

        Only files of runs that some version committed are looked at, so a writer at work loses nothing.
        """
        last = self.version()
        kept, gone = range(max(1, last - keep + 1), last + 1), [v for v in self.versions() if v <= last - keep]
        if not gone:
            return 0
        live = self.manifest(kept[0])
        for v in kept[1:]:
            live = live.unionByName(self.manifest(v))
        dead = self.manifest(gone[0])
        for v in gone[1:]:
            dead = dead.unionByName(self.manifest(v))
        n = 0
        for r in dead.select("shard").distinct().join(live.select("shard").distinct(), "shard", "left_anti").toLocalIterator():
            n += bool(self.fs.delete(self._path(f"{self.root}/{r['shard']}"), False))
        for v in gone:
            self.fs.delete(self._path(f"{self.root}/versions/v{v:012d}"), False)
        return n

    # reading

    def _files(self, shards: list[str], schema: str | None = None) -> DataFrame:
        """The rows of the shards; raises where one is absent."""
        reader = self.spark.read.option("ignoreMissingFiles", "false")
        return (reader.schema(schema) if schema else reader).parquet(*[f"{self.root}/{s}" for s in shards])

    def read(self, version: int | None = None, column: str | None = "_shard", schema: str | None = None) -> DataFrame:
        """The rows of a version; a further struct column (none for None) names the shard of each (shard, rows, bytes, tier, since).

        The files are those that the manifest names. The manifest is joined as a broadcast while it has at most 100,000 rows.
        A column of the rows by the name of the struct column gives way to it.
        """
        if version is not None and version not in self.versions():
            raise ValueError(f"version {version} is not kept")
        m = self.manifest(version)
        names = [r["shard"] for r in m.select("shard").toLocalIterator()]
        if not names:
            if schema is None:
                raise ValueError("no shard and no schema")
            return self.spark.createDataFrame([], schema)
        rows = self._files(names, schema)
        if column is None:
            return rows
        rows = rows.drop(column)
        file = free_name(rows, f"{column}_file")
        rows = rows.withColumn(file, F.concat(F.lit("data/"), F.substring_index(rows.metadataColumn("_metadata")["file_path"], "/data/", -1)))
        m = m.select(F.col("shard").alias(file), F.struct("shard", F.col("shard_rows").alias("rows"), F.col("shard_bytes").alias("bytes"), "tier", "since").alias(column))
        return rows.join(F.broadcast(m) if len(names) <= 100_000 else m, file).drop(file)
