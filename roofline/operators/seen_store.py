"""The seen store as bucketed runs (A13, D3, D4, H3 at scale).

The store is a list of *runs*.  Every run is a table bucketed and sorted by key with one bucket count, so a
union of runs is itself partitioned by key: probes and merges read the runs where they lie, and only the
listings of the cycle are shuffled.  An append writes one new run of level 0 with the keys that no run has.
``compact`` merges ``fanout`` runs of a level into one of the next, so a key is rewritten once per level and a
store of n batches has about ``fanout * log(n)`` runs.  Files carry a Parquet Bloom filter
over the keys, and a look-up of a few keys is pushed down to it.

The manifest names the runs that count.  It is written last, in turn into one of two slots, so a crash at any
point leaves the last state readable, and a batch handed out again finds itself there.  Runs that were
replaced stay on disk for readers that began before; ``superseded`` lists those of the last change.  One writer at a time,
as ``foreachBatch`` has.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedup import SEEN_COLS, seen_frame

SEEN_SCHEMA = "key string, title string, url string, source string"
MANIFEST_SCHEMA = ("version bigint, run string, level int, first_batch bigint, last_batch bigint, buckets int, "
                   "live boolean")

#: A Bloom filter per file and row group, as large as its number of keys needs: 1 MB down to 2 kB.
BLOOM = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true",
         "parquet.bloom.filter.candidates.number#key": "10"}


class SeenStore:
    """A seen store below ``path``.  ``buckets`` is fixed with the first append: choose it so that a bucket of the
    store's final size fits a task (128 MB of keys or so)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200, fanout: int = 8):
        if buckets < 1 or fanout < 2:
            raise ValueError("a store needs a bucket and a fanout of at least 2")
        self.spark, self.path, self.buckets, self.fanout = spark, path.rstrip("/"), buckets, fanout
        self._prefix = "seen_" + hashlib.md5(self.path.encode()).hexdigest()[:16]

    # -- manifest ---------------------------------------------------------------------------------------

    def _entries(self) -> list:
        """The rows of the newest manifest: bounded by the number of runs, never by keys."""
        newest: list = []
        for slot in (0, 1):
            try:
                rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.path}/manifest-{slot}").collect()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            if rows and (not newest or rows[0].version > newest[0].version):
                newest = rows
        if newest and newest[0].buckets != self.buckets:
            raise ValueError(f"the store at {self.path} has {newest[0].buckets} buckets, not {self.buckets}")
        return sorted(newest, key=lambda r: r.first_batch)

    def runs(self) -> list:
        """The runs that count, oldest first."""
        return [r for r in self._entries() if r.live]

    def superseded(self) -> list[str]:
        """Folders of runs that the last change of the store replaced."""
        return [self._folder(r.run) for r in self._entries() if not r.live]

    def _next_version(self) -> int:
        old = self._entries()
        return old[0].version + 1 if old else 0

    def _commit(self, runs: list[tuple], gone: list[tuple] = ()) -> None:
        version = self._next_version()
        rows = [(version, *r, self.buckets, True) for r in runs] + [(version, *r, self.buckets, False) for r in gone]
        self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest-{version % 2}")

    # -- runs -------------------------------------------------------------------------------------------

    def _folder(self, run: str) -> str:
        return f"{self.path}/runs/{run}"

    def _write_run(self, df: DataFrame, run: str) -> None:
        name = f"{self._prefix}_{run}"
        (df.select(*SEEN_COLS).write.format("parquet").mode("overwrite").bucketBy(self.buckets, "key").sortBy("key")
         .options(**BLOOM).option("path", self._folder(run)).saveAsTable(name))

    def _run(self, run: str) -> DataFrame:
        name, folder = f"{self._prefix}_{run}", self._folder(run).replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SEEN_SCHEMA}) USING parquet CLUSTERED BY (key) "
                       f"SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(name)

    def rows(self, before: int | None = None) -> DataFrame:
        """Every stored row: one per key, partitioned by key; with ``before`` those of the batches before that one
        (runs of later batches must not be merged yet)."""
        runs = [self._run(r.run) for r in self.runs() if before is None or r.first_batch < before]
        return reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], SEEN_SCHEMA)

    # -- operations -------------------------------------------------------------------------------------

    def append(self, rows: DataFrame, batch_id: int, replace: bool = False) -> bool:
        """H3: add the keys that the store lacks, the first of repeated rows by (title, url, source), nulls first;
        null keys are left out.  False where ``batch_id`` is not newer than the store: a batch handed out again.
        ``replace``: if it is the newest and not merged yet, what it stored is replaced instead."""
        runs = [(r.run, r.level, r.first_batch, r.last_batch) for r in self.runs()]
        gone = [r for r in runs if replace and r[2] == r[3] == batch_id]
        runs = [r for r in runs if r not in gone]
        if runs and runs[-1][3] >= batch_id:
            return False
        # Grouped first, so that a key repeated very often is combined before it moves; then one row per key goes to
        # its bucket, and probe and write stay there.
        fresh = seen_frame(rows).groupBy("key").agg(F.min(F.struct(*SEEN_COLS[1:])).alias("r")).select("key", "r.*")
        fresh = fresh.repartition(self.buckets, "key")
        if runs:
            fresh = fresh.join(self.rows(before=batch_id).select("key"), "key", "left_anti")
        # A run is written under a name of its own, so that what the manifest names is never written over.
        run = f"l0_{batch_id}_{batch_id}_v{self._next_version()}"
        self._write_run(fresh, run)
        self._commit([*runs, (run, 0, batch_id, batch_id)], gone)
        return True

    def compact(self) -> int:
        """Merge the oldest ``fanout`` runs of every level that has as many; returns the number of merges.
        The rows of the store do not change."""
        done = 0
        while True:
            runs = [(r.run, r.level, r.first_batch, r.last_batch) for r in self.runs()]
            full = [lv for lv in sorted({r[1] for r in runs}) if sum(r[1] == lv for r in runs) >= self.fanout]
            if not full:
                return done
            part = [r for r in runs if r[1] == full[0]][:self.fanout]
            new = (f"l{full[0] + 1}_{part[0][2]}_{part[-1][3]}_v{self._next_version()}", full[0] + 1, part[0][2], part[-1][3])
            self._write_run(reduce(DataFrame.unionByName, [self._run(r[0]) for r in part]), new[0])
            self._commit([r for r in runs if r not in part] + [new], part)
            done += 1

    def only_new(self, listings: DataFrame, key: str = "listing_id") -> DataFrame:
        """The rows whose ``key`` is not stored; a null key passes.  Null keys are spread by a hash of
        their row, under a prefix that ids and signatures do not have."""
        spread = F.concat(F.lit("\0null:"), F.xxhash64(*[c for c in listings.columns]).cast("string"))
        x = listings.withColumn("_seen_key", F.coalesce(F.col(key), spread))
        return x.join(self.rows().select(F.col("key").alias("_seen_key")), "_seen_key", "left_anti").drop("_seen_key")

    def lookup(self, *keys: str) -> DataFrame:
        """The stored rows of a few keys: a pushed filter that the files' Bloom filters answer."""
        return self.rows().filter(F.col("key").isin(*keys))
