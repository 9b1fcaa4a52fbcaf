"""Work on new and changed records only: fingerprints of partitions, and tables refreshed partition by partition.

A record is a key with a content hash. Records are spread over a fixed number of partitions by a hash of their key;
the fingerprint of a partition is the number of its records and the sums of the two halves of a 64-bit hash of each
record (sums don't depend on order and can be made before the shuffle). Partitions with equal fingerprints hold equal
records, the others are compared, and recomputed, as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_materialized, drop_path, materialize

#: Records a partition is meant to hold where the caller sets no number of partitions.
PARTITION_RECORDS = 512


def present_rows(feed: DataFrame, keys: list[str], value: str, updated: str = "updated_at", seq: str = "seq") -> DataFrame:
    """The present row of each key of a feed: the greatest ``updated`` (null oldest), among equals the greatest ``seq``.

    Rows with a null in a key are dropped. Result: keys and ``value``.
    """
    rank = F.struct(F.coalesce(F.col(updated).cast("timestamp"), F.timestamp_seconds(F.lit(-(10**11)))), F.col(seq))
    kept = feed.where(_all_set(keys))
    return kept.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), rank).alias("s")).select(*keys, F.col("s.v").alias(value))


def _all_set(keys: list[str]) -> Column:
    test = F.lit(True)
    for key in keys:
        test = test & F.col(key).isNotNull()
    return test


def partition_of(keys: list[str], partitions: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")


def fingerprints(records: DataFrame, keys: list[str], values: list[str], partitions: int | None = None, part: str = "part") -> DataFrame:
    """(part, records, low, high) of ``records``; ``part`` is computed from the keys unless it is given as a column."""
    if partitions is not None:
        records = records.withColumn(part, partition_of(keys, partitions))
    row = F.xxhash64(*keys, *values, *[F.col(v).isNull() for v in values])
    return (
        records.select(part, row.alias("h"))
        .groupBy(part)
        .agg(F.count("*").alias("records"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high"))
    )


def changed_partitions(now: DataFrame, before: DataFrame, part: str = "part") -> DataFrame:
    """Partitions whose fingerprint is new, gone or another one: (part)."""
    a, b = now.alias("a"), before.alias("b")
    same = F.col("a.records").eqNullSafe(F.col("b.records")) & F.col("a.low").eqNullSafe(F.col("b.low")) & F.col("a.high").eqNullSafe(F.col("b.high"))
    return a.join(b, F.col(f"a.{part}") == F.col(f"b.{part}"), "full_outer").where(~same).select(F.coalesce(f"a.{part}", f"b.{part}").alias(part))


def stale_records(present: DataFrame, committed: DataFrame, keys: list[str], value: str, partition_records: int = PARTITION_RECORDS) -> DataFrame:
    """Keys of ``present`` that a run must process: never committed, committed with another value, or without a value.

    Both tables have one row a key. Their fingerprints are compared by partition, and only the records of partitions
    that differ, or that hold a null value, are compared one by one.
    """
    both = (
        present.select(*keys, F.col(value).alias("now"), F.lit(True).alias("is_now"), F.lit(None).cast("string").alias("was"), F.lit(False).alias("is_was"))
        .unionByName(committed.select(*keys, F.lit(None).cast("string").alias("now"), F.lit(False).alias("is_now"), F.col(value).alias("was"), F.lit(True).alias("is_was")))
        .groupBy(*keys)
        .agg(F.max("now").alias("now"), F.bool_or("is_now").alias("is_now"), F.max("was").alias("was"), F.bool_or("is_was").alias("is_was"))
    )
    return stale_of_aligned(both, keys, partition_records)


def stale_of_aligned(both: DataFrame, keys: list[str], partition_records: int = PARTITION_RECORDS) -> DataFrame:
    """As :func:`stale_records`, from one table with ``now, is_now, was, is_was`` a key."""
    both = materialize(both.where("is_now"), "aligned")
    partitions = max(1, -(-both.count() // partition_records))
    both = both.withColumn("part", partition_of(keys, partitions))
    now = fingerprints(both.withColumn("v", F.col("now")), keys, ["v"])
    was = fingerprints(both.where("is_was").withColumn("v", F.col("was")), keys, ["v"])
    nulls = both.where(F.col("now").isNull()).select("part")
    changed = changed_partitions(now, was).unionByName(nulls).distinct()
    stale = F.col("now").isNull() | ~F.col("is_was") | ~F.col("now").eqNullSafe(F.col("was"))
    return both.join(changed, "part", "left_semi").where(stale).select(*keys)


class IncrementalTable:
    """A derived table under ``path``, refreshed partition by partition.

    ``data/part=N`` holds what ``compute`` makes of the records of partition N, ``state/part=N`` the fingerprint that
    it was made from, ``layout`` the number of partitions, which the first refresh fixes. A refresh finds the partitions
    whose fingerprint changed, reads their records once into a table of its own, and derives both the data and the new
    fingerprints from that table, so that records that arrive meanwhile are left to the next refresh. Changed
    partitions are replaced by dynamic partition overwrite, or emptied if nothing is left of them, data before state: a
    run that dies in between leaves old fingerprints, and the next run does those partitions again and replaces what
    was written, so that no record is skipped or present twice.

    Nulls in values are values of their own; records with a null key belong to a partition as others do. Repeated
    records count as often as they occur. Without records all partitions are emptied.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str], partitions: int = 64):
        self.spark, self.path, self.keys, self.values, self.wanted = spark, path.rstrip("/"), keys, values, partitions

    def _partitions(self) -> list[int]:
        """Numbers of the partitions that hold data."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n.removeprefix("part=")) for n in names if n.startswith("part=")]

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    @property
    def partitions(self) -> int:
        """The number of partitions: the stored one, or before the first refresh the wanted one."""
        if not self._exists("layout/_SUCCESS"):
            return self.wanted
        return self.spark.read.schema("partitions int").parquet(f"{self.path}/layout").first()[0]

    def _state(self) -> DataFrame:
        columns = "records bigint, low bigint, high bigint, part int"
        if not self._exists("state"):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(f"{self.path}/state")

    def changed(self, records: DataFrame) -> list[int]:
        """Numbers of the changed partitions; at most as many as there are partitions."""
        now = fingerprints(records, self.keys, self.values, self.partitions)
        return sorted(r[0] for r in changed_partitions(now, self._state()).collect())

    def refresh(self, records: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Bring the table up to date with ``records``; the partitions that were recomputed. ``compute`` must keep the column part."""
        if not self._exists("layout/_SUCCESS"):
            self.spark.range(1).select(F.lit(self.wanted).alias("partitions")).write.mode("overwrite").parquet(f"{self.path}/layout")
        changed = self.changed(records)
        if not changed and self._exists("empty"):
            return []
        parted = records.withColumn("part", partition_of(self.keys, self.partitions))
        mine = materialize(parted.where(F.col("part").isin(changed)), "changed")
        made = materialize(compute(mine), "refreshed")
        if not self._exists("empty"):  # the columns of the table, for as long as it holds nothing
            made.limit(0).write.mode("overwrite").parquet(f"{self.path}/empty")
        now = materialize(fingerprints(mine, self.keys, self.values), "fingerprints")
        self._put(made, changed, "data")
        self._put(now, changed, "state")
        for used in (made, now, mine):
            drop_materialized(used)
        return changed

    def _put(self, rows: DataFrame, changed: list[int], name: str) -> None:
        """Replace the changed partitions of ``name``; dynamic overwrite leaves those alone that have no rows, so they are dropped."""
        rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")
        full = {r[0] for r in rows.select("part").distinct().collect()}
        for part in changed:
            if part not in full:
                drop_path(self.spark, f"{self.path}/{name}/part={part}")

    def read(self) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.path}/empty").schema
        return self.spark.read.schema(kind).parquet(f"{self.path}/{'data' if self._partitions() else 'empty'}")
