"""Versioned keyed tables: a batch replaces only the hash buckets that its keys fall into.

Each version writes the buckets it touches, ``data/version=V/bucket=B``, and then a manifest,
``manifest/version=V``, that names the version of every bucket.  The manifest is the commit: a
version without one is not seen and is written again, a version with one is not applied twice.
So a batch reads and writes its own buckets, however long the history is, and the state before
any version can still be read when a batch is repeated.
"""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotwise.session import children, remove


class Snapshot:
    """The table below ``path``: ``schema`` (DDL) with unique ``keys``, dealt into ``buckets``.

    A bucket is what a batch has to rewrite to change one key of it; each is written by
    ``parts`` tasks.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 32, parts: int = 1):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.parts = spark, path.rstrip("/"), schema, keys, buckets, parts

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some keys: at most ``buckets`` numbers."""
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        found = [name for name in children(self.spark, f"{self.path}/manifest") if name.startswith("version=")]
        return sorted(int(name.split("=")[1]) for name in found if "_SUCCESS" in children(self.spark, f"{self.path}/manifest/{name}"))

    def places(self, before: int | None = None) -> dict[int, int]:
        """The version that holds each bucket, in the last version below ``before``."""
        committed = [v for v in self.versions() if before is None or v < before]
        if not committed:
            return {}
        rows = self.spark.read.schema("bucket int, holder long").parquet(f"{self.path}/manifest/version={committed[-1]}").collect()
        return {r.bucket: r.holder for r in rows}

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table as of the last version below ``before``, all of it or some buckets."""
        places = self.places(before)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(places.items()) if buckets is None or b in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, version: int, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets of ``changes`` by ``apply(their rows, changes)``; a version that is committed stays as it is.

        Versions are applied in ascending order.  Returns the buckets that were rewritten.
        """
        committed = self.versions()
        if version in committed:
            return []
        if committed and version < committed[-1]:
            raise ValueError(f"version {version} comes after {committed[-1]}")
        touched = self.touched(changes)
        fresh = apply(self.read(version, touched), changes).select(*self.spark.createDataFrame([], self.schema).columns)
        data, spread = f"{self.path}/data/version={version}", F.pmod(F.xxhash64(*self.keys, F.lit("part")), F.lit(self.parts))
        fresh.withColumn("bucket", self.bucket()).repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(data)
        written = {int(name.split("=")[1]) for name in children(self.spark, data) if name.startswith("bucket=")}
        places = {b: v for b, v in self.places(version).items() if b not in touched} | dict.fromkeys(written, version)
        self.spark.createDataFrame(sorted(places.items()), "bucket int, holder long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return touched

    def vacuum(self, keep: int = 2) -> None:
        """Deletes versions that none of the last ``keep`` ones needs; those can no longer be read or repeated."""
        committed = self.versions()
        if len(committed) <= keep:
            return
        needed = {v for last in committed[-keep:] for v in self.places(last + 1).values()}
        for v in committed[:-keep]:
            remove(self.spark, f"{self.path}/manifest/version={v}")
            if v not in needed:
                remove(self.spark, f"{self.path}/data/version={v}")
