"""A stored table with a key, in buckets by the key's hash: writes read and replace the buckets they touch, and no others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .stages import saved

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """The table at ``path``, a folder a bucket. ``buckets`` is part of its layout: the same at every call, and such that a bucket is a file of 100 MB or so.

    Keys are unique and not null; a column named ``_bucket`` is refused. A write stages whole buckets first and then replaces them, so one that breaks off can be run again
    and comes to the same rows. There is one writer at a time."""

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        if BUCKET in rows.columns:
            raise ValueError(f"a column has the name {BUCKET}")
        # the key is unique, so no bucket is larger than its share by much
        return rows.withColumn(BUCKET, self._bucket()).repartition(min(self.buckets, 2000), BUCKET)

    def create(self, rows: DataFrame) -> None:
        """Writes the table anew."""
        self._checked(rows)
        self._dealt(rows).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(self.path)

    def _checked(self, rows: DataFrame) -> None:
        bad = F.lit(False)
        for k in self.keys:
            bad = bad | F.col(k).isNull()
        repeated = rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | bad)
        if not repeated.isEmpty():
            raise ValueError(f"a key of {', '.join(self.keys)} is null or repeated")

    def read(self, spark: SparkSession, touched: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets: other folders are not read."""
        rows = spark.read.parquet(self.path)
        if touched is not None:
            rows = rows.filter(F.col(BUCKET).isin(touched))
        return rows.drop(BUCKET)

    def find(self, keys: DataFrame) -> DataFrame:
        """The rows with the given keys, of the buckets that may hold them."""
        return self.read(keys.sparkSession, self._touched(keys)).join(keys.select(*self.keys), list(self.keys), "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        # at most as many numbers as buckets
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def upsert(self, new: DataFrame) -> list[int]:
        """Takes rows up: fields that are null in ``new`` keep their old values, also whole columns that it lacks. Returns the buckets replaced."""
        spark = new.sparkSession
        new = saved(new, "changes")
        self._checked(new)
        touched = self._touched(new)
        if touched:
            old = self.read(spark, touched)
            lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema if f.name not in new.columns]
            self._replace(store.upsert(old, new.select("*", *lacking), list(self.keys)).select(*old.columns))
        return touched

    def patch(self, changes: DataFrame, columns: list[str]) -> list[int]:
        """Replaces ``columns``, also by null, in the rows whose key ``changes`` has; keys that the table lacks are left out. Returns the buckets replaced."""
        spark = changes.sparkSession
        changes = saved(changes.select(*self.keys, *columns), "changes")
        self._checked(changes)
        known = self.find(changes).select(*self.keys)
        changes = saved(changes.join(known, list(self.keys), "left_semi"), "known")
        touched = self._touched(changes)
        if touched:
            old = self.read(spark, touched)
            to = changes.select(*self.keys, F.struct(*columns).alias("_change"))
            given = F.col("_change").isNotNull()
            rows = old.join(to, list(self.keys), "left")
            self._replace(rows.select(*[F.when(given, F.col(f"_change.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns]))
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Removes the rows with the given keys; a bucket that loses all its rows is left with an empty file."""
        spark = keys.sparkSession
        going = saved(self.find(keys).select(*self.keys), "going")
        touched = self._touched(going)
        if touched:
            kept = saved(self.read(spark, touched).join(going, list(self.keys), "left_anti"), "kept")
            left = set(self._touched(kept))
            self._replace(kept, stage=False)
            # dynamic overwriting replaces only folders with rows
            for bucket in [b for b in touched if b not in left]:
                kept.limit(0).write.mode("overwrite").parquet(f"{self.path}/{BUCKET}={bucket}")
        return touched

    def _replace(self, rows: DataFrame, stage: bool = True) -> None:
        # staged as a written table: what is read from the buckets is read to the end before one is replaced
        whole = saved(rows, "buckets") if stage else rows
        self._dealt(whole).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
