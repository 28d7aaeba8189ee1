"""Current records kept up to date batch by batch.

The newest version of each key is kept in Parquet, dealt into buckets by key. A batch reads and writes only the buckets that its keys fall in: their rows and the
batch's are ranked again, and the result goes to a folder of the batch's own. A small log says which folder holds each bucket; it is appended
to last, in one file, so a batch that fails leaves the state as it was, and what it wrote is never read.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.sources.relations import Population, current_records


class CurrentRecords:
    """The state in ``folder``, which the driver and all executors share. One writer at a time.

    Deleted keys stay in the state, so that a late, older version does not bring them back; rows with a NULL key part all stay. The
    schema is the first batch's.
    """

    def __init__(self, spark: SparkSession, folder: str, population: Population, buckets: int = 64) -> None:
        if not population.version_by:
            raise ValueError("a history without a version column has no newest rows")
        self.spark, self.folder, self.population, self.buckets = spark, folder, population, buckets

    def _bucket(self, df: DataFrame) -> Column:
        keys = [F.col(k) for k in self.population.record_key]
        keyless = functools.reduce(operator.or_, [k.isNull() for k in keys])
        # rows without a key are dealt by what they hold, else they would be one hot bucket
        return F.pmod(F.when(keyless, F.xxhash64(*[F.col(c) for c in df.columns])).otherwise(F.xxhash64(*keys)), F.lit(self.buckets)).cast("int")

    def _places(self) -> dict[int, int]:
        """Bucket -> the batch that wrote it last; at most a row for each bucket comes to the driver."""
        try:
            log = self.spark.read.schema("bucket int, batch int").parquet(f"{self.folder}/log")
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r.bucket: r.batch for r in log.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def _read(self, places: dict[int, int], schema: T.StructType | None = None) -> DataFrame | None:
        paths = [f"{self.folder}/batch={batch}/_bucket={bucket}" for bucket, batch in sorted(places.items())]
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*paths) if paths else None

    def apply(self, batch: DataFrame) -> list[int]:
        """Takes a batch of versions in; which buckets it touched."""
        places = self._places()
        rows = batch.withColumn("_bucket", self._bucket(batch))
        # at most one row for each bucket
        touched = sorted(r._bucket for r in rows.select("_bucket").distinct().collect())
        if not touched:
            return []
        number = max(places.values(), default=-1) + 1
        old = self._read({b: places[b] for b in touched if b in places}, batch.schema)
        every = batch if old is None else old.select(*batch.columns).unionByName(batch)
        newest = current_records(every, replace(self.population, deleted_column=None))
        newest.withColumn("_bucket", self._bucket(batch)).repartition(min(len(touched), 512), "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/batch={number}")
        self.spark.createDataFrame([(b, number) for b in touched], "bucket int, batch int").coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return touched

    def records(self) -> DataFrame:
        """The current records, deletions left out."""
        newest = self._read(self._places())
        if newest is None:
            raise ValueError("no batch has been applied")
        return current_records(newest, replace(self.population, version_by=()))
