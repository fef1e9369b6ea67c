"""A keyed table that micro-batches update: hash buckets, of which a batch reads and rewrites only its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.runtime import discard, read_note, write_note

BUCKETS = 256


class BucketTable:
    """Rows in ``rows/v=<batch>/bucket=<b>``, and per batch an index that names the newest version of every bucket.

    Batch n starts from the index of batch n - 1, so a retried batch finds what
    it found before and overwrites its own folders only. A version goes once the
    batch after the one that replaced it is done: nothing starts from it then.
    An index has one row per bucket; more buckets keep what a batch touches small.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def index(self, batch: int) -> dict[int, int]:
        """bucket -> version, as batch ``batch`` left it; one row per bucket."""
        if batch < 0:
            return {}
        return dict(read_note(self.spark, f"{self.path}/index/v={batch}.json"))

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/rows/v={version}/bucket={bucket}"

    def rows(self, batch: int, only: set[int] | None = None) -> DataFrame:
        """The table as batch ``batch`` left it, or its rows in some buckets; no other folder is opened."""
        known = self.index(batch)
        folders = [self._folder(b, v) for b, v in sorted(known.items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(f"{self.schema}, v bigint, bucket int").option("basePath", f"{self.path}/rows").parquet(*folders).drop("v", "bucket")

    def write(self, batch: int, rows: DataFrame, key: Column, touched: set[int]) -> None:
        """``rows`` are all rows of the touched buckets; the other buckets stay as they are."""
        dealt = rows.withColumn("bucket", self.bucket(key)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/v={batch}")
        before = self.index(batch - 1)
        after = {**before, **dict.fromkeys(touched, batch)}
        write_note(self.spark, f"{self.path}/index/v={batch}.json", sorted(after.items()))
        # What the batch before replaced is read by nothing any more.
        for b, v in self.index(batch - 2).items():
            if before[b] != v:
                discard(self.spark, self._folder(b, v))
        discard(self.spark, f"{self.path}/index/v={batch - 3}.json")
