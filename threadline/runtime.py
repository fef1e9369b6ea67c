"""Session settings and the shared scratch area every job relies on."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # A JSON object with a repeated key is legal input; the last value wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The JVM never compiles a method above 8,000 bytes of bytecode; such wide
    # generated stages run slower than the same operators without generation.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A staged bucket is one sorted file; aggregates by its key then need neither a shuffle nor a sort.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


# Scratch folders of local sessions that name none.
_local_roots: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on; safe to call repeatedly."""
    for key, value in _REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for staged tables, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would each see a different one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="threadline-")
    return _local_roots[app]


def new_run_dir(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage is cut and survives executor loss."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_alone(df: DataFrame, path: str) -> DataFrame:
    """``stage``, and the shuffle files of that write go as soon as it ends, not when the driver collects its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return stage(df, path)
    finally:
        conf.set(name, before)


def stage_bucketed(df: DataFrame, path: str, key: str, order: str, buckets: int) -> DataFrame:
    """Write ``df`` in ``buckets`` files by hash of ``key``, each sorted by (key, order), and read it back.

    One shuffle; whatever is grouped, joined or windowed by the key afterwards
    stays where it lies. A bucket is read by one task, so keys too large for
    that belong elsewhere.
    """
    spark = df.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
    dealt.bucketBy(buckets, key).sortBy(key, order).option("path", path).saveAsTable(name)
    return spark.table(name)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library staged and nothing reads any more; missing folders are fine."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_note(spark: SparkSession, path: str, value) -> None:
    """A small JSON value in a file of its own, written by the driver without a job."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()


def read_note(spark: SparkSession, path: str):
    return json.loads(spark.read.option("wholetext", "true").text(path).first()[0])
