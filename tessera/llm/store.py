"""The folder that driver and executors share.

Lineage is cut by writing a table there: the files outlive any executor, unlike cached blocks or local checkpoints.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset on a local master (tests), a temporary folder that is set as such.
    With its scheme, so that tasks which write other formats than Spark's find the same place."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        root = spark.sparkContext.getCheckpointDir()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """df written as Parquet into the shared folder and read back with the schema it was written with. With `tidy`
    little disk is used: files are compressed by zstd, and the shuffle files of the write go as soon as it has ended; else they stay
    until the driver collects what refers to them."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.option("compression", "zstd") if tidy else df.write).parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def removed(*tables: DataFrame) -> None:
    """Deletes tables that saved() returned, once nothing reads them any more; a frame built on them can't be run after this."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            spark = table.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of df has, for columns that an operator adds and takes away again."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def draw(seed: int, *keys: str) -> Column:
    """A number from 0 to 1 that depends on the keys alone."""
    return F.xxhash64(*keys, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def drawn(rows: DataFrame, most: int, seed: int, *keys: str) -> DataFrame:
    """The `most` rows with the smallest draw(). Only about twice as many are sorted: the share that a count of the rows allows
    is taken first, so no task sends `most` rows of its own to the one that ends the sort."""
    share = min(1.0, 2.0 * most / max(rows.count(), 1))
    return rows.where(draw(seed, *keys) < share).orderBy(draw(seed, *keys), *keys).limit(most)
