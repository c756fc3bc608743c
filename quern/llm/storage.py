"""Intermediate tables that survive the loss of executors.

Lineage is cut by writing Parquet under the folder the session names in
``spark.checkpoint.dir``; a temporary folder is used only where that setting
and the context's checkpoint directory are both unset and all of Spark runs in
this process, as in tests.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: its shuffle files go as soon as it is there; joins may hash a side that the run itself has measured to be small in every partition.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m"}
#: Of a folder on a local path: no checksum files. For each file it makes, and so for each checksum file, Hadoop starts a process (chmod), which for a moment has all of the executor's memory as its own.
UNCHECKED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Rows of whole texts that Python gets at once.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return named


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on gives Python at most BATCH_ROWS rows at once: results that are handed back run when their reader wants, under the session's setting then."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.options(**UNCHECKED).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.quern_path = path
    return out


def _path(df: DataFrame):
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.quern_path)
    return path, path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def if_small(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """A table of :func:`materialize`, hinted as the side that a join hashes if its files have at most ``most`` bytes for each shuffle partition."""
    path, store = _path(df)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if store.getContentSummary(path).getLength() <= most * parts else df


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and nothing lazy reads any more."""
    for df in frames:
        path, store = _path(df)
        store.delete(path, True)
