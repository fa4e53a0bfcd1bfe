"""Tables in the shared folder: they cut the lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session that names none gets a temporary one; on a cluster executors would not see each other's."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """The shared folder as a path of the file system, for files that Spark's own writers do not make."""
    named = shared_dir(spark)
    if ":" in named and not named.startswith("file:"):
        raise RuntimeError(f"{named} is no folder of the file system")
    return "/" + named.removeprefix("file:").lstrip("/")


def written(df: DataFrame, name: str, narrow: bool = False, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs nothing of it.

    The table goes when the driver ends. narrow: rows are short and cheap to make, so there
    are no more files than the cluster has cores; each costs its executor processes for the
    file's rights where Hadoop's native library is missing. codec: another compression than the session's.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)
