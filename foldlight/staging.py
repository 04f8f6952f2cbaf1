"""Results written to the cluster's shared folder and read back: lineage is cut, lost executors cost one step."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_STAGING = "/tmp/checkpoints/foldlight"

#: Staged tables of this application, with the file systems that hold them; results may read them until it ends.
_staged: dict[str, tuple] = {}


@atexit.register
def _clean_up() -> None:
    for path, (where, system) in list(_staged.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            system.delete(where, True)
            del _staged[path]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode, where it is unset."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_STAGING


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder for a table of this application; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _staged[path] = where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path


def staged(df: DataFrame, what: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back.

    Rows of the written table never change, so results that read it several times agree.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again: what came of them is staged itself."""
    for df in tables:
        where, system = _staged.pop(df.staged_path)
        system.delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referenced."""
    spark.sparkContext._jvm.System.gc()
