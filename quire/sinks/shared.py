"""Tables that queries write for themselves, in a folder that the driver and every executor see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

#: Stages that nothing has dropped yet: they go when the driver ends.
_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    A single-process session without that setting gets a temporary folder, removed
    at exit.  Any other session without it is refused: no other folder is known to
    be shared (the warehouse's default is the driver's own disk).
    """
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + (path := tempfile.mkdtemp(prefix="quire-"))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def drop(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        _LEFT.pop(p, None)
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_left() -> None:
    for path, spark in list(_LEFT.items()):
        with suppress(Exception):  # the session may have ended before
            drop(spark, [path])


atexit.register(_drop_left)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table or folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
