"""Reading the tables of a data folder, and staging intermediate ones.

Intermediate results that a later stage reads more than once are written as Parquet
into the folder named by ``spark.checkpoint.dir``. All executors share it, so losing an
executor costs a re-read and not a recomputation, and the files are compressed and
column-pruned, which an RDD checkpoint is not.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``, cut down to ``columns`` if any are named."""
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    The session's ``spark.checkpoint.dir`` holds; a folder of our own is set only where
    the session names none and all of it runs on one machine. A cluster without the
    setting is refused, as its executors share no such folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tarnfall-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it as read from there.

    Cuts the lineage. The files are removed when the driver's interpreter ends, or by
    :func:`drop_staged` once the results that were made of them are written.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/staged-{uuid.uuid4().hex}"
    out = snapshot(df, path)
    if not _staged:
        atexit.register(drop_staged)
    _staged.append(path)
    return out


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet to ``path``, in place of what is there, and return it as read from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged() -> None:
    """Remove all staged tables; results that aren't written yet can't be read any more."""
    spark = SparkSession.getActiveSession()
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _staged:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session is gone: its folder's owner cleans up
        pass
    _staged.clear()
