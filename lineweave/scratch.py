"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of this machine's own only where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lineweave.scratch", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):  # executors elsewhere can't read this machine's folders
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="lineweave-")
        spark.conf.set("lineweave.scratch", named)
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless their Python finds it where the driver's does."""
    root = str(Path(__file__).resolve().parent.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root or spark.conf.get("lineweave.shipped", None):
        return
    spark.conf.set("lineweave.shipped", "true")
    with tempfile.TemporaryDirectory() as folder:
        archive = shutil.make_archive(f"{folder}/lineweave", "zip", root, "lineweave")
        spark.sparkContext.addPyFile(shutil.copy(archive, f"{tempfile.mkdtemp(prefix='lineweave-')}/lineweave.zip"))


def cut(df: DataFrame, name: str, free: bool = True, codec: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: no lineage behind it, and a lost executor costs nothing.

    free: let Spark delete the shuffle files that only led to this table, which takes two collections of garbage; not
    worth it for small tables. codec: how the table is compressed, if not as the session says.
    """
    spark, schema = df.sparkSession, df.schema
    ship(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    del df
    for _ in range(2 * free):
        gc.collect()
        spark._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._lineweave_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing will read any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._lineweave_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
