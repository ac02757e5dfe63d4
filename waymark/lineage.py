"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir`` or checkpoint folder; a temporary folder only in a local session, where it is shared."""
    context = spark.sparkContext
    if configured := context.getConf().get("spark.checkpoint.dir"):
        return configured
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="waymark-shared-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint, so that a lost executor costs no recomputation of what led to it."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def children(spark: SparkSession, folder: str) -> list[str]:
    """The names of what a folder holds."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [status.getPath().getName() for status in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it over the old one, so that a reader sees either."""
    hadoop = spark._jvm.org.apache.hadoop
    conf, aside, place = spark._jsc.hadoopConfiguration(), hadoop.fs.Path(f"{path}.{uuid4().hex}"), hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).create(aside, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    overwrite = spark._jvm.java.lang.reflect.Array.newInstance(hadoop.fs.Options.Rename.OVERWRITE.getClass(), 1)
    overwrite[0] = hadoop.fs.Options.Rename.OVERWRITE
    files = hadoop.fs.FileContext.getFileContext(place.getFileSystem(conf).makeQualified(place).toUri(), conf)
    files.rename(aside, place, overwrite)
