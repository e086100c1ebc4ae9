"""Folders that driver and executors share, and files that name the present version of what lies in them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, or in local mode under a temporary one; it goes when the driver ends."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="lumenloom-")
    out = f"{top.rstrip('/')}/lumenloom/{label}-{uuid.uuid4().hex}"
    path, fs = _path(spark, out)
    fs.deleteOnExit(path)
    return out


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to a shared folder and read back: computed once, and outliving any executor."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, name: str) -> str | None:
    """The text of a pointer file, null if there is none."""
    path, fs = _path(spark, name)
    return spark.read.text(name, wholetext=True).first()[0].strip() if fs.exists(path) else None


def move_pointer(spark: SparkSession, name: str, text: str) -> None:
    """A new text for a pointer file, by a rename that replaces the old one in one step."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pointer, fs = _path(spark, name)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{name}.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), hadoop)
    context.rename(fs.makeQualified(temporary), fs.makeQualified(pointer), options)


def remove(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def names_below(spark: SparkSession, name: str) -> list[str]:
    path, fs = _path(spark, name)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def numbers_below(spark: SparkSession, name: str, prefix: str) -> list[int]:
    """The numbers n of the folders `prefix`n."""
    return sorted(int(x.removeprefix(prefix)) for x in names_below(spark, name) if x.startswith(prefix))
