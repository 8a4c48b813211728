"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Folders made for local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may do without and gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="tessera-"))
    return found.rstrip("/")


def stored(df: DataFrame) -> tuple[str, StructType]:
    """Write a table to the shared folder: its path and schema."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.schema


def written(df: DataFrame) -> DataFrame:
    """The table written once and read back: cuts lineage, survives lost executors and is computed once however often it is read."""
    path, schema = stored(df)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a step's table and reads it back; all its tables go when the block is left.

    A table read back has a known size, so that small sides of later joins are broadcast. What the block returns must be ``written`` in it.
    """
    path = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"

    def step(df: DataFrame) -> DataFrame:
        one = f"{path}/{uuid.uuid4().hex}"
        df.write.parquet(one)
        return spark.read.schema(df.schema).parquet(one)

    try:
        yield step
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
