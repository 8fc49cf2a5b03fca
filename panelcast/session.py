"""Where intermediate tables go.

Everything panelcast writes on its own account (checkpoints, staged tables) goes
below the folder the cluster names in ``spark.checkpoint.dir``, which every
executor can reach.  A session that names none gets a folder of its own below the
warehouse, which Spark deletes when it ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from panelcast.sources.storage import remove

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/panelcast-{sc.applicationId}"
        if sc.getCheckpointDir() is None:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/panelcast/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A write made within leaves no shuffle files: they go when it ends.

    Otherwise they stay until the driver happens to collect its garbage, and a run of many
    writes holds the shuffles of all of them.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet below the shared folder and read it back.

    Used where a frame is read several times, or is wider than whole-stage
    codegen takes: what follows starts from a plain columnar scan.
    """
    path = staging_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A staged copy that is deleted at the end of the block; what is made of it must be written by then."""
    path = staging_path(df.sparkSession, name)
    try:
        with shuffles_removed(df.sparkSession):
            df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove(df.sparkSession, path)
