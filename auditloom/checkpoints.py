"""Cutting lineage in loops."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; an own one that goes at exit where that is unset and the master is local, as in
    tests. On a cluster the setting must be there: no folder of one machine would do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if named is None and not _own:
        _own.append(tempfile.mkdtemp(prefix="auditloom-checkpoints-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return named.rstrip("/") if named else f"file://{_own[0]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder, for rows that are read several times, some columns each time."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
