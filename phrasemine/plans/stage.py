"""Tables that a later part of a job reads more than once.

A staged table is written as Parquet to the folder the cluster shares for
checkpoints, so it survives the loss of executors, carries sizes that the
planner can trust, and is read with column pruning and filter pushdown.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


@cache
def local_root() -> str:
    """A folder for a local master whose session names none, removed when the driver ends."""
    folder = tempfile.mkdtemp(prefix="phrasemine-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_root(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, which must be set unless driver and tasks are one process."""
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    return local_root()


def stage_by_key(
    df: DataFrame, name: str, keys: Sequence[str], compression: str = "snappy", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` once, in as many buckets of ``keys`` as there are shuffle partitions, and return the written table.

    Joins and groupings on exactly these columns read it where it lies, without an
    exchange. Its name is known to this session alone; the files are in the shared folder.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    path = f"{checkpoint_root(spark)}/phrasemine/{mark}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = df.write.format("parquet").option("compression", compression).bucketBy(buckets, *keys)
    if partition_by:
        written = written.partitionBy(*partition_by)
    written.option("path", path).saveAsTable(f"phrasemine_{name}_{mark}")
    return spark.table(f"phrasemine_{name}_{mark}").select(*df.columns)


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = (), compression: str = "snappy") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/phrasemine/{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
