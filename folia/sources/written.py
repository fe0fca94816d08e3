"""Tables written to the folder that all executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def path_of(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that isn't set and the session is local, in a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, kind: str = "parquet", by: list[str] | None = None) -> DataFrame:
    """`df` written once and read by its schema."""
    path = path_of(df.sparkSession, name)
    df.write.format(kind).partitionBy(*(by or [])).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).load(path)


_made: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, folder: str, name: str, kind: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` has written of the table `name` of a folder: by this session, from the table as it is now, and still there; else written anew."""
    files = spark._jvm.org.apache.hadoop.fs

    def status(path: str):
        own = files.Path(path)
        return own.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(own)

    key = (spark.sparkContext.applicationId, folder, name, kind, status(f"{folder}/{name}.parquet").getModificationTime())
    if key in _made:
        try:
            status(_made[key].inputFiles()[0])
            return _made[key]
        except Exception:  # noqa: BLE001  the shared folder has been cleared
            del _made[key]
    _made[key] = build()
    return _made[key]
