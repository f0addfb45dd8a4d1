"""Tables written on the way to a result: where they go, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that ``written`` returned, as long as those are in use.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's ``spark.checkpoint.dir``, or the checkpoint folder of the context.

    A local session that has neither gets a new folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="verbatim-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors. ``codec`` compresses otherwise than the session."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote; nothing may read these tables any more."""
    for df in tables:
        path = _folders.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            java = context._jvm.org.apache.hadoop.fs.Path(path)
            java.getFileSystem(context._jsc.hadoopConfiguration()).delete(java, True)
