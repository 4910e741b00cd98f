"""Where intermediate tables go: the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset a temporary one is set, but only if driver and executors
    are one process; on a cluster that is an error.
    """
    context = spark.sparkContext
    place = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="lemmaforge-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
        place = context.getCheckpointDir()
    return place


#: Folders that this process has named and not deleted.
_named: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _named.add(path)
    return path


#: Shuffle partitions that make one file of a table of a few bytes for each document.
SMALL_SHARE = 16


def keep(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and any executor can be lost.

    A ``small`` table, of a few bytes for each document, goes to a
    SMALL_SHARE-th of the shuffle's partitions: fewer files, made in parallel still.
    """
    path = new_path(df.sparkSession, name)
    if small:
        df = df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SMALL_SHARE))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    _named.discard(path)


def drop(*kept: DataFrame) -> None:
    """Delete tables of ``keep`` from which nothing that is still to be computed reads."""
    for df in kept:
        _delete(df.sparkSession, df.kept_at)


def clear(spark: SparkSession) -> int:
    """Delete every folder that this process has named and not deleted yet, and say how many.

    A result is read from such folders when it is computed: call this once all
    results are written or collected.
    """
    left = list(_named)
    for path in left:
        _delete(spark, path)
    return len(left)
