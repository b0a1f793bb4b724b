"""Work tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}
#: Paths of the work tables of this process, so that ``release`` finds them.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one, else (one machine only) a folder of our own that goes when
    the process ends. Off a local master an unset folder is an error: executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="maskflow-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


def work_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path in the shared folder; ``release`` deletes it."""
    path = os.path.join(shared_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes all work tables that this process has written so far, and says how many. For callers whose results are
    consumed or written elsewhere: frames that are still lazy lose what they would read."""
    paths = _WRITTEN[:]
    del _WRITTEN[:]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if its scan has fewer partitions than those: a few small files, or one row group.

    Inputs with a partition for each core, as any large one has, are left where they are: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows and bytes up to which a table is broadcast by ``fitted``; beyond either, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20


def fitted(df: DataFrame) -> DataFrame:
    """``df``, a work table, with a broadcast hint if it is small. Rows and bytes (as JSON, no less than the values take)
    are counted over all of it, so few rows with very many spans aren't sent whole to every executor."""
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).cast("long")
    rows, held = df.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else df
