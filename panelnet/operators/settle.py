"""Results written once where later steps read them again, and joins that no single key can hold up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many keys are joined apart from the others, by broadcast; a key is one only if it has more than an even share.
HOT_KEYS, HOT_ROWS = 1 << 16, 512
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a temporary folder serves, in local mode only: on a cluster executors
    would not see each other's files there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="panelnet-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/panelnet/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows does not depend on executors that made it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # noqa: SLF001
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            remove(df.sparkSession, path)


def settled(df: DataFrame) -> DataFrame:
    """df written with checkpoint() to spark.checkpoint.dir, the folder that all executors share.

    It cuts lineage, so that loops do not plan or compute a step twice and a lost executor costs no earlier step.
    In local mode without that setting a temporary folder serves.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="panelnet-"))
    return df.checkpoint()


def even_join(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with groups(key, n, ...), one row for each key with its number n of rows; n goes.

    Keys of more than total / HOT_KEYS rows are joined by broadcast: where the n add up to at most total, there are at
    most HOT_KEYS of them. The others are shuffled, and none of them is more than a small part of a task. rows is read
    twice, so it should be a table or cheap.
    """
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = groups.where(F.col("n") > most).drop("n")
    cold = groups.where(F.col("n") <= most).drop("n")
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(rows.join(few, key, "left_anti").join(cold, key))
