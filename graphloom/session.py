"""Session-level helpers: where shared files go and how lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.errors import ValidationError

#: Scratch tables of this process that haven't been removed.
_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    The cluster names it; a folder of our own is set only where the session names none and runs on
    one machine (tests). Elsewhere a missing setting is an error, as executors share no local folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValidationError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made.

    A lost executor can't take the result with it, and plans of iterative operators stay short.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_step(df: DataFrame) -> DataFrame:
    """``cut`` for the steps of a loop.

    A checkpoint remembers the constraints its plan implied; joined round after round they multiply
    until planning takes longer than running. Here the result starts from the bare rows.
    """
    spark = df.sparkSession
    kept = cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffles, broadcasts and (where the session says so) checkpoints that
    nothing refers to any more; it learns of them only when the driver collects its garbage, which a
    query of many short jobs may not do until the driver's memory is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that one query writes and reads again."""
    _SCRATCH.append(f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables written so far, to be called once their results are stored or read;
    returns their number."""
    jvm, paths = spark.sparkContext._jvm, list(_SCRATCH)
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        _SCRATCH.remove(path)
    return len(paths)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the provided parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
