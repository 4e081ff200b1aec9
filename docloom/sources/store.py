"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where that is unset, a local session gets a folder of its own; a cluster's session is refused, as executors
    do not share the driver's folders.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


_scopes: list[list[str]] = []


@contextmanager
def dropped_after(spark: SparkSession):
    """Checkpoints that :func:`cut` makes inside go when the block ends: what was built on them must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept by a reliable checkpoint in the shared folder, so that what is built on it neither repeats nor replans it."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_base(df.sparkSession))
    done = df.checkpoint()
    if _scopes:
        made = done._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if made.isDefined():
            _scopes[-1].append(made.get())
    return done
