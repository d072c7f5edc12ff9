"""Session helpers: table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def local_session(app: str = "foliant", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    return SparkSession.builder.master(f"local[{n}]").appName(app).config(map=base | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; checkpoints are set up in it.

    Only where that is unset, as in tests on one machine, a temporary folder is taken; on a cluster an unset
    folder is an error, since files on one machine would not survive the loss of an executor.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="foliant-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


RELEASE_S = 5.0
_released = 0.0


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and broadcasts of plans that are no longer referenced.

    It learns of them only when the driver collects its garbage, which in a job of many short plans may be long after.
    Not more often than every RELEASE_S seconds.
    """
    global _released
    if time.monotonic() - _released < RELEASE_S:
        return
    _released = time.monotonic()
    gc.collect()
    spark._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    _release(df.sparkSession)
    return kept


def successive(start: DataFrame, step: Callable[[DataFrame], DataFrame], ended: Callable[[DataFrame], bool]) -> DataFrame:
    """``step`` applied to ``start`` again and again until ``ended``.

    Each state is a table in the shared folder, and the one before it is deleted once it is written.
    """
    spark = start.sparkSession
    folder = f"{shared_folder(spark)}/successive-{uuid.uuid4().hex}"

    def written(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        _release(spark)
        return spark.read.schema(df.schema).parquet(f"{folder}/{k}")

    state, k = written(start, 0), 0
    while not ended(state):
        k += 1
        state = written(step(state), k)
    return state
