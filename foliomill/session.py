"""Session helpers shared by every stage: table reading and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def _importable_by_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, whatever folder they start in."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _importable_by_workers(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint directory; only in local mode, as in tests, one of this machine."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="foliomill-")  # one machine is all there is
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Like ``checkpoint()`` this cuts the lineage and survives the loss of executors, but the copy is columnar,
    compressed and can be read with pruned columns.  The shuffle files of the writing go with it, since nothing reads
    them again; the copy is deleted when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, hash_column: str, most: int, total: int) -> DataFrame:
    """`most` of `total` rows, those with the smallest hashes; about as many more leave their tasks, whatever the input's size."""
    if total <= most:
        return df
    share = min(1.0, (1.1 * most + 1000) / total)
    place = F.col(hash_column) / float(2**63)  # even between -1 and 1
    return df.where((place + 1) / 2 < share).orderBy(hash_column).limit(most)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is already gone
        pass
