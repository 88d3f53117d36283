"""What every operator needs of a session: a shared checkpoint folder and this package on the workers."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; set a folder only where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-checkpoint-"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillon-package-")) / "quillon.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._quillon_shipped = True


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ship_package(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the checkpoint files of staged frames that nothing will read again.

    Spark drops the shuffle files behind a staged frame once the driver's heap has
    been collected, so a collection is asked for: disks fill up long before the heap.
    """
    jvm = spark.sparkContext._jvm
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        if not plan.getClass().getSimpleName().startswith("LogicalRDD"):
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()  # plans held by unreachable Python objects
    jvm.System.gc()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place for a table under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
