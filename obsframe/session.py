"""Session settings and lineage cuts."""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", name: str = "obsframe") -> SparkSession:
    """Session for tests and the bench; on a cluster use the submitted one."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder named by ``spark.checkpoint.dir``.

    The folder is chosen here only where none is configured and the master is
    local; on a cluster a missing setting is an error, since a machine-local
    folder is lost with its executor.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="obsframe-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
