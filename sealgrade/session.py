"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sealgrade", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings results depend on (UTC) and AQE on.

    Sizing (executors, memory, shuffle partitions) is left to the cluster; pass
    it as keyword arguments with ``__`` for ``.``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # recording the Python call site of each expression costs more than the
        # planning of the large projections here
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only where that is unset and
    Spark runs in local mode.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="sealgrade-")
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, "sealgrade", uuid.uuid4().hex)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage in a way that outlives lost executors, gives the optimiser real
    sizes, and freezes values that must not change between two uses.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this program wrote, wherever it lies; nothing happens if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
