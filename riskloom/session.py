"""Session set-up and the shared folder used to cut lineage or stage results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides any of them.

    Without ``master`` the one given to spark-submit is used.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back
    to a folder of its own; on a cluster an unset folder is an error, because a
    machine-local one would be lost with its executor.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="riskloom-", dir=os.environ.get("TMPDIR"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back without its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def staging_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def split_count(spark: SparkSession, floor: int = 8, ceiling: int = 4096) -> int:
    """How many ordered slices to cut a column into: as many as there are shuffle tasks."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(floor, min(ceiling, partitions))
