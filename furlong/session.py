"""Session builder with the settings every plan in this library assumes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "furlong", master: str | None = None, **conf: str) -> SparkSession:
    """Return the running session, or build one with :data:`DEFAULTS` and ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share for cut lineage: the session's ``spark.checkpoint.dir``, or one that was set by hand.

    Where there is none, a temporary folder serves on a local master; on a cluster that is an error, as its machines share no such folder.
    """
    context = spark.sparkContext
    if base := spark.conf.get("spark.checkpoint.dir", None):
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(base)
        return base
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="furlong-")
    context.setCheckpointDir(base)
    return base
