"""A session with the settings that the operators expect."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "casestream", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return (builder.master(master) if master else builder).getOrCreate()


#: Folders of this machine by application, where spark.checkpoint.dir is absent.
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the one that the cluster names in spark.checkpoint.dir; under a
    folder of this machine only where the setting is absent (local mode, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="casestream-")
        atexit.register(shutil.rmtree, found, True)
    return f"{found.rstrip('/')}/casestream/{label}-{uuid.uuid4().hex}"
