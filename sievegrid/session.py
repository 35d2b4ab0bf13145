"""Session settings that every query shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

_SHARED = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode, where all is one machine."""
    root = spark.conf.get(_SHARED, None) or spark.sparkContext.getConf().get(_SHARED, None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {_SHARED} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="sievegrid-")
            atexit.register(shutil.rmtree, _own[app].removeprefix("file://"), True)
        root = _own[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several steps read once, and return it as read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the session was started.

    On a cluster the package comes with ``--py-files`` or an installed wheel; this path then
    merely doesn't exist on the executors.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (env.get("PYTHONPATH", ""), ROOT)))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
