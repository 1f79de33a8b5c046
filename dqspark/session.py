"""Sessions with the settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: UTC, so that dates mean the same everywhere; adaptive execution for sizes and skew.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "dqspark", **settings: str) -> SparkSession:
    """The running session, or a new one; further settings by name with dots as underscores doubled."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Lets Python workers that see this folder import the package from it, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; local sessions without one get a temporary folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="dqspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession) -> str:
    """A new path under dqspark/<application id> in the shared folder, which may be removed when the application has ended."""
    return f"{shared_dir(spark)}/dqspark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Removes all scratch paths of this application; tables that were read from them can no longer be."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/dqspark/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def put_file(spark: SparkSession, path: str, content: str | bytes) -> None:
    """Writes a small file on any file system of Spark's: aside first, then renamed, so that readers see all of it or nothing."""
    jvm = spark.sparkContext._jvm
    target, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.part"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"{path} could not be put in place")
