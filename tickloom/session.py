"""Session helpers: sane defaults for a new session, scratch space of a running one."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tickloom", **conf) -> SparkSession:
    """Session with adaptive execution on and the UTC clock every operator assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names for checkpoints.

    Where none is set, a local master gets a folder of its own, removed at exit; on a cluster
    executors would each write to their own disk, so that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"tickloom-{context.applicationId}")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return named


#: scratch folders handed out by this process, oldest first
SCRATCH: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """New path below the shared folder, never reused."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    SCRATCH.append(path)
    return path


def remove_scratch(spark: SparkSession, paths: list[str], keep=None) -> None:
    """Delete scratch folders that nothing reads any more; those that ``keep`` reads stay."""
    read = [f.split(":", 1)[-1].lstrip("/") for f in keep.inputFiles()] if keep is not None else []
    for path in paths:
        plain = path.split(":", 1)[-1].lstrip("/") + "/"
        if path in SCRATCH and not any(f.startswith(plain) for f in read):
            SCRATCH.remove(path)
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df, label: str = "table"):
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the plan for results used more than once; survives lost executors.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
