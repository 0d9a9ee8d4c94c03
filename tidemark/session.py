"""Session defaults, and the folder that all executors share.

A cluster brings its own session; nothing here overrides what it already set.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, unless they have it on their path."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="tidemark-package-")
    context.addPyFile(shutil.make_archive(f"{folder}/tidemark", "zip", ROOT, "tidemark"))
    _SHIPPED.add(context.applicationId)


def local_session(cores: int = 8, app: str = "tidemark") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    # Workers inherit it, whatever folder the session is started in.
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([str(ROOT), *filter(None, paths)]))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "localhost")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session in local mode, which has no other machines, may leave the
    setting out; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """Rows written once to the shared folder, for plans that read them several times.

    What ``df`` comes from runs once, when this is called.
    """
    path = f"{shared_folder(df.sparkSession)}/staged-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
