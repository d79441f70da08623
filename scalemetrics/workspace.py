"""Where intermediate tables go, and sessions for local runs.

Intermediate results are written tables in the folder the cluster names in
``spark.checkpoint.dir``; a private temporary folder is used only on a local
master that has none.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: dict[tuple[str, str], str] = {}

# Fixed value: the JVM never compiles a method of more bytes, it interprets it.
COMPILED_BYTES = 8000
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def local_session(app: str, cores: str = "8", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, one subfolder per application."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="scalemetrics-"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{sc.applicationId}"


def compiled_stages(spark: SparkSession) -> None:
    """Let Spark run operator by operator what would be one method too long to be compiled; a limit set by the session stays if lower."""
    if int(spark.conf.get(METHOD_LIMIT)) > COMPILED_BYTES:
        spark.conf.set(METHOD_LIMIT, str(COMPILED_BYTES))


def written(spark: SparkSession, key: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
    """Build a table once per application, write it as Parquet and read it back."""
    compiled_stages(spark)
    app_key = (spark.sparkContext.applicationId, key)
    if app_key not in _written:
        path = f"{shared_dir(spark)}/{hashlib.md5(key.encode()).hexdigest()}"
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        _written[app_key] = path
    return spark.read.parquet(_written[app_key])


def settle(df: DataFrame) -> DataFrame:
    """Write a small intermediate table and read it back.

    Later uses scan the file instead of recomputing the plan, and its size is
    known, so Spark broadcasts it exactly when it is small enough.
    """
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
