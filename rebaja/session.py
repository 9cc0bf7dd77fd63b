"""Session settings and shared scratch tables."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_LOCAL_DIR: dict[str, str] = {}


def builder(app: str = "rebaja", cores: str = "*", shuffle_partitions: int | None = None):
    """Session builder with the settings the library relies on.

    Shuffle partitions stay at the cluster's value (AQE coalesces them); only
    local runs pass a small number.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if shuffle_partitions:
        b = (
            b.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.bindAddress", "127.0.0.1")
            .config("spark.driver.host", "127.0.0.1")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        )
    return b


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session with
    no such setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="rebaja-")
    return _LOCAL_DIR[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors and keeps columnar pruning and
    pushdown for the readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rebaja/{_RUN}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
