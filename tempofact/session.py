"""Session settings and the one place where intermediate tables are cut to storage that all executors share."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship(module: str) -> None:
    """Send the functions of ``module`` to executors by value, so that they need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def build(app: str = "tempofact", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution, UTC and legacy-free settings; ``conf`` overrides (dots as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the texts that one Arrow batch holds in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tempofact_dir", None)
    if not set_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = f"file://{tempfile.mkdtemp(prefix='tempofact-')}"
        sc.setCheckpointDir(set_dir)
        sc._tempofact_dir = set_dir
    return set_dir.rstrip("/")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back: lineage ends there, sizes are known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tempofact/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
