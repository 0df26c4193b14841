"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # pages can be large: few per Arrow batch
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # expressions here are built from many small calls; do not trace each of them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "*", app: str = "stallworks", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submit script makes it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see, named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests, a laptop) gets a folder of its
    own; on a cluster executors would not see it, so it has to be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="stallworks-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    The written table survives lost executors, keeps later plans short, lets
    them read only the columns they need, and has a known size, by which Spark
    decides on broadcasts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
