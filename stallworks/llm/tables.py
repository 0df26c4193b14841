"""Written intermediate tables and row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallworks.session import shared_folder

#: shuffle files of a finished write are of no more use: the written table replaces them
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that one operator writes into the shared folder and may drop again.

    A written table survives lost executors and cuts the lineage; a table may be
    dropped as soon as everything made from it has itself been written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.names = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.names += 1
        path = f"{self.root}/{self.names}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(conf).delete(path, True)


def unique_ids(df: DataFrame, column: str) -> bool:
    """Whether the column is a whole number, never null and never repeated."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        return False
    ids = df.select(F.col(column).alias("id"))
    odd = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").limit(1)
    return not odd.take(1)


def keyed(scratch: Scratch, df: DataFrame) -> DataFrame:
    """Adds ``row``, a long that names each row, stays the same in every later read and follows the order of the ids.

    ``df`` has a column ``id``.  Unique whole-number ids are their own keys;
    otherwise the table is written once, sorted by id (nulls last), with
    generated keys.
    """
    if unique_ids(df, "id"):
        return df.withColumn("row", F.col("id").cast("long"))
    ordered = df.orderBy(F.col("id").isNull(), F.col("id"))
    return scratch.write(ordered.withColumn("row", F.monotonically_increasing_id()))
