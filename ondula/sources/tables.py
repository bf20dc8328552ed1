"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast up to so many bytes, counting those that a row takes besides its values.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's folder; a temporary one only where neither is set and one machine runs all."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ondula-tables-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def write(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of df as a written table: lineage ends here, and an executor that is lost takes nothing with it."""
    path = f"{folder or shared_dir(df.sparkSession)}/ondula-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """``with Folder(spark) as steps``: tables written by ``steps.write``, deleted when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/ondula-{uuid.uuid4().hex}"

    def __enter__(self) -> Folder:
        return self

    def write(self, df: DataFrame) -> DataFrame:
        return write(df, self.path)

    def __exit__(self, *_: object) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
