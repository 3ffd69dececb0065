"""Writers of result tables, and the shared folder that intermediate ones go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where one machine is driver and executor at once."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="panelcast-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in reliable storage, without lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def round_trip(df: DataFrame, write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What read returns of the folder that write filled; the folder goes afterwards."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"
    write(df, path)
    try:
        return kept(read(spark, path))
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, in place of what was there, in folders by the columns by."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_parts(df: DataFrame, path: str, by: str) -> None:
    """Parquet in folders by one column (model, detector); only the folders that df has are replaced."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str, sep: str = ",") -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_json(df: DataFrame, path: str, key: str) -> None:
    """Rows as JSON lines: the key and everything else as one object, null fields left out."""
    rest = F.struct(*[c for c in df.columns if c != key])
    df.select(F.to_json(F.struct(key, rest.alias("value"))).alias("value")).write.mode("overwrite").text(path)
