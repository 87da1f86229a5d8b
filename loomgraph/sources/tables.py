"""Readers of the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; `name`.parquet is a file or a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """One table of a data folder as a stream of its files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    is_folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, folder, name).schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}.parquet") if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
