"""Observation files: tolerant reading of JSON lines, and appending to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_lines(lines: DataFrame, schema: str, *also: str) -> DataFrame:
    """Rows of JSON objects in column ``value``, with the columns ``also`` as they are. Blank and broken lines and other JSON values are skipped; a field that
    is missing or can't be read as its type is null, and "0.25" reads as a number."""
    fields = T.StructType.fromDDL(schema).fields if hasattr(T.StructType, "fromDDL") else lines.sparkSession.createDataFrame([], schema).schema.fields
    parsed = lines.select(*also, F.try_parse_json(F.trim("value")).alias("v")).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    return parsed.select(*also, *[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields])


def _file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them, for any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_lines(spark.read.text(path), schema)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
