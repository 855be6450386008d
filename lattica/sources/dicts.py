"""Dictionary files beside block files: a line code=value for each name, property string or namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.props import as_map

_LINE, _REVERSED = r"^\s*(\d+)=(.*?)\s*$", r"^\s*(.*)=(\d+)\s*$"


def read_dictionary(spark: SparkSession, path: str, code: str = "id", value: str = "name", reverse: bool = False) -> DataFrame:
    """(code, value) of a file's lines code=value; older files have value=code (reverse). Other lines drop out."""
    lines = spark.read.text(path)
    pattern, first, second = (_REVERSED, 2, 1) if reverse else (_LINE, 1, 2)
    part = lambda k: F.regexp_extract("value", pattern, k)
    return lines.where(F.col("value").rlike(pattern)).select(part(first).cast("int").alias(code), part(second).alias(value))


def malformed(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    """(value): lines that are neither entries nor empty."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(~F.col("value").rlike(_REVERSED if reverse else _LINE))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """(prop, raw, properties): property strings with their maps; the string None is the empty map."""
    return read_dictionary(spark, path, "prop", "raw").withColumn("properties", as_map(F.col("raw")))


def write_dictionary(rows: DataFrame, folder: str, code: str = "id", value: str = "name") -> None:
    """Writes lines code=value in the order of the codes. Dictionaries hold a row per distinct value, so one file will do."""
    line = F.concat_ws("=", F.col(code), F.col(value)).alias("line")
    rows.repartition(1).sortWithinPartitions(code).select(line).write.text(folder)
