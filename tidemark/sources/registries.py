"""Registers as JSON files: read whole, and rewritten as a new version that takes the place of the old at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def loaded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that each hold a list of records, or one; fields that a record lacks are null, other fields are left out. A file that is no JSON is an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def keyed(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, the fields of the record) of JSON files that each hold one object from key to record."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias("key", "r")).select("key", "r.*")


def _pointer(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/current.txt")
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The version of the register at ``path`` that holds; empty where there is none."""
    pointer, fs = _pointer(spark, path)
    if not fs.exists(pointer):
        return spark.createDataFrame([], schema)
    name = spark.read.text(pointer.toString()).first()[0]
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/{name}")


def rewritten(rows: DataFrame, path: str) -> str:
    """Write ``rows`` as a new version, one record a line, then point to it: readers have the old version or the new one, never a part. The version's name."""
    spark, name = rows.sparkSession, f"v-{uuid.uuid4().hex}"
    rows.write.option("ignoreNullFields", "false").json(f"{path.rstrip('/')}/{name}")
    pointer, fs = _pointer(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/next-{name}")
    out = fs.create(beside, True)
    out.write(bytearray(name.encode()))
    out.close()
    fs.delete(pointer, False)
    fs.rename(beside, pointer)
    return name
