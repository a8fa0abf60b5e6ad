"""Tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that shuffle files go when the action that wrote them ends; else they stay until the driver's JVM happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A group is hot if it holds more than this part of all rows; there are at most as many hot groups.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may do without: it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there, and its shuffle files go."""
    path = new_path(df.sparkSession, name)
    with cleared(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the folder of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``groups`` (one row a key, with its number of rows ``size``; of ``total``), however large a group is.

    At most ``HOT`` groups can hold more than total / HOT rows each: these are broadcast, so that no task
    gathers the rows of one; the others are joined by a shuffle.
    """
    hot = F.col(size) * HOT > total
    few = F.broadcast(groups.where(hot))
    own = [f"{c}" for c in rows.columns]
    found = rows.join(few, key)
    rest = rows.join(few.select(key), key, "left_anti").join(groups.where(~hot), key, "left")
    columns = own + [c for c in groups.columns if c not in own]
    return found.select(columns).unionAll(rest.select(columns))
