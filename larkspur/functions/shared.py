"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. On one machine a temporary one, if it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_larkspur_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext._larkspur_shared = own
    return own


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop's file system of a path, the path for it)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return bool(files.exists(where))


@dataclass
class Stored:
    """A table in the shared folder."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the files; the table must not be read afterwards."""
        files, where = file_system(self.df.sparkSession, self.path)
        files.delete(where, True)


def store(df: DataFrame, name: str) -> Stored:
    """Write a table to the shared folder and read it again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = Stored(spark.read.schema(df.schema).parquet(path), path)
    for kept in _OPEN:
        kept.append(made)
    return made


_OPEN: list[list[Stored]] = []


@contextmanager
def scratch() -> Iterator[list[Stored]]:
    """Delete, at the end, what was stored inside and is still in the list: for work whose result has been written by then."""
    kept: list[Stored] = []
    _OPEN.append(kept)
    try:
        yield kept
    finally:
        _OPEN.remove(kept)
        for made in kept:
            made.drop()


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, in which null equals null; the keys of the left side stay."""
    own = {k: f"_right_{k}" for k in keys}
    on: Column = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(own[k])) for k in keys])
    joined = left.join(right.withColumnsRenamed(own), on, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*own.values())


#: Tasks for each core, and bytes that a task gets at most while there are fewer tasks than shuffle partitions.
_TASKS, _TASK_BYTES = 3, 32 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly to all cores: a Parquet file of few row groups is read by as few tasks, however dear a row is."""
    spark = rows.sparkSession
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(_TASKS * spark.sparkContext.defaultParallelism, min(-(-size // _TASK_BYTES), most)))


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores behind as it takes to be none of the columns'."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
