"""Small pieces that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["Scratch", "drop_tables", "fold_of", "fresh", "settle", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as the empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))) % folds


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many underscores behind it as it takes to be no column's, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local session may do without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(folder or "/tmp/loomspan-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the shared folder once and read them from there."""
    return _written(df)[1]


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that an operator or a stage wrote."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """An operator's intermediate tables and broadcasts: given back on leaving, but for the tables that its result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.shared = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def settle(self, df: DataFrame) -> DataFrame:
        """A table that is deleted on leaving."""
        path, out = _written(df)
        self.paths.append(path)
        return out

    def broadcast(self, value):
        """A broadcast that executors forget on leaving."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def __exit__(self, *_) -> None:
        drop_tables(self.spark, self.paths)
        for one in self.shared:
            one.unpersist()
