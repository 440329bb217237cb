"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The list that new Scratch folders of this thread (or task) are entered in; None: they are nobody's to delete.
_OWNER: ContextVar[list[Scratch] | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session, whose executors are the driver, may do without:
    it gets a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder under one unique name; drop() deletes them.

    A written table cuts lineage: losing an executor never recomputes what stands before it.
    Whoever runs an operator within recording() or settled() owns its folders.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        owner = _OWNER.get()
        if owner is not None:
            owner.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """As write(), in a catalogue table bucketed by key, so that joins on it do not move its rows."""
        table = f"scratch_{uuid.uuid4().hex}"
        self.tables.append(table)
        df.write.bucketBy(buckets, key).option("path", f"{self.root}/{name}").option("compression", "zstd").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all of them and the folder."""
        while not name and self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def recording() -> Iterator[list[Scratch]]:
    """The folders made inside; they are deleted at the end, so what is to stay must have been written elsewhere."""
    made: list[Scratch] = []
    before = _OWNER.set(made)
    try:
        yield made
    finally:
        _OWNER.reset(before)
        for scratch in made:
            scratch.drop()


def _keep(df: DataFrame, label: str) -> tuple[DataFrame, Scratch]:
    before = _OWNER.set(None)
    try:
        own = Scratch(df.sparkSession, label)
        return own.write(df, "result"), own
    finally:
        _OWNER.reset(before)


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns. If it used scratch tables, its result is written as the one table that stays."""
    with recording() as made:
        df = make()
        return _keep(df, label)[0] if made else df


def written(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, Scratch]:
    """What make() returns, written and read again, and its folder; scratch tables made on the way are deleted."""
    with recording():
        return _keep(make(), label)


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
