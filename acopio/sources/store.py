"""Tables that the library writes: versions of Parquet folders, laid out for the reads.

A version is complete once its _SUCCESS marker stands; readers take the newest complete one, so a lost
writer leaves the table as it was.
"""

from __future__ import annotations

import hashlib
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acopio.operators import upsert


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="acopio-store-")


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where it is unset (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_folder()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of the names, sizes and times of the files at a path: another one when the data changed."""
    p, fs = _fs(spark, path)
    files = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))
    return hashlib.md5(repr((path, files)).encode()).hexdigest()


class Store:
    """One table with its versions."""

    def __init__(self, spark: SparkSession, path: str, partition: str, cluster: tuple[str, ...], keys: tuple[str, ...]):
        self.spark, self.path, self.partition, self.cluster, self.keys = spark, path, partition, cluster, keys

    def versions(self) -> list[int]:
        p, fs = _fs(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        made = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return sorted(n for n in made if fs.exists(_fs(self.spark, f"{self.path}/v{n}/_SUCCESS")[0]))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.versions()[-1]}")

    def write(self, rows: DataFrame, files: int = 8) -> Store:
        """DT3: a folder a value of the partition column, rows clustered inside; a value's rows are dealt to ``files``
        writers, so that one large year isn't one task."""
        salt = F.pmod(F.xxhash64(*self.keys), F.lit(files))
        dealt = rows.repartition(F.col(self.partition), salt).sortWithinPartitions(self.partition, *self.cluster)
        dealt.write.partitionBy(self.partition).parquet(f"{self.path}/v{max(self.versions(), default=0) + 1}")
        return self

    def upsert(self, incoming: DataFrame) -> Store:
        """UPS1: the next version: incoming rows whole, the others as they were."""
        old = self.read()
        return self.write(upsert.upsert(old, incoming.select(*old.columns), list(self.keys)))

    def prune(self, keep: int = 1) -> None:
        """Versions but the newest ``keep`` go."""
        for n in self.versions()[:-keep]:
            p, fs = _fs(self.spark, f"{self.path}/v{n}")
            fs.delete(p, True)


def contracts(spark: SparkSession, path: str) -> Store:
    """Minor contracts, by year of publication, clustered by body."""
    return Store(spark, path, "publication_year", ("body", "publication_date", "source_id"), ("source_id",))
