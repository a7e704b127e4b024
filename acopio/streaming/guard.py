"""ST7: one importer at a time, by a marker in the shared folder and the liveness of its run."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Guard:
    """A marker file that only one process can create.  A marker whose holder has not renewed it for
    ``stale`` seconds is taken over, as a run that has not advanced reads as abandoned."""

    def __init__(self, spark: SparkSession, path: str, stale: float = 900.0, clock: Callable[[], float] = time.time):
        self.path, self.stale, self.clock, self.mine = path, stale, clock, False
        self.at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _age(self) -> float:
        return self.clock() - self.fs.getFileStatus(self.at).getModificationTime() / 1000

    def _create(self) -> bool:
        """Only one of several processes gets the file: creation fails where it is there."""
        try:
            self.fs.create(self.at, False).close()
        except Py4JJavaError:
            if not self.fs.exists(self.at):
                raise
            return False
        return True

    def acquire(self) -> bool:
        """Whether this process may write now."""
        self.mine = self._create()
        if not self.mine and self._age() > self.stale:
            self.fs.delete(self.at, False)
            self.mine = self._create()
        self.renew()
        return self.mine

    def renew(self) -> None:
        """Progress: the marker is as of now."""
        if self.mine:
            self.fs.setTimes(self.at, int(self.clock() * 1000), -1)

    def release(self) -> None:
        if self.mine:
            self.fs.delete(self.at, False)
            self.mine = False
