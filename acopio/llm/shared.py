"""What the operators of this subpackage share: the folder that all executors see,
written intermediate tables, and slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one slice of a batch holds at most (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        found = tempfile.mkdtemp(prefix="acopio-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Whole texts are read and travel to Python in batches of at most ``rows`` rows from now on in this
    session: a batch is held by both sides, so it counts several times against an executor."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= rows:
            spark.conf.set(key, str(rows))


def release() -> None:
    """Give freed memory back to the system: workers are kept between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


class Table:
    """A table written to the shared folder, and read again from there."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _at(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._at()
        return fs.exists(p)

    def drop(self) -> None:
        fs, p = self._at()
        fs.delete(p, True)


def written(df: DataFrame, codec: str = "zstd") -> Table:
    """Write df to the shared folder: cuts its lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/acopio-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return Table(spark, path, df.schema)


def written_apart(df: DataFrame, column: str, values: tuple[str, ...], codec: str = "zstd") -> dict[str, Table]:
    """``written``, with a table for each value of a column, so that each can be dropped on its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/acopio-{uuid.uuid4().hex}"
    df.write.option("compression", codec).partitionBy(column).parquet(path)
    rest = df.drop(column)
    found = {}
    for v in values:
        found[v] = Table(spark, f"{path}/{column}={v}", rest.schema)
        if not found[v].exists():  # no such row
            spark.createDataFrame([], rest.schema).write.parquet(found[v].path)
    return found


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that are no longer referenced: its cleaner
    works once the driver has collected them, in the background."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.6)


def pressed(things: tuple) -> bytes:
    """Arrays and bytes as one compressed value."""
    raw = pickle.dumps(things, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(value) -> tuple:
    """What ``pressed`` made, from an Arrow scalar or bytes."""
    data = memoryview(value.as_py() if isinstance(value, pa.Scalar) else value)
    return pickle.loads(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def buckets(spark: SparkSession) -> int:
    """Groups that packed rows are dealt to: as many as the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column is called so."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def text_slices(batches, text: str, most: int = SLICE_BYTES):
    """(batch, texts) for slices of up to ``most`` bytes of text."""
    for batch in batches:
        if not isinstance(batch, pa.RecordBatch):
            batch = pa.RecordBatch.from_pandas(batch)
        column = batch.column(text)
        at, n = 0, batch.num_rows
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        while at < n:
            end, total = at, 0
            while end < n and (end == at or total + sizes[end] <= most):
                total += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, part.column(text).to_pylist()
            at = end


def crc_mod(column: str, n: int):
    """crc32 of an id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(n)


def add_columns(df: DataFrame, text: str, new: list[tuple[str, str]], maker, drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns of df (but ``drop`` and those replaced), then the ``new`` (name, type) ones.

    ``maker()`` is called once a task and gives a function from a list of texts (null: empty)
    to one array per new column.  Columns travel by position, so any names will do.
    """
    gone = {n for n, _ in new} | set(drop)
    at = [k for k, c in enumerate(df.columns) if c not in gone]
    names = [df.columns[k] for k in at]
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    source = F.coalesce(F.col(f"c{df.columns.index(text)}"), F.lit("")).alias("t")
    moved = plain.select(*[f"c{k}" for k in at], source)
    small_batches(df.sparkSession)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in moved.schema[:-1]] + [f"n{k} {kind}" for k, (_, kind) in enumerate(new)])
    labels = [f"c{k}" for k in at] + [f"n{k}" for k in range(len(new))]

    def run(batches):
        make = maker()
        for part, texts in text_slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(texts)], names=labels)
        del make
        release()

    return moved.mapInArrow(run, schema).toDF(*names, *[n for n, _ in new])


def where_text(df: DataFrame, text: str, maker) -> DataFrame:
    """The rows of df whose text is found good; all columns stay as they are.

    ``maker()`` is called once a task and gives a function from a list of texts (null: empty) to a
    list of booleans.  Only the text goes to Python, and only the answer comes back.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf("boolean")
    def good(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make = maker()
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["t"])
            yield pa.array([bool(x) for _, texts in text_slices([batch], "t") for x in make(texts)], pa.bool_())
        del make
        release()

    names = df.columns
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    return plain.where(good(F.coalesce(F.col(f"c{names.index(text)}"), F.lit("")))).toDF(*names)
