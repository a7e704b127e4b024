"""Dealing of vectors and of queries by space, for the two search operators.

A space cuts the vectors of one dimension into cells (at most CELLS, fitted on a bounded sample; every row
gets a cell), and a cell into shards of bounded size by a hash of vec_id, so one cell may hold any share of the
rows.  A shard's index is one packed row.  Queries first search the shards of their own cell; the
kth score found goes with them, and they are sent only to those other cells that could hold a
better one, where it prunes from the start.  A shard moves once for PER_SHARD blocks of queries, and
a search returns at most k rows a query and shard.

Vectors of other dimensions than a query's are no candidates for it; a dimension that the sample
doesn't hold has one cell.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acopio.llm.shared import buckets, release, small_batches, written

SHARD_ROWS, BLOCK_ROWS, PER_SHARD = 16_384, 256, 128
CELLS, SAMPLE_VALUES, DIMS = 1_024, 1 << 20, 16


def valid(df: DataFrame, zero: bool = True) -> DataFrame:
    """vec_id, embedding of rows whose id and vector are known and finite (and, unless ``zero``, not all 0)."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    if not zero:
        good &= F.exists(x, lambda v: v != 0)
    return df.select("vec_id", x.cast("array<double>").alias("embedding")).where(good & (F.size(x) > 0))


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spaces(vectors: DataFrame, kind: type) -> dict:
    """A space for each of the DIMS most frequent dimensions of a sample of SAMPLE_VALUES numbers."""
    rows, dim = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not rows:
        return {}  # an empty table has no space
    most = max(64, SAMPLE_VALUES // dim)
    part = min(1.0, 1.5 * most / rows)
    some = vectors.where(F.xxhash64("vec_id", F.lit(29)) / 2.0**64 + 0.5 <= part).select("embedding").limit(most).toArrow()["embedding"].to_pylist()
    by: dict[int, list] = {}
    for x in some:
        by.setdefault(len(x), []).append(x)
    keep = sorted(by, key=lambda n: (-len(by[n]), n))[:DIMS]
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    tops = dict(vectors.where(F.size("embedding").isin(keep)).groupBy(F.size("embedding")).agg(F.max(norm)).collect())  # at most DIMS rows
    cells = 1
    while cells < CELLS and cells * SHARD_ROWS < rows:
        cells *= 2
    return {n: kind(np.array(by[n], float), float(tops[n]), cells) for n in keep}


def _placed(df: DataFrame, found: dict, query: bool) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            column = b.column("embedding")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            cell = np.zeros(len(sizes), np.int32)
            for n, space in found.items():
                at = np.nonzero(sizes == n)[0]
                if len(at):
                    cell[at] = space.place(matrix(column.take(pa.array(at))), query)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), column, pa.array(sizes, pa.int32()), pa.array(cell)], names=["vec_id", "embedding", "dim", "cell"])

    return df.mapInArrow(run, "vec_id long, embedding array<double>, dim int, cell int")


def _packed(placed: DataFrame, most: int, make, name: str) -> DataFrame:
    """(dim, cell, name, data): groups of about ``most`` rows of a cell."""
    counts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = placed.join(counts, ["dim", "cell"]).withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
    return dealt.groupBy("dim", "cell", name).applyInArrow(make, f"dim int, cell int, {name} int, data binary, high array<double>")


def _row(part: pa.Table, name: str, data, high) -> pa.Table:
    one = lambda c: pa.array([part.column(c)[0].as_py()], pa.int32())
    return pa.table([one("dim"), one("cell"), one(name), pa.array([pickle.dumps(data, 5)], pa.binary()), pa.array([high], pa.list_(pa.float64()))], names=["dim", "cell", name, "data", "high"])


def _sorted(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, rows = part.column("vec_id").to_numpy(), matrix(part.column("embedding"))
    order = np.argsort(ids, kind="stable")
    return ids[order], np.ascontiguousarray(rows[order])


def search(vectors: DataFrame, queries: DataFrame, k: int, kind: type, index, find, score: str) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of ``vectors`` for each of ``queries``.

    kind(sample, largest squared norm, cells) is a space: place(rows, query) gives cells, high(rows) what is known of a
    cell as numbers of which the largest hold for all of it, and reach(rows, kth, cells' numbers) says which
    cells may hold better; index(ids, rows) prepares a shard; find(shard, ids, rows, kth, k) gives arrays of
    query ids, vec_ids and scores.
    """
    spark = vectors.sparkSession
    found = spaces(vectors, kind)
    if not found:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")
    placed = written(_placed(vectors, found, False))
    asked = written(_placed(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), found, True))

    def shard(part: pa.Table) -> pa.Table:
        ids, rows = _sorted(part)
        space = found.get(rows.shape[1])
        return _row(part, "shard", index(ids, rows), space.high(rows, part.column("cell")[0].as_py()) if space else [])

    shards = written(_packed(placed.df(), SHARD_ROWS, shard, "shard"), "lz4")
    placed.drop()
    blocks = max(1, -(-asked.df().count() // (BLOCK_ROWS * PER_SHARD)))
    sizes = shards.df().groupBy("dim", "cell").agg((F.max("shard") + 1).alias("shards"))
    salted = shards.df().select("dim", "cell", "shard", "data", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("salt"))
    parts = buckets(spark)

    def run(data: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if data.num_rows and asks.num_rows:
            prepared = pickle.loads(data.column("data")[0].as_buffer())
            for x in asks.column("data"):
                for o, values in zip(out, find(prepared, *pickle.loads(x.as_buffer()), k), strict=True):
                    o.append(values)
            release()
        kinds = (pa.int64(), pa.int64(), pa.float64() if score == "double" else pa.int64())
        return pa.table([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    def searched(groups: DataFrame) -> DataFrame:
        """groups: dim, cell, block, data."""
        to = groups.join(sizes, ["dim", "cell"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        to = to.withColumn("salt", F.pmod(F.xxhash64("dim", "cell", "block"), F.lit(blocks)).cast("int")).select("dim", "cell", "shard", "salt", "data")
        key = ["dim", "cell", "shard", "salt"]
        return salted.repartition(parts, *key).groupBy(*key).cogroup(to.repartition(parts, *key).groupBy(*key)).applyInArrow(run, f"query_id long, vec_id long, score {score}")

    def first(part: pa.Table) -> pa.Table:
        ids, rows = _sorted(part)
        return _row(part, "block", (ids, rows, np.full(len(ids), -np.inf)), [])

    near = written(searched(_packed(asked.df(), BLOCK_ROWS, first, "block")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    cells = shards.df().where(F.col("dim").isin(list(found))).groupBy("dim", "cell")
    width = max([len(x.edges) for x in found.values()], default=0)
    known = cells.agg(*[F.max(F.get("high", F.lit(i))).alias(f"h{i}") for i in range(width)]).orderBy("dim", "cell").collect()  # at most DIMS * CELLS rows
    if len({(r[0], r[1]) for r in known}) <= len({r[0] for r in known}):
        return ranked(near.df())  # one cell a dimension
    others = {n: ([r[1] for r in known if r[0] == n], np.array([r[2 : 2 + len(x.edges)] for r in known if r[0] == n], float)) for n, x in found.items()}
    kth = ranked(near.df()).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
    carried = asked.df().join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")

    def second(part: pa.Table) -> pa.Table:
        """The part of a block of queries that each other cell may have better vectors for."""
        names, kinds = ["dim", "cell", "block", "data", "high"], (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()))
        rows: list[tuple] = []
        ids, x = part.column("vec_id").to_numpy(), matrix(part.column("embedding"))
        dim, own, block = (part.column(c)[0].as_py() for c in ("dim", "cell", "block"))
        if dim in found:
            worst = part.column("kth").to_numpy()
            worst = np.where(np.isnan(worst), -np.inf, worst)
            numbers, high = others[dim]
            for c, go in zip(numbers, found[dim].reach(x, worst, numbers, high).T, strict=True):
                if c != own and go.any():
                    rows.append((dim, c, block + own * 1_000_003 & 0x7FFFFFFF, pickle.dumps((ids[go], x[go], worst[go]), 5), []))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    far = written(searched(_packed(carried, BLOCK_ROWS, second, "block")))
    return ranked(near.df().unionByName(far.df()))
