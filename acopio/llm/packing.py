"""Operator 1: best-fit packing of documents into fixed-size token sequences.

Method: the plan is made from the length histogram (at most ``size`` rows, whatever the
corpus), not from documents: lengths from long to short, all pieces of a length at once
go to the fullest open sequences that still hold them, as runs of equal sequences.
Pieces then take the planned slots by joining on their rank within their length.  The
rank is a count of smaller salts of the length plus a row number within (length, salt),
so a length that a third of all pieces have is spread over SALTS tasks.

Defined results: null or empty text is one piece holding only the terminator; a text
longer than ``size`` ids is cut into pieces of ``size``, the last may be shorter; null and
repeated doc_ids are packed like any others; an empty table gives no rows; columns other than
doc_id and text are not looked at; pieces of equal length are ranked by doc_id, piece, start and checksum.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acopio.llm.bpe import Bpe, Remembered, _byte_letters, chunks_of, default_path
from acopio.llm.shared import fresh, text_slices, written

SIZE = 4096
SALTS = 256


def pieces(df: DataFrame, text: str = "text", size: int = SIZE, end: int = 1, path: str | None = None, ids: bool = False, remember: int = 500_000) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32 (and the ids).

    Words are encoded by the tokenizers library; a bounded table remembers recent chunks.
    """
    src = fresh(df, "acopio_src")
    docs = df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias(src))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches):
        from tokenizers import Tokenizer

        where = path or default_path()
        split, model = Bpe(where), Tokenizer.from_file(where).model
        letters = {b: x for b, x in enumerate(_byte_letters())}

        def known(chunk: str) -> bytes:
            out: list[int] = []
            for w in split.pieces(chunk):
                if isinstance(w, int):
                    out.append(w)
                else:
                    out += [t.id for t in model.tokenize(w.decode("latin1").translate(letters))]
            return np.array(out, "<u4").tobytes()

        memory = Remembered(known, remember)
        last = np.array([end], "<u4").tobytes()
        for part, texts in text_slices(batches, src):
            rows: dict[str, list] = defaultdict(list)
            at: list[int] = []
            for k, t in enumerate(texts):
                coded = b"".join([memory[c] for c in chunks_of(t)]) + last
                for n, i in enumerate(range(0, len(coded), 4 * size)):
                    cut = coded[i : i + 4 * size]
                    at.append(k)
                    rows["piece"].append(n)
                    rows["start"].append(i // 4)
                    rows["length"].append(len(cut) // 4)
                    rows["ids_crc32"].append(zlib.crc32(cut))
                    if ids:
                        rows["ids"].append(np.frombuffer(cut, "<u4").astype("i4"))
            cols = [part.column("doc_id").take(pa.array(at, pa.int32())), pa.array(rows["piece"], pa.int32())] + [pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32")]
            if ids:
                cols.append(pa.array(rows["ids"], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    return docs.mapInArrow(run, schema)


def plan(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Best fit decreasing over counts.  Rows (length, rank, sequence, each, offset): pieces of
    ``length`` from ``rank`` on go ``each`` to a sequence, to ``sequence`` and those after it,
    one after the other from ``offset``.

    A step uses up a run of equal sequences or the pieces of a length, so the number of
    rows depends on ``size`` and the variety of lengths, not on the number of documents.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    out, opened = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room > 0 and many > 0:
            free.setdefault(room, []).append((first, many))

    for length in sorted((n for n in histogram if histogram[n] > 0), reverse=True):
        left, rank = histogram[length], 0
        for room in sorted(r for r in free if r >= length):
            each = room // length
            runs = free.pop(room)
            while runs and left:
                first, many = runs.pop()
                full = min(many, left // each)
                if full:
                    out.append((length, rank, first, each, size - room))
                    put(room - each * length, first, full)
                    rank, left = rank + full * each, left - full * each
                if full < many and 0 < left < each:
                    out.append((length, rank, first + full, each, size - room))
                    put(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                if full < many:
                    runs.append((first + full, many - full))
            if runs:
                free.setdefault(room, []).extend(runs)
            if not left:
                break
        if left:
            each = size // length
            full, rest = divmod(left, each)
            out.append((length, rank, opened, each, 0))
            put(size - each * length, opened, full)
            if rest:
                put(size - rest * length, opened + full, 1)
            opened += full + (rest > 0)
    return np.array(out, np.int64).reshape(-1, 5)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, start, length, ids_crc32.

    ``cut`` is read three times, so it should be a written table.
    """
    spark = cut.sparkSession
    salted = cut.withColumn("acopio_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "acopio_salt").agg(F.count("*").alias("acopio_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("acopio_n")).collect()}  # at most ``size`` rows
    steps = plan(histogram, size)
    before = counts.select("length", "acopio_salt", (F.sum("acopio_n").over(Window.partitionBy("length").orderBy("acopio_salt")) - F.col("acopio_n")).alias("acopio_before"))
    inside = F.row_number().over(Window.partitionBy("length", "acopio_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("acopio_in", inside).join(before, ["length", "acopio_salt"]).withColumn("acopio_rank", F.col("acopio_in") + F.col("acopio_before"))
    ranked = ranked.select(*cut.columns, "acopio_rank")
    table = spark.sparkContext.broadcast(steps[np.lexsort((steps[:, 1], steps[:, 0]))] if len(steps) else steps)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    names = cut.columns

    def place(batches):
        rows = table.value
        # a slot is the last step of the length that starts at or before the rank
        key = rows[:, 0] << 44 | rows[:, 1]
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("acopio_rank").to_numpy(zero_copy_only=False)
            step = rows[np.searchsorted(key, length << 44 | rank, "right") - 1]
            far = rank - step[:, 1]
            cols = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(step[:, 2] + far // step[:, 3], pa.int64()), pa.array(step[:, 4] + far % step[:, 3] * length, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def best_fit(docs: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """Documents (doc_id, text) to packed pieces; one pass over the texts."""
    return pack(written(pieces(docs, size=size, **options)).df(), size)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
