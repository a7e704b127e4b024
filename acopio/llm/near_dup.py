"""Operator 6: near-duplicate documents by minhash with tensored banding, and verification.

Method: two collections of ``half`` sub-keys of THREE minhashes each are made once per text; a
table's key combines a sub-key of the first collection with one of the second, so half**2
tables of six minhashes need 6 * half minhashes instead of 6 * half**2.  Two texts meet in a
table if any sub-key of either collection agrees; ``half`` is set so that a pair at the
threshold is missed with a probability of at most MISS.

Texts with equal shingle sets are one candidate.  Keys link a candidate to the smallest of its
table slot; connected candidates form a block whose links are found on full shingle sets.
Large blocks are split, and every pair of parts is compared, so that a task holds a bounded
number of shingles.  Inside, texts already connected are not compared again, and only a
spanning set of links leaves: nothing emits all pairs of a group.

Defined results: null text or text without words has no shingles and is linked with nothing; fewer
than five words are one shingle, the whole sequence; a null doc_id is its own (null)
component and kept; rows that share a doc_id are one node; texts of any length are shingled whole; equal
texts are one class whose smallest doc_id is kept; an empty table gives no rows; columns other than doc_id and text are
not looked at, and ``keep_one`` returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acopio.llm.bpe import Remembered
from acopio.llm.graph import components
from acopio.llm.shared import Table, add_columns, buckets, fresh, tidy, written

WORDS, THREE, MISS = 5, 3, 0.002
#: Shingles that a part of a block holds.
PART = 1_000_000
_ODD = np.random.default_rng(5).integers(0, 2**63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int = WORDS, remember: int = 400_000):
        self.words, self.memory = words, Remembered(xxhash.xxh3_64_intdigest, remember)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()
        h = np.fromiter(map(self.memory.__getitem__, words), np.uint64, len(words))
        n = min(len(h), self.words)
        if not n:
            return h
        many = len(h) - n + 1
        s = np.full(many, n, np.uint64)
        for j in range(n):
            s += _mix(h[j : j + many] + _ODD[j]) * _ODD[8 + j]
        return np.unique(_mix(s))


def halves(threshold: float) -> int:
    """Sub-keys a collection needs: a pair at the threshold is missed at most MISS of the time."""
    n = 1
    while 1 - (1 - (1 - threshold**THREE) ** n) ** 2 > MISS:
        n += 1
    return n


def signatures(docs: DataFrame, half: int, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and the sub-keys of both collections."""

    def maker():
        shingles = Shingles(words)
        times, plus = _ODD[64 : 64 + 2 * half * THREE], _ODD[2048 : 2048 + 2 * half * THREE]

        def make(texts):
            n, digest, keys = [], [], []
            for t in texts:
                s = shingles(t)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if not len(s):
                    keys.append(None)
                    continue
                low = np.full(len(times), np.iinfo(np.uint64).max)
                for at in range(0, len(s), 2048):
                    low = np.minimum(low, ((s[at : at + 2048, None] ^ plus) * times).min(0))
                low = low.reshape(2 * half, THREE) * _ODD[32 : 32 + THREE]
                keys.append(_mix(low.sum(1)).view(np.int64))
            return [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]

        return make

    return add_columns(docs.select("doc_id", "text"), "text", [("n_shingles", "long"), ("digest", "binary"), ("keys", "array<long>")], maker, drop=("text",))


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links of the graph of pairs with 100 * intersection >= percent * union.

    A text is compared, through an inverted index, with all others at once.  Texts of the
    largest component are not: links among them change nothing, and links to others are
    found from the others' side.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders = owner[order]
    first = np.searchsorted(code[order], np.arange(code.max() + 2))
    begin = np.cumsum(size) - size
    label, done = np.arange(n), np.zeros(n, bool)
    leaders = np.argsort(-size, kind="stable")
    while True:
        counts = np.bincount(label, minlength=n)
        largest = int(counts.argmax())
        todo = np.nonzero(~done & ((label != largest) | (counts[largest] == 1)))[0]
        if not len(todo) or counts[largest] == n:
            break
        d = int(todo[0]) if counts[largest] > 1 else int(next(x for x in leaders if not done[x]))
        done[d] = True
        mine = code[begin[d] : begin[d] + size[d]]
        a, many = first[mine], first[mine + 1] - first[mine]
        at = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(holders[at], minlength=n)
        near = np.nonzero(100 * both >= percent * (size[d] + size - both))[0]
        if len(near) > 1:
            old = np.unique(label[near])
            label[np.isin(label, old)] = old[0]
    out = []
    by = np.argsort(label, kind="stable")
    for part in np.split(by, np.nonzero(np.diff(label[by]))[0] + 1):
        if len(part) > 1:
            head = ids[part].min()
            out += [(int(head), int(i)) for i in ids[part] if i != head]
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS, part: int = PART, tables: list[Table] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``tables`` gets the written tables that the result reads.
    """
    spark = docs.sparkSession
    half, deal = halves(percent / 100), buckets(spark)
    signed = written(signatures(docs, half, words))
    full = signed.df().where("n_shingles > 0 and doc_id is not null")
    reps = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")))
    tensor = F.flatten(F.transform(F.slice("keys", 1, half), lambda a, i: F.transform(F.slice("keys", half + 1, half), lambda b, j: F.xxhash64(a, b, i, j))))
    keyed = reps.df().select("rep", F.explode(tensor).alias("key"))
    slots = written(keyed.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).where("head <> tail").select("key", "head"))
    near = written(keyed.join(slots.df(), "key").where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct())
    slots.drop()
    tidy(spark)
    # blocks of connected candidates, in parts of a bounded number of shingles
    block = written(components(near.df()).withColumnRenamed("node", "rep").withColumnRenamed("component", "block").join(reps.df().select("rep", "n").groupBy("rep").agg(F.sum("n").alias("n")), "rep"))
    near.drop()
    sizes = block.df().groupBy("block").agg(F.ceil(F.sum("n") / part).cast("int").alias("parts"))
    mine = block.df().join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    mine = mine.select(F.col("rep").alias("doc_id"), "block", "parts", "own")
    # one shuffle of the texts by doc_id, whatever the size of the candidates' side
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).hint("merge").join(mine, "doc_id")
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    deal_to = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("block"), F.lit(16 * deal))).otherwise(F.xxhash64("block", lo, hi))
    dealt = texts.select("doc_id", "text", "block", lo.alias("lo"), hi.alias("hi"), deal_to.alias("task"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        shingles, out = Shingles(words), []
        for _, group in rows.groupby(["block", "lo", "hi"]):
            sets = [shingles(t) for t in group["text"]]
            good = [k for k, s in enumerate(sets) if len(s)]
            if len(good) > 1:
                out += links(group["doc_id"].to_numpy()[good], [sets[k] for k in good], percent)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    linked = written(dealt.groupBy("task").applyInPandas(compare, "a long, b long"))
    tidy(spark)
    # a doc_id with several texts, or with words and without, is one node with all their sets
    several = signed.df().where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count_if(F.col("digest").isNull()).alias("bare"))
    several = several.where("lo <> hi or (lo is not null and bare > 0)").select("doc_id")
    same = written(full.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(reps.df().select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    found = components(linked.df().unionByName(same.df()))
    for t in (block, linked, same):
        t.drop()
    if tables is not None:
        tables += [signed, reps]
    rows = signed.df().select("doc_id", "n_shingles", "digest").join(reps.df().select("digest", "rep"), "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    rows = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs without those of a group's later documents (repeated rows of a kept id stay)."""
    tables: list[Table] = []
    name = fresh(docs, "acopio_gone")
    gone = written(near_duplicates(docs, percent, tables=tables).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct())
    for t in tables:
        t.drop()
    tidy(docs.sparkSession)
    return docs.join(gone.df(), F.col("doc_id") == F.col(name), "left_anti")


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)
