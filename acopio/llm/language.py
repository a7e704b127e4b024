"""Operator 4: language identification with a linear-chain conditional random field.

Method: every word of a text (its letters, lower case) gets emission scores from affixes,
character n-grams and a lexicon; learned transitions join them; forward-backward gives each
word's label probabilities, so code-switched text is labelled word by word.  A document's
language is the label with the most probability over its words, its score the mean of that
label's word probabilities.

Only whole documents are labelled.  Forward-backward runs over blocks of words: transfer
matrices of all blocks at once, then block starts, then inside the blocks, which is exact.

Training takes, of the documents with a known label outside the held-out fold, the
``sample`` of which each language has an equal share or all its documents, those with the
smallest salted hash of the doc_id (what is left over goes by hash alone), with all their words; runs of
words of several documents are strung together so that the transitions see switches.  Emission,
transition and start weights follow the gradient of the likelihood, whose pair probabilities are
those of forward-backward.

Defined results: null text, or one without letters: ``und`` with score 0; null labels teach
nothing; with no labelled documents everything is ``und``; repeated rows score alike; of labels that are equally
likely the first in order is taken; texts of any length are labelled whole; an empty table gives no
rows; all other columns, whatever their names, stay as they are (``lang_pred`` and ``score`` are replaced).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acopio.llm.shared import add_columns, crc_mod, small_batches, where_text, written

NONE = "und"
BLOCK, RUN = 64, 25


def word_of(chunk: str) -> str:
    """The letters of a chunk, lower case; empty if it has none."""
    return chunk.lower() if chunk.isalpha() else "".join(filter(str.isalpha, chunk)).lower()


def features(words: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word number, slot below ``slots``): affixes of up to four letters, and n-grams of two
    and three letters of the word between two marks.  Hashes of all words' letters at once."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(n + 2) - (n + 2)
    of = np.repeat(np.arange(len(words)), n + 2)
    left = np.repeat(start + n + 2, n + 2) - np.arange(len(letters))  # letters up to the end mark, it included
    padded = np.append(letters, np.zeros(4, np.uint64))
    h, hashes = letters, [letters]
    for k in range(1, 4):
        h = h * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(letters)]
        hashes.append(h)
    owner, codes = [], []
    for k in (2, 3):
        at = np.nonzero(left >= k)[0]
        owner.append(of[at]), codes.append(hashes[k - 1][at] + np.uint64(k))
    for k in range(1, 5):
        some = np.nonzero(n >= k)[0]
        for kind, at in ((16, start[some] + 1), (32, start[some] + 1 + n[some] - k)):
            owner.append(some), codes.append(hashes[k - 1][at] + np.uint64(kind + k))
    code = np.concatenate(codes)
    code = (code ^ code >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    code = (code ^ code >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return np.concatenate(owner), ((code ^ code >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def _forward_backward(e: np.ndarray, starts: np.ndarray, a: np.ndarray, first: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of every word.  e: emissions (words, labels), positive; starts: the
    first word of each sequence, and the end of the last; a: transitions, positive; pairs, if
    given, gets the probabilities of the labels of neighbours added, over all words after a first."""
    labels = e.shape[1]
    sizes = np.diff(starts)
    many = -(-sizes // BLOCK)  # blocks of each sequence
    doc = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = starts[doc] + nth * BLOCK
    length = np.minimum(BLOCK, starts[doc + 1] - begin)
    order = np.argsort(-length, kind="stable")  # the longest first: the active ones are a prefix
    begin, length, doc, nth = begin[order], length[order], doc[order], nth[order]
    active = np.searchsorted(-length, -np.arange(1, BLOCK + 1), "right")
    opening = np.tile(first / labels, (labels, 1))
    steps = int(length[0]) if len(length) else 0
    head = nth == 0
    transfer = np.empty((len(begin), labels, labels))
    for t in range(steps):
        k = active[t]
        if t == 0:
            step = np.where(head[:, None, None], opening, a) * e[begin][:, None, :]
        else:  # one product for all blocks, not one a block
            step = (transfer[:k].reshape(-1, labels) @ a).reshape(k, labels, labels)
            step *= e[begin[:k] + t][:, None, :]
        if t % 4 == 3 or t == steps - 1 or active[t + 1] < k:
            step /= step.sum((1, 2), keepdims=True)
        transfer[:k] = step
    place = np.empty(len(begin), int)  # block number in reading order -> row here
    place[order] = np.arange(len(begin))
    offset = np.cumsum(many) - many
    enter, leave = np.ones((len(begin), labels)), np.ones((len(begin), labels))
    by_size = np.argsort(-many, kind="stable")
    for b in range(1, int(many.max(initial=0))):
        d = by_size[: np.searchsorted(-many[by_size], -b, "left")]
        v = (enter[p := place[offset[d] + b - 1]][:, None, :] @ transfer[p])[:, 0]
        enter[place[offset[d] + b]] = v / v.sum(1, keepdims=True)
    for b in range(int(many.max(initial=0)) - 1, 0, -1):
        d = by_size[: np.searchsorted(-many[by_size], -b, "left")]
        v = (transfer[p := place[offset[d] + b]] @ leave[p][:, :, None])[:, :, 0]
        leave[place[offset[d] + b - 1]] = v / v.sum(1, keepdims=True)
    out = np.empty_like(e)
    v, entered = enter, enter.copy() if pairs is not None else None
    for t in range(steps):
        k = active[t]
        step = v[:k] @ a
        if t == 0:
            step[head[:k]] = v[:k][head[:k]] @ opening
        step *= e[begin[:k] + t]
        v[:k] = step / step.sum(1, keepdims=True)
        out[begin[:k] + t] = v[:k]
    v = leave
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        if pairs is not None:  # forward of the word before, transition, emission and backward of this one
            before, on = (out[at - 1], slice(None)) if t else (entered[:k], ~head[:k])
            joint = before[on][:, :, None] * a * (e[at] * v[:k])[on][:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        both = out[at] * v[:k]
        out[at] = both / both.sum(1, keepdims=True)
        step = (e[at] * v[:k]) @ a.T
        v[:k] = step / step.sum(1, keepdims=True)
    return out


class Crf:
    def __init__(self, slots: int = 1 << 15):
        self.slots = slots
        self.labels: list[str] = []
        self.lexicon: dict[str, list[int]] = {}
        self.w, self.a, self.first = np.zeros((slots, 0)), np.zeros((0, 0)), np.zeros(0)

    def pairs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of words; the slots after the hashed ones say that a word is in a label's lexicon."""
        owner, slot = features(words, self.slots)
        known = [(k, self.slots + y) for k, w in enumerate(words) for y in self.lexicon.get(w, ())]
        if known:
            more = np.array(known, np.int64)
            owner, slot = np.append(owner, more[:, 0]), np.append(slot, more[:, 1])
        return owner, slot

    def emissions(self, words: list[str], most: int = 20_000) -> np.ndarray:
        out = [np.zeros((0, len(self.labels)))]
        for lo in range(0, len(words), most):
            owner, slot = self.pairs(part := words[lo : lo + most])
            out.append(np.stack([np.bincount(owner, self.w[slot, k], len(part)) for k in range(len(self.labels))], 1))
        return np.clip(np.concatenate(out), -30, 30)

    def fit(self, runs: list[tuple[str, list[str]]], epochs: int = 4, length: int = 60, rate: float = 0.3, seed: int = 1) -> Crf:
        """runs: (label, words that follow each other)."""
        runs = [(y, w) for y, w in runs if w]
        self.labels = sorted({y for y, _ in runs})
        n = len(self.labels)
        self.w, self.a, self.first = np.zeros((self.slots + n, n)), np.zeros((n, n)), np.zeros(n)
        if n == 0:
            return self
        number = {y: k for k, y in enumerate(self.labels)}
        counts: dict[str, np.ndarray] = {}
        for y, words in runs:
            for x in words:
                counts.setdefault(x, np.zeros(n))[number[y]] += 1
        share = {x: c / c.sum() for x, c in counts.items() if c.sum() >= 5}
        self.lexicon = {x: [int(c.argmax())] for x, c in share.items() if c.max() > 0.5}
        code = {x: k for k, x in enumerate(counts)}
        owner, slot = self.pairs(list(counts))
        slot, many = slot[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(code))
        begin = np.cumsum(many) - many
        rng = np.random.default_rng(seed)
        gw, ga, gf = np.full_like(self.w, 1e-6), np.full_like(self.a, 1e-6), np.full(n, 1e-6)
        coded = [(number[y], np.array([code[x] for x in run])) for y, run in runs]
        for _ in range(epochs):
            # every run whole, cut in two at a random word so that switches come at uneven distances
            parts = [(y, p) for y, run in coded for p in np.split(run, [int(rng.integers(len(run) + 1))]) if len(p)]
            order = rng.permutation(len(parts))
            words = np.concatenate([parts[r][1] for r in order])
            gold = np.repeat([parts[r][0] for r in order], [len(parts[r][1]) for r in order])
            for lo in range(0, len(words), 64 * length):
                x, y = words[lo : lo + 64 * length], gold[lo : lo + 64 * length]
                starts = np.append(np.arange(0, len(x), length), len(x))
                sizes = many[x]
                at = np.cumsum(sizes) - sizes
                flat = slot[np.repeat(begin[x] - at, sizes) + np.arange(sizes.sum())]
                s = np.add.reduceat(self.w[flat], at, axis=0)
                e, a = np.exp(s - s.max(1, keepdims=True)), np.exp(self.a)
                pair = np.zeros((n, n))
                p = _forward_backward(e, starts, a, np.exp(self.first), pair)
                diff = -p
                diff[np.arange(len(y)), y] += 1
                g = np.stack([np.bincount(flat, np.repeat(diff[:, k], sizes), len(self.w)) for k in range(n)], 1) / 64
                gw += g * g
                self.w += rate * g / np.sqrt(gw) - 1e-4 * self.w
                inner = np.ones(len(x), bool)
                inner[starts[:-1]] = False
                j = np.nonzero(inner)[0]
                g = (np.bincount(y[j - 1] * n + y[j], minlength=n * n).reshape(n, n) - pair) / 64
                ga += g * g
                self.a += 0.5 * rate * g / np.sqrt(ga)
                g = (np.bincount(y[starts[:-1]], minlength=n) - p[starts[:-1]].sum(0)) / 64
                gf += g * g
                self.first += 0.5 * rate * g / np.sqrt(gf)
        return self


def _chosen(some: DataFrame, sample: int) -> DataFrame:
    """doc_id of at most ``sample`` documents: of each language its share or all it has, and the
    rest, as those of each language, by the smallest hash.

    Rows whose hash is beyond a language's share, with some to spare, go before its rows
    meet in one task.
    """
    by = F.xxhash64("doc_id", F.lit(4))
    found = some.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(sample).collect()
    if not found:
        return some.select("doc_id").limit(0)
    share = sample // len(found)
    counts = some.sparkSession.createDataFrame([(r.lang, (share + 6 * share**0.5 + 20) / r.n) for r in found], "lang string, acopio_part double")
    near = some.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(by / 2.0**64 + 0.5 < F.col("acopio_part"))
    first = near.select("doc_id", "lang").distinct().withColumn("acopio_nth", F.row_number().over(Window.partitionBy("lang").orderBy(by, "doc_id"))).where(F.col("acopio_nth") <= share)
    rest = some.select("doc_id").orderBy(by, "doc_id").limit(sample)
    both = first.select("doc_id", F.lit(0).alias("acopio_turn")).unionByName(rest.withColumn("acopio_turn", F.lit(1)))
    return both.groupBy("doc_id").agg(F.min("acopio_turn").alias("acopio_turn")).orderBy("acopio_turn", by, "doc_id").limit(sample).select("doc_id")


def fit(docs: DataFrame, folds: int = 5, sample: int = 1_000) -> Crf:
    """Learn from text and lang of at most ``sample`` documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    some = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", folds) != 0))
    ids = written(some.select("doc_id", "lang"))  # the texts are read once to choose, not once a step
    chosen = _chosen(ids.df(), sample)
    some = some.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")  # at most ``sample`` ids

    rows = some.select("lang", "text").orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id", "text").limit(sample).toArrow().to_pylist()
    ids.drop()
    words = [(r["lang"], [w for w in map(word_of, r["text"].split()) if w]) for r in rows]
    return Crf().fit([(y, w[k : k + RUN]) for y, w in words for k in range(0, len(w), RUN)])


def _labeller(docs: DataFrame, model: Crf, words: bool = False, remember: int = 300_000):
    """For ``add_columns``: languages and scores of texts, and with ``words`` of their chunks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def maker():
        crf = shared.value
        n = len(crf.labels)
        rows: dict[str, int] = {}
        table = np.zeros((0, n))
        a, first, names = np.exp(crf.a), np.exp(crf.first), np.array([*crf.labels, NONE], object)

        def make(texts):
            nonlocal table
            if len(rows) > remember:
                rows.clear()
                table = np.zeros((0, n))
            chunks = [t.split() for t in texts]
            made: list[str] = []
            for x in set().union(*chunks).difference(rows):
                w = word_of(x) if n else ""
                rows[x] = len(table) + len(made) if w else -1
                if w:
                    made.append(w)
            if made:
                s = crf.emissions(made)
                table = np.concatenate([table, np.exp(s - s.max(1, keepdims=True))])
            sizes = np.array([len(t) for t in chunks])
            all_rows = np.fromiter(map(rows.__getitem__, itertools.chain.from_iterable(chunks)), np.int64, sizes.sum())
            doc = np.repeat(np.arange(len(texts)), sizes)
            real = all_rows >= 0
            got, of = all_rows[real], doc[real]
            each = np.bincount(of, minlength=len(texts))
            some = np.nonzero(each)[0]
            mean = np.zeros((len(texts), max(n, 1)))
            best = np.full(len(all_rows), n)
            if len(got):
                p = _forward_backward(table[got], np.append(0, np.cumsum(each[some])), a, first)
                for k in range(n):
                    mean[:, k] = np.bincount(of, p[:, k], len(texts)) / np.maximum(each, 1)
                best[real] = p.argmax(1)
            pred = np.where(each > 0, mean.argmax(1), n)
            out = [pa.array(names[pred], pa.string()), pa.array(np.clip(mean.max(1), 0, 1), pa.float64())]
            if words:
                ends = np.cumsum(sizes)
                out.append(pa.array([list(names[best[z - k : z]]) for z, k in zip(ends, sizes, strict=True)], pa.list_(pa.string())))
            return out

        return make

    return maker


def label(docs: DataFrame, model: Crf, words: bool = False) -> DataFrame:
    """All columns of docs, lang_pred and score; with ``words`` also a label for every
    white-space separated chunk (``und`` where it has no letters).  One narrow pass."""
    return add_columns(docs, "text", [("lang_pred", "string"), ("score", "double")] + [("word_langs", "array<string>")] * words, _labeller(docs, model, words))


def keep(docs: DataFrame, model: Crf, least: float = 0.35) -> DataFrame:
    """The rows of docs that have a language with mean word probability of at least ``least``; one narrow pass."""
    make = _labeller(docs, model)

    def maker():
        found = make()
        return lambda texts: [y != NONE and s >= least for y, s in zip(*(x.to_pylist() for x in found(texts)), strict=True)]

    return where_text(docs, "text", maker)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = label(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
