"""Operator 3: quality classifier, a generalised additive model with pairwise interactions.

Method: boosting goes round the features again and again; each turn fits one shallow tree
over the bins of one feature to the current residuals and adds a small step of it to that
feature's lookup table.  The pairs with the largest remaining gain then get two-way tables
the same way.  A score is the logistic of the intercept plus one table entry per feature
and pair: bin numbers and additions over whole arrays.

The fit uses a bounded sample: of the labelled rows outside the held-out fold, the
``sample`` rows whose salted hash of the doc_id is smallest (all, if there are fewer).
Scores depend on the text alone.

Defined results: null text scores as the empty text; rows with a null label teach nothing;
with no or one-sided labels the score is the (smoothed) share of label 1 for every row; a doc_id that is
labelled several times counts once, with its largest label; whole texts of any length are read, in
time linear in them; equal texts score alike; an empty table gives no rows; all other columns, whatever their
names, stay as they are (a column named like a new one is replaced).
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acopio.llm.shared import add_columns, crc_mod, where_text

UPPER, LOWER, DIGIT = (bytes(range(*map(ord, x))) for x in ("A[", "a{", "0:"))
SPACE = b" \t\n\r\x0b\x0c"
STOPS = b".,;:?'\"()-"
FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "stops", "symbols", "non_ascii", "repeats", "variety", "lines", "line_copies", "short_words", "long_words", "ends", "upper_words")


def features(text: str) -> tuple[float, ...]:
    """Of one whole text, in time linear in it."""
    b = text.encode("utf-8", "replace")
    n = len(b) or 1
    words = text.split()
    m = len(words) or 1
    part = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    upper, lower, digits, stops, space = map(part, (UPPER, LOWER, DIGIT, STOPS, SPACE))
    wide = 1 - len(b.decode("utf-8", "replace").encode("ascii", "ignore")) / n
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = list(map(len, words))
    return (
        np.log1p(len(b)), np.log1p(len(words)), sum(lengths) / m, upper, digits, stops,
        max(0.0, 1 - upper - lower - digits - stops - space - wide), wide,
        sum(map(eq, words, words[1:])) / m, len(set(words)) / m ** 0.9, len(lines) / m, 1 - len(set(lines)) / (len(lines) or 1),
        sum([x <= 2 for x in lengths]) / m, sum([x >= 12 for x in lengths]) / m,
        sum(map(text.count, ".!?")) / m, sum(map(str.isupper, words)) / m,
    )


def _best_steps(grad: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree of up to ``leaves`` leaves over ordered bins, as the step for each bin."""
    g, w = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], weight.cumsum()])
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, z) in enumerate(parts):
            cut = np.arange(a + 1, z)
            wl, wr = w[cut] - w[a], w[z] - w[cut]
            gl, gr = g[cut] - g[a], g[z] - g[cut]
            gain = np.where((wl > least) & (wr > least), gl**2 / (wl + 1) + gr**2 / (wr + 1) - (g[z] - g[a]) ** 2 / (w[z] - w[a] + 1), -1)
            if len(cut) and gain.max() > best[0]:
                best = (gain.max(), k, cut[gain.argmax()])
        if best[1] is None:
            break
        a, z = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], z)]
    out = np.zeros(len(grad))
    for a, z in parts:
        out[a:z] = (g[z] - g[a]) / (w[z] - w[a] + 1)
    return out


class Gam:
    """Additive tables over binned features and over chosen pairs of them."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 6, turns: int = 150, pair_turns: int = 60, rate: float = 0.15, leaves: int = 3):
        self.bins, self.pair_bins, self.n_pairs, self.turns, self.pair_turns, self.rate, self.leaves = bins, pair_bins, pairs, turns, pair_turns, rate, leaves
        self.base, self.edges, self.coarse, self.tables, self.pairs, self.pair_tables = 0.0, [], [], [], [], []

    def _bin(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        quantiles = lambda n: [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])) for k in range(x.shape[1])]
        self.edges, self.coarse = quantiles(self.bins), quantiles(self.pair_bins)
        b, c = self._bin(x, self.edges), self._bin(x, self.coarse)
        f = np.full(len(y), self.base)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        least = max(2.0, len(y) / 2000)
        slope = lambda: (y - (p := 1 / (1 + np.exp(-f))), np.maximum(p * (1 - p), 1e-4))
        for _ in range(self.turns):
            for k, table in enumerate(self.tables):
                g, h = slope()
                step = self.rate * _best_steps(np.bincount(b[k], g, len(table)), np.bincount(b[k], h, len(table)), self.leaves, least * 0.05)
                step = np.clip(step, -1, 1)
                table += step
                f += step[b[k]]
        g, h = slope()
        gains = []
        for i in range(len(c)):
            for j in range(i):
                code = c[i] * (len(self.coarse[j]) + 1) + c[j]
                gains.append((float((np.bincount(code, g) ** 2 / (np.bincount(code, h) + 5)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]]
        self.pair_tables = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(self.pair_turns):
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                g, h = slope()
                code = c[i] * table.shape[1] + c[j]
                g2 = np.bincount(code, g, table.size).reshape(table.shape)
                h2 = np.bincount(code, h, table.size).reshape(table.shape)
                step = np.zeros_like(table)
                rows = _best_steps(g2.sum(1), h2.sum(1), 2, 0)
                for part in np.split(np.arange(len(rows)), np.nonzero(np.diff(rows))[0] + 1):
                    step[part] = _best_steps(g2[part].sum(0), h2[part].sum(0), 2, 0)
                step = np.clip(self.rate * step, -1, 1)
                table += step
                f += step[c[i], c[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.tables:
            for k, row in enumerate(self._bin(x, self.edges)):
                f += self.tables[k][row]
            c = self._bin(x, self.coarse)
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                f += table[c[i], c[j]]
        return 1 / (1 + np.exp(-f))


def _scored(df: DataFrame, text: str, made: str, to, kind: str) -> DataFrame:
    def maker():
        return lambda texts: [to(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES)))]

    return add_columns(df, text, [(made, kind)], maker, drop=(text,))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, sample: int = 12_000) -> Gam:
    """Learn from at most ``sample`` labelled rows outside the held-out fold."""
    some = labels.select("doc_id", F.col(target).cast("int").alias("acopio_y")).where(F.col("acopio_y").isNotNull() & (crc_mod("doc_id", folds) != 0))
    some = some.groupBy("doc_id").agg(F.max("acopio_y").alias("acopio_y")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``sample`` rows
    made = _scored(rows, "text", "acopio_x", lambda x: pa.array(list(x), pa.list_(pa.float64())), "array<double>").orderBy("doc_id").toArrow()
    x = np.array(made["acopio_x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return Gam().fit(x, made["acopio_y"].to_numpy().astype(float))


def score(docs: DataFrame, model: Gam, out: str = "score") -> DataFrame:
    """All columns of docs but the text, and the score of the whole text; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _scored(docs, "text", out, lambda x: pa.array(shared.value.score(x), pa.float64()), "double")


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Gam, least: float = 0.3) -> DataFrame:
    """The rows of docs, text and all, whose text scores ``least`` or more; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def maker():
        return lambda texts: shared.value.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))) >= least

    return where_text(docs, "text", maker)
