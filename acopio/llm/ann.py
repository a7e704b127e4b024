"""Operator 5: approximate nearest neighbours by stable projections and a kd-tree.

Method: vectors are lifted so that the largest inner product is the smallest distance, and
projected to M dimensions by Gaussian (2-stable) directions; a kd-tree holds the projected
points, its upper part dealt over the cluster (``vectors``), the rest inside a shard.  A query takes
projected neighbours leaf by leaf, in order of projected distance, and verifies them on the
original vectors.  Squared projected over squared true distance is chi-square with M degrees
of freedom, so the search stops when the next projected neighbours lie beyond the SURE
quantile times the kth best squared distance: a nearer vector would lie there with
probability 1 - SURE at most.  Cells and leaves beyond that are never opened.

Queries of a block go through the leaves together, as products of matrices; each keeps its
own stopping test.  Equal vectors of a shard are one point with a list of ids, so a third of all rows
being one vector costs one verification a shard.  Scores are inner products of the original vectors in doubles.

Defined results: null or empty vectors, all-zero ones and those with a null or non-finite
component, and null ids, take no part; an empty table gives no rows; with fewer than k candidates all are
returned; ties go to the smaller vec_id; rows that repeat a vec_id are candidates each, and one
query; columns other than vec_id and embedding are not looked at.
"""

from __future__ import annotations

from functools import cache
from math import exp

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acopio.llm.vectors import search, valid

M, SURE, LEAF = 16, 0.98, 64
#: Points kept beyond k while sums are still those of matrix products, which round in another order.
SPARE = 8


@cache
def quantile(m: int = M, p: float = SURE) -> float:
    """Of the chi-square distribution with an even number m of degrees of freedom."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        x = (lo + hi) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        lo, hi = (x, hi) if 1 - exp(-x / 2) * total < p else (lo, x)
    return hi


@cache
def directions(dim: int) -> np.ndarray:
    """The same Gaussian directions everywhere."""
    return np.random.default_rng(20_05).standard_normal((dim + 1, M))


def projected(rows: np.ndarray, top: float) -> np.ndarray:
    """Projections of vectors lifted to the squared norm ``top``."""
    d = directions(rows.shape[1])
    return rows @ d[:-1] + np.sqrt(np.maximum(top - (rows**2).sum(1), 0))[:, None] * d[-1]


def scales(q: np.ndarray, top: float) -> np.ndarray:
    """A query is scaled to the largest norm: ranks stay, and distances are those of the lift."""
    return np.sqrt(top / (q**2).sum(1)) if top > 0 else np.ones(len(q))


def box_distance(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(p), len(low)))
    for axis in range(p.shape[1]):
        x = p[:, axis, None]
        out += np.maximum(0, np.maximum(low[None, :, axis] - x, x - high[None, :, axis])) ** 2
    return out


class KdSpace:
    """The upper part of the kd-tree of projected points: cells with their boxes."""

    edges = range(2 * M)

    def __init__(self, sample: np.ndarray, top: float, cells: int):
        self.top = top
        p = projected(sample, top)
        self.axis, self.at = np.zeros(cells - 1, np.int64), np.zeros(cells - 1)
        parts = [p]
        for node in range(cells - 1):  # node 0 is the root, 2 n + 1 and 2 n + 2 lie below n
            part = parts[node]
            if len(part):
                self.axis[node] = int(np.ptp(part, axis=0).argmax())
                self.at[node] = np.median(part[:, self.axis[node]])
            right = part[:, self.axis[node]] > self.at[node]
            parts += [part[~right], part[right]]

    def place(self, rows: np.ndarray, query: bool) -> np.ndarray:
        p = (rows * scales(rows, self.top)[:, None]) @ directions(rows.shape[1])[:-1] if query else projected(rows, self.top)
        node = np.zeros(len(p), np.int64)
        while len(self.axis) and node[0] < len(self.axis):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - len(self.axis)

    def high(self, rows: np.ndarray, cell: int) -> list[float]:
        p = projected(rows, self.top)
        return [*(-p.min(0)).tolist(), *p.max(0).tolist()]

    def reach(self, q: np.ndarray, kth: np.ndarray, cells: list[int], high: np.ndarray) -> np.ndarray:
        scale = scales(q, self.top)
        near = box_distance((q * scale[:, None]) @ directions(q.shape[1])[:-1], -high[:, :M], high[:, M:])
        return near < (quantile() * np.maximum(2 * self.top - 2 * scale * kth, 0) * (1 + 1e-9) + 1e-12 * self.top)[:, None]


def index(ids: np.ndarray, rows: np.ndarray):
    """Of a shard: distinct vectors in kd-tree order, their ids, projections and leaf boxes."""
    rows = np.ascontiguousarray(rows + 0.0)
    _, first, of = np.unique(rows.view(f"V{8 * rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    x = rows[first]
    top = float((x**2).sum(1).max())
    p = projected(x, top)
    leaves: list[np.ndarray] = []

    def split(part: np.ndarray) -> None:
        if len(part) <= LEAF:
            leaves.append(part)
            return
        axis = int(np.ptp(p[part], axis=0).argmax())
        half = np.argpartition(p[part, axis], len(part) // 2)
        split(part[half[: len(part) // 2]])
        split(part[half[len(part) // 2 :]])

    split(np.arange(len(x)))
    order = np.concatenate(leaves)
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    ends = np.cumsum([len(v) for v in leaves])
    lows, highs = np.stack([p[v].min(0) for v in leaves]), np.stack([p[v].max(0) for v in leaves])
    by = np.argsort(place[of], kind="stable")  # ids are sorted already: smaller ones first
    starts = np.searchsorted(place[of][by], np.arange(len(order) + 1))
    return x[order], p[order], top, ends, lows, highs, ids[by], starts


def find(shard, names: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
    x, p, top, ends, lows, highs, ids, starts = shard
    limit, most = quantile(), k + SPARE
    scale = scales(q, top)
    lifted = q * scale[:, None]
    pq = lifted @ directions(x.shape[1])[:-1]
    near = box_distance(pq, lows, highs)
    worst = kth.copy()  # a score that k others reach
    far = lambda w, s: limit * (np.maximum(2 * top - 2 * s * w, 0) * (1 + 1e-9) + 1e-9 * top)
    # leaves in order of their distance from the block, so the nearest of each query come early
    order = np.argsort(near.min(0), kind="stable")
    size, squares, at, step = np.diff(ends, prepend=0), (p**2).sum(1), 0, 4
    who, point, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    while at < len(order):
        new, at, step = order[at : at + step], at + step, min(2 * step, 64)
        bound = far(worst, scale)
        ask = np.nonzero((near[:, new] < bound[:, None]).any(1))[0]
        new = new[(near[:, new] < bound[:, None]).any(0)]
        if not len(ask) or not len(new):
            continue
        rows = np.concatenate([np.arange(ends[o] - size[o], ends[o]) for o in new])
        # verified are those whose projection lies within the stopping distance of the query
        within = squares[rows] + (pq[ask] ** 2).sum(1)[:, None] - 2 * (pq[ask] @ p[rows].T) < bound[ask][:, None]
        score = q[ask] @ x[rows].T
        a, b = np.nonzero(within & (score >= (worst[ask] - 1e-9 * np.abs(worst[ask]))[:, None]))
        if not len(a):
            continue
        who, point, value = np.concatenate([who, ask[a]]), np.concatenate([point, rows[b]]), np.concatenate([value, score[a, b]])
        by = np.lexsort((ids[starts[point]], -value, who))
        who, point, value = who[by], point[by], value[by]
        rank = np.arange(len(who)) - np.searchsorted(who, who, "left")
        full = np.nonzero(rank == k)[0]  # the own vector may be among them: k others reach the next score
        worst[who[full]] = np.maximum(worst[who[full]], value[full])
        who, point, value = who[rank < most], point[rank < most], value[rank < most]
    take = np.minimum(starts[point + 1] - starts[point], k + 1)
    query = np.repeat(who, take)
    vec = ids[np.repeat(starts[point] - (np.cumsum(take) - take), take) + np.arange(take.sum())]
    exact = np.repeat((x[point] * q[who]).sum(1), take)
    other = vec != names[query]
    query, vec, exact = query[other], vec[other], exact[other]
    by = np.lexsort((vec, -exact, query))
    query, vec, exact = query[by], vec[by], exact[by]
    stay = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    return names[query[stay]], vec[stay], exact[stay]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k largest inner products found of vectors (vec_id, embedding) for queries."""
    return search(valid(vectors, zero=False), valid(queries, zero=False), k, KdSpace, index, find, "double")


def op5_ann_search(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), 20)
