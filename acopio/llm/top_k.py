"""Operator 7: exact top-k inner products by dual-tree search over cover trees.

Method: queries and data both get a cover tree.  A node of level i is a centre, one of its points, whose
other points lie within 2^i of it; its children are a net of its points of level i - 1: the
centre itself again (nesting) and points further than 2^(i-1) from each other (separation), and every
point belongs to a child within 2^(i-1) (covering).  Nodes of up to LEAF points stay whole.  The
top of the data's tree, over the whole table, deals the rows (``vectors``): the first centres of a farthest-first
order, with the measured radius of each cell.  Radii are measured, so every bound holds.

A pair of nodes can't hold a product above <q,x> + Rq |x| + Rx |q| + Rq Rx; pairs below the worst
kth score of the query group go, the rest are opened best first; at the queries' leaves each query
has its own bound.  Scores equal to the worst are still looked at: ties go to the smaller vec_id.

Components become floor(256 x).  Products are exact in double precision while they stay below 2^53;
where they don't, bounds are widened by what rounding can do, and the candidates left are scored with
Python's integers, whatever the size (a score beyond a long is written as the nearest long).
Only shards with components beyond 1e140, whose squares doubles can't hold, are not searched by tree.

Defined results: vectors that are null, empty or hold a null or non-finite component, and null
ids, take no part; an empty table gives no rows; a query's own id is never its candidate; repeated rows of an
id count each as candidates and are one query; columns other than vec_id and embedding are not looked at.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acopio.llm.vectors import search, valid

LEAF, AT_ONCE, LARGEST = 32, 4_096, 1e140


def integers(rows: np.ndarray) -> np.ndarray:
    """floor(256 x); as Python integers where doubles overflow."""
    if np.abs(rows).max(initial=0) < LARGEST:
        return np.floor(256 * rows)
    return np.array([[int(Fraction(float(v)) * 256 // 1) for v in r] for r in rows], object).reshape(rows.shape)


def net(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows further apart than ``scale``, row 0 first, and for each row the one it is within
    ``scale`` of.  Rows are taken in turn, a block at a time; the rest is compared by products of matrices."""
    squares = (x**2).sum(1)
    owner, centres, left = np.full(len(x), -1), [], np.arange(len(x))
    while len(left):
        block, size = left[:256], min(256, len(left))
        near = np.maximum(squares[block, None] + squares[block] - 2 * (x[block] @ x[block].T), 0) <= scale * scale
        free, new = np.ones(size, bool), []
        for k in range(size):
            if free[k]:
                new.append(k)
                mine = free & near[k]
                mine[k] = True
                owner[block[mine]] = block[k]
                free &= ~mine
        new = block[new]
        centres.append(new)
        left = left[256:]
        if len(left):
            d = squares[left, None] + squares[new] - 2 * (x[left] @ x[new].T)
            best = d.argmin(1)
            within = d[np.arange(len(left)), best] <= scale * scale
            owner[left[within]] = new[best[within]]
            left = left[~within]
    return np.concatenate(centres), owner


class CoverTree:
    """Nodes as arrays, children next to each other; ``order``: rows so that a node's points are too."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.level: list[int] = []
        centre, radius, first, last, child, end = [], [], [], [], [], []

        def add(a: int, z: int, level: int) -> None:
            own = x[self.order[a:z]]
            far = np.sqrt(((own - own[0]) ** 2).sum(1).max()) if z - a > 1 else 0.0
            centre.append(self.order[a]), radius.append(float(far) * (1 + 1e-9)), first.append(a), last.append(z), child.append(0), end.append(0)
            self.level.append(level)

        add(0, len(x), 0)
        self.level[0] = int(np.ceil(np.log2(max(radius[0], 1))))
        k = 0
        while k < len(centre):
            a, z = first[k], last[k]
            if z - a > leaf and radius[k] > 0:
                level = min(self.level[k], int(np.ceil(np.log2(radius[k]))))  # levels without a second child are left out
                rows = self.order[a:z]
                centres, owner = net(x[rows], 2.0 ** (level - 1))
                while len(centres) == 1:
                    level -= 1
                    centres, owner = net(x[rows], 2.0 ** (level - 1))
                # a child's centre first, the node's own centre before all
                by = np.lexsort((np.arange(len(rows)), owner != np.arange(len(rows)), owner))
                self.order[a:z] = rows[by]
                edge = np.append(np.nonzero(np.append(True, np.diff(owner[by]) != 0))[0], z - a) + a
                child[k] = len(centre)
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    add(lo, hi, level - 1)
                end[k] = len(centre)
            k += 1
        self.radius, self.first, self.last = np.array(radius), np.array(first), np.array(last)
        self.child, self.end = np.array(child), np.array(end)
        self.centres = np.array(centre)  # rows
        self.norm = np.sqrt((x[self.centres] ** 2).sum(1))


class CoverSpace:
    """The top of the cover tree of the whole table: cells around the first centres."""

    edges = range(1)

    def __init__(self, sample: np.ndarray, top: float, cells: int):
        x = np.clip(256 * sample, -LARGEST, LARGEST)
        self.centres = x[:1]
        nearest = ((x - x[0]) ** 2).sum(1)
        while len(self.centres) < cells and nearest.max() > 0:
            self.centres = np.concatenate([self.centres, x[[nearest.argmax()]]])
            nearest = np.minimum(nearest, ((x - self.centres[-1]) ** 2).sum(1))

    def place(self, rows: np.ndarray, query: bool) -> np.ndarray:
        x = np.clip(256 * rows, -LARGEST, LARGEST)
        return ((self.centres**2).sum(1) - 2 * (x @ self.centres.T)).argmin(1)

    def high(self, rows: np.ndarray, cell: int) -> list[float]:
        """The radius of the cell, in whole components."""
        x = integers(rows).astype(float)
        return [float(np.sqrt(((x - self.centres[cell]) ** 2).sum(1).max())) * (1 + 1e-9)]

    def reach(self, q: np.ndarray, kth: np.ndarray, cells: list[int], high: np.ndarray) -> np.ndarray:
        x = integers(q).astype(float)
        norm, own = np.sqrt((x**2).sum(1))[:, None], self.centres[cells]
        bound = x @ own.T + norm * high[:, 0]
        return bound + 1e-9 * norm * (np.sqrt((own**2).sum(1)) + high[:, 0]) + 1 >= kth[:, None]


def index(ids: np.ndarray, rows: np.ndarray):
    """Ids and floor(256 x) in tree order, with the tree."""
    x = integers(rows)
    if x.dtype == object:
        return ids, x, None
    tree = CoverTree(x)
    return ids[tree.order], x[tree.order], tree


def _exact(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Scores of pairs of rows, as integers of any size."""
    whole = lambda v: v if isinstance(v, int) else int(v)
    return [sum(whole(a) * whole(b) for a, b in zip(r, s, strict=True)) for r, s in zip(x.tolist(), q.tolist(), strict=True)]


def _best(names: np.ndarray, who: np.ndarray, vec: np.ndarray, score: list[int], k: int):
    """The k best of each query by integers of any size; ties to the smaller id."""
    out: list[list[int]] = [[], [], []]
    at = sorted(range(len(who)), key=lambda i: (who[i], -score[i], vec[i]))
    last, n = -1, 0
    for i in at:
        n = n + 1 if who[i] == last else 1
        last = who[i]
        if n <= k:
            out[0].append(int(names[who[i]])), out[1].append(int(vec[i])), out[2].append(max(-(2**63), min(2**63 - 1, score[i])))
    return tuple(np.array(o, np.int64) for o in out)


def find(shard, names: np.ndarray, rows: np.ndarray, kth: np.ndarray, k: int):
    ids, x, tree = shard
    q = integers(rows)
    if tree is None or q.dtype == object:  # beyond the range of doubles
        who, point = np.divmod(np.arange(len(q) * len(ids)), len(ids))
        other = ids[point] != names[who]
        who, point = who[other], point[other]
        return _best(names, who, ids[point], _exact(np.asarray(x, object)[point], np.asarray(q, object)[who]), k)
    group = CoverTree(q)
    q, names, kth = q[group.order], names[group.order], kth[group.order]
    spot = np.empty(len(x), np.int64)
    spot[tree.order] = np.arange(len(x))
    centre = x[spot[tree.centres]]
    norms, sizes = np.sqrt((q**2).sum(1)), tree.last - tree.first
    # what rounding can add: nothing while all partial sums are whole numbers below 2**53
    safe = x.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2.0**53
    slack = np.zeros(len(q)) if safe else norms * np.sqrt((x**2).sum(1).max()) * x.shape[1] * 2.0**-50
    worst = kth - 2 * slack - (0 if safe else np.nan_to_num(np.abs(kth), posinf=0) * 2.0**-50)
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)

    def compare(a: int, z: int, points: np.ndarray) -> None:
        score = q[a:z] @ x[points].T
        score[names[a:z, None] == ids[points]] = -np.inf
        for i in range(a, z):
            good = np.nonzero(score[i - a] >= max(worst[i], -1.7e308))[0]
            if not len(good):
                continue
            p, s = np.append(held[i][0], points[good]), np.append(held[i][1], score[i - a, good])
            if len(s) > k:
                line = np.partition(s, len(s) - k)[len(s) - k] - 2 * slack[i]
                worst[i] = max(worst[i], line)
                # of those on the line, if it is exact, only the smallest ids can count
                by = np.lexsort((ids[p], -s))[: k if safe else None]
                by = by[s[by] >= line]
                p, s = p[by], s[by]
            held[i] = p, s

    def visit(g: int, front: np.ndarray) -> None:
        a, z = group.first[g], group.last[g]
        inner = group.end[g] > group.child[g]
        if inner:
            c, r = q[a], group.radius[g]
            size = float(np.sqrt(c @ c))
            far = tree.radius[front]
            bound = centre[front] @ c + r * tree.norm[front] + far * size + r * far
            bound += 1e-12 * (size + r) * (tree.norm[front] + far) + slack[a:z].max() + 1e-6
            front = front[bound >= worst[a:z].min()]
            opened = np.concatenate([np.arange(tree.child[n], tree.end[n]) if tree.end[n] > tree.child[n] else [n] for n in front.tolist()]).astype(np.int64) if len(front) else front
            children = np.arange(group.child[g], group.end[g])
            leaves = children[group.end[children] == group.child[children]]
            for child in children[group.end[children] > group.child[children]].tolist():
                visit(child, opened)
            # leaves that lie together are asked together, each query with its own bound
            at = 0
            while at < len(leaves):
                stop = at + 1
                while stop < len(leaves) and leaves[stop] == leaves[stop - 1] + 1 and group.last[leaves[stop]] - group.first[leaves[at]] <= 256:
                    stop += 1
                ask(group.first[leaves[at]], group.last[leaves[stop - 1]], opened)
                at = stop
        else:
            ask(a, z, front)

    def ask(a: int, z: int, front: np.ndarray) -> None:
        while len(front):
            over = q[a:z] @ centre[front].T + norms[a:z, None] * tree.radius[front]
            over += 1e-12 * norms[a:z, None] * (tree.norm[front] + tree.radius[front]) + slack[a:z, None] + 1e-6
            good = (over >= worst[a:z, None]).any(0)
            front, over = front[good], over[:, good]
            order = np.argsort(-over.max(0), kind="stable")
            front = front[order]
            leaf = tree.end[front] == tree.child[front]
            now = front[leaf]
            some = now[: max(1, int(np.searchsorted(np.cumsum(sizes[now]), AT_ONCE)))]
            if len(some):
                compare(a, z, np.concatenate([np.arange(tree.first[n], tree.last[n]) for n in some.tolist()]))
            opened = [np.arange(tree.child[n], tree.end[n]) for n in front[~leaf].tolist()]
            front = np.concatenate([now[len(some) :], *opened])

    visit(0, np.zeros(1, np.int64))
    who = np.repeat(np.arange(len(q)), [len(p) for p, _ in held])
    point = np.concatenate([p for p, _ in held])
    score = [int(s) for _, v in held for s in v] if safe else _exact(x[point], q[who])
    return _best(names, who, ids[point], score, k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact top k of vectors (vec_id, embedding) for queries (the same columns)."""
    return search(valid(vectors), valid(queries), k, CoverSpace, index, find, "long")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)
