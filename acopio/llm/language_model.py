"""Operator 2: language-model scores by a hierarchical Pitman-Yor model.

Model: a word follows a context, the whole word before it (the start of a text: the end token).
Each context is a restaurant of discount d and strength s; a word with c customers at t of its T
tables has probability (c - d t + (s + d T) G(w)) / (s + C) there.  All context restaurants share
one parent: their tables are the customers of the root restaurant, whose discount is 0 and whose
base is uniform over the V known words and one slot for all others, so that its distribution G
given its customers is Dirichlet and can be drawn.

Method: Gibbs sampling, each step exact for this one model, whatever the size of a dish.
  root: G given the number of tables of every word, one Gamma draw a word.
  contexts: given G and a Gamma(s / d + T) draw g for each restaurant its dishes are independent:
    P(t) is proportional to (d g G(w))^t S(c, t), S the generalised Stirling numbers.  All c customers of a
    dish are seated anew by the Chinese-restaurant process and the seating is accepted with the
    Metropolis ratio, in which S cancels.  Seating jumps from one opened table to the
    next, so a dish of a billion customers costs as many steps as it has tables.
  strength and the root's base weight: drawn from a grid by their likelihood.
The discount comes from the numbers of dishes with one and two customers.  Predictive
probabilities are averaged over the samples after burn-in.

Dealing: a pass over the texts sends each pack's distinct (context, word) pairs, with the documents that
hold them, to cells by context; training counts and the pairs of held-out texts lie in the
same cell, which is sampled and scored there.  Words meet by word in root cells, which get
sums of tables and give draws back.  A context with many of the tokens (found in a sample of
texts; it decides the dealing alone) is spread over several cells by its words, with its totals, at most HEAVY,
kept by the driver.  A pair held LONG times or more by a pack sends its number only and gets
one probability back, so one frequent pair weighs a few bytes a pack.

Words are known by 64 bits of their hash: among ten million words two collide with a probability
of 3 in a million, among a billion of 3 in a hundred.

Defined results: null text is empty and has only the end token; with no training tokens every
probability is 1 / (V + 1) = 1; an empty table gives no rows; repeated rows score alike; null ids count
as the empty text; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from acopio.llm.bpe import Remembered
from acopio.llm.shared import buckets, crc_mod, release, small_batches, text_slices, tidy, written, written_apart

BURN_IN, SAMPLES, INNER = 1, 3, 2
END = 0
PACK = 5 << 20
LONG, HEAVY, HEAVY_DOCS, COMMON = 64, 4_000, 4_000, 1 << 15
#: What strength and the root's base weight (a word's share) are drawn from.
STRENGTHS, WEIGHTS = 10.0 ** np.linspace(-2, 2, 17), 10.0 ** np.linspace(-3, 1, 17)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _code(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct values of sorted arrays, sorted: a merge."""
    x = np.sort(np.concatenate(parts), kind="stable")
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _small(x: np.ndarray) -> np.ndarray:
    top = x.max(initial=0)
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.int64)


_KINDS = "BHIQlfd"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value with a few bytes of header."""
    head = b"".join(_KINDS.index(x.dtype.char if x.dtype.char != "L" else "Q").to_bytes(1, "little") + len(x).to_bytes(6, "little") for x in arrays)
    raw = len(arrays).to_bytes(1, "little") + head + b"".join(x.tobytes() for x in arrays)
    return len(raw).to_bytes(6, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(value) -> list[np.ndarray]:
    data = memoryview(value.as_buffer() if isinstance(value, pa.Scalar) else value)
    raw = memoryview(pa.decompress(data[6:], decompressed_size=int.from_bytes(data[:6], "little"), codec="zstd", asbytes=True))
    out, at = [], 1 + 7 * raw[0]
    for k in range(raw[0]):
        kind = np.dtype(_KINDS[raw[1 + 7 * k]])
        n = int.from_bytes(raw[2 + 7 * k : 8 + 7 * k], "little")
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def lgamma(x) -> np.ndarray:
    """log Gamma of positive numbers, by Stirling's series seven steps on."""
    x = np.asarray(x, float)
    if x.ndim == 1 and x.size < 48:  # a call of a few numbers costs less one by one
        return np.fromiter(map(math.lgamma, x), float, x.size)
    rise = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    y = x + 7
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    far = x > 1e30
    return np.where(far, series, series - np.log(np.where(far, 1, rise)))


# ---------------------------------------------------------------- seating


def rising(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log of z (z + 1) ... (z + n - 1), for whole n of 1 and more."""
    top = int(n.max(initial=1))
    out = z
    for k in range(1, min(top, 4)):
        out = np.where(n > k, out * (z + k), out)
    out = np.log(out)
    if top > 4:
        far = np.nonzero(n > 4)[0]
        out[far] = lgamma(z[far] + n[far]) - lgamma(z[far])
    return out


def seated(c: np.ndarray, lam: np.ndarray, d: float, rng=None, many: np.ndarray | None = None, when: np.ndarray | None = None):
    """Seatings of dishes whose c customers sit down one after the other: how many opened a table after the
    first; how many sat when they did, dish after dish; and the log of a seating's target over its proposal.

    When j sit at t tables the next customer opens one with weight y and joins with weight j - d t.  y is lam
    times (end / c)^d, end the next power of two or c: a table that is opened early makes all later joins less
    likely.  Only customers who open one are drawn; without rng, ``many`` and ``when`` are
    followed instead.
    """
    own, i, log = np.zeros(len(c), np.int64), np.ones(len(c), np.int64), np.zeros(len(c))
    owner, moments = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin = np.cumsum(many) - many if rng is None else None
    active = np.nonzero(c > 1)[0]
    end = np.full(len(active), 2)
    while len(active):
        n, at, tables = c[active], i[active], own[active]
        end = np.minimum(end, n)
        sat = at - d * (tables + 1)
        part = end / n
        y = lam[active] * part**d
        if rng is None:
            to = end + 1
            left = np.nonzero(tables < many[active])[0]
            to[left] = when[begin[active[left]] + tables[left]] + 1
            opens = to <= end
            to = np.minimum(to, end)
        else:
            # log of the probability that nobody opens a table until all of a block sit
            u = np.log(rng.random(len(active)))
            opens = rising(sat, end - at) - rising(sat + y, end - at) <= u
            to, k = end.copy(), np.nonzero(opens)[0]
            k = k[end[k] - at[k] > 1]
            lo, hi = at[k], end[k]
            # nearly, the probability that nobody opens falls as a power of those who sit: where that says, first
            guess = at[k] + np.clip((sat[k] + y[k] / 2 - 0.5) * np.expm1(np.minimum(-u[k] / y[k], 50)), 0, hi - lo).astype(np.int64)
            step = 0
            while (wide := hi - lo > 1).any():  # nobody opens until lo sit; somebody does before hi sit
                mid = np.clip(guess + step, lo + 1, np.maximum(hi - 1, lo + 1)) if step < 2 else (lo + hi) // 2
                step += 1
                some = np.maximum(mid - at[k], 1)
                yes = rising(sat[k], some) - rising(sat[k] + y[k], some) <= u[k]
                hi, lo = np.where(wide & yes, mid, hi), np.where(wide & ~yes, mid, lo)
            to[k] = hi
        log[active] += rising(sat + y, to - at) - np.where(opens, d * np.log(part), 0)
        owner.append(active[opens]), moments.append(to[opens] - 1)
        own[active] += opens
        i[active] = to
        stay = to < n
        active, end = active[stay], np.where(to == end, 2 * end, end)[stay]
    owner, moments = np.concatenate(owner), np.concatenate(moments)
    return own, moments[np.argsort(owner, kind="stable")], log


def resat(c: np.ndarray, many: np.ndarray, when: np.ndarray, lam: np.ndarray, d: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """A Metropolis step for dishes whose seatings have a probability proportional to lam^t times j - d t for
    every customer who joined a table when j sat at t: over all seatings that is lam^t S(c, t).

    A seating is proposed by the Chinese-restaurant process of ``seated``; the old one is weighed under the lam of now.
    """
    out = many.copy()
    # of two customers the second opens a table with the target's own probability: nothing to weigh
    two, at = np.nonzero(c == 2)[0], np.nonzero(c > 2)[0]
    out[two] = rng.random(len(two)) * (lam[two] + 1 - d) < lam[two]
    opened = np.repeat(np.arange(len(c)), many)
    when_at = when[c[opened] > 2]
    old, x = many[at], np.maximum(lam[at], 1e-300)
    new, new_when, log = seated(c[at], x, d, rng)
    yes = np.log(rng.random(len(at))) < log - seated(c[at], x, d, None, old, when_at)[2]
    out[at] = np.where(yes, new, old)
    stays, comes = np.repeat(~yes, old), np.repeat(yes, new)
    owner = np.concatenate([two[out[two] == 1], np.repeat(at, old)[stays], np.repeat(at, new)[comes]])
    moments = np.concatenate([np.ones(int(out[two].sum()), np.int64), when_at[stays], new_when[comes]])
    return out, moments[np.argsort(owner, kind="stable")]


def sweep(u: np.ndarray, c: np.ndarray, many: np.ndarray, when: np.ndarray, word: np.ndarray, share: np.ndarray, contexts: int, s: float, d: float, rng, given=None):
    """Seatings of the dishes (context u, word) of a cell, drawn anew: tables after the first, and when they were
    opened.  share: G of the words; given: for contexts that lie in several cells (places, g)."""
    g = rng.standard_gamma(s / d + np.bincount(u, many + (c > 0), contexts))
    if given is not None:
        g[given[0]] = given[1]
    return resat(c, many, when, d * g[u] * share[word], d, rng)


def drawn(rng, grid: np.ndarray, log: np.ndarray) -> float:
    p = np.exp(log - log.max())
    return float(grid[np.searchsorted(np.cumsum(p / p.sum()), rng.random()).clip(0, len(grid) - 1)])


def strength_log(tables: np.ndarray, customers: np.ndarray, d: float) -> np.ndarray:
    """Of each strength the log likelihood of restaurants, in parts that can be added."""
    if not len(tables):
        return np.zeros(len(STRENGTHS))
    most = int(np.max(customers)) + 1
    pairs, n = np.unique(np.asarray(tables, np.int64) * most + np.asarray(customers, np.int64), return_counts=True)  # most contexts are rare
    r = STRENGTHS[:, None]
    return ((lgamma(r / d + pairs // most) - lgamma(r / d) + lgamma(r) - lgamma(r + pairs % most)) * n).sum(1)


def weight_log(n: int, total_log: float) -> np.ndarray:
    """Of each base weight the log likelihood of a distribution over n words whose logs add to total_log."""
    return lgamma(WEIGHTS * n) - n * lgamma(WEIGHTS) + (WEIGHTS - 1) * total_log


# ---------------------------------------------------------------- texts to cells


class Tokens:
    """Codes and documents of the tokens of a list of texts."""

    def __init__(self, remember: int = 150_000):
        self.memory = Remembered(_code, remember)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [], []
        last = np.array([END], np.uint64)
        for t in texts:
            words = t.encode("utf-8", "replace").lower().split()
            parts += [np.fromiter(map(self.memory.__getitem__, words), np.uint64, len(words)), last]
            sizes.append(len(words) + 1)
        return np.concatenate(parts), np.repeat(np.arange(len(texts)), sizes)


def _heavy(bare: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with more than a quarter of a cell's share of the tokens, over how many cells each
    goes, and at most COMMON frequent words, which packs name by number.  From about HEAVY_DOCS documents:
    it changes where a dish lies and how a word is written, not what is counted."""
    part = min(1.0, HEAVY_DOCS / max(1, bare.count()))
    some = bare.where(F.xxhash64("i", F.lit(11)) / 2.0**64 + 0.5 <= part)

    def run(batches):
        tokens = Tokens()
        for _, texts in text_slices(batches, "t", PACK):
            words, n = np.unique(tokens(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["w", "n"])
        del tokens
        release()

    table = written(some.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    counts = table.df()
    total = counts.agg(F.sum("n")).first()[0] or 1
    found = counts.where(F.col("n") > max(8.0, total / min(4 * cells, HEAVY))).collect()  # at most HEAVY words
    often = counts.orderBy(F.desc("n"), "w").limit(COMMON).toArrow()["w"].to_numpy()  # at most COMMON numbers
    table.drop()
    words = np.array([r.w for r in found], np.int64).view(np.uint64)
    parts = np.minimum(cells, np.ceil(np.array([r.n for r in found], float) / total * 4 * cells)).astype(np.int64)
    order = np.argsort(words)
    return words[order], parts[order], np.sort(often.astype(np.int64).view(np.uint64))


def _where(u: np.ndarray, w: np.ndarray, cells: int, heavy) -> np.ndarray:
    """The cell of each pair of codes."""
    at = _mix(u)
    if len(heavy[0]):
        k = np.minimum(np.searchsorted(heavy[0], u), len(heavy[0]) - 1)
        at = at + np.where(heavy[0][k] == u, _mix(w + np.uint64(77)) % heavy[1][k].astype(np.uint64), np.uint64(0))
    return (at % np.uint64(cells)).astype(np.int64)


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _slices_of(batches):
    """(rows, texts) of packs of about PACK bytes: several batches together."""
    rows, texts, size = [], [], 0
    for part, some in text_slices(batches, "t", PACK):
        rows.append(part.select(["i", "held_out"]))
        texts += some
        size += part.column("t").nbytes
        if size >= PACK:
            yield pa.Table.from_batches(rows), texts
            rows, texts, size = [], [], 0
    if rows:
        yield pa.Table.from_batches(rows), texts


def _packs(cells: int, shared):
    """Of packs of documents: for each cell its pairs and who holds them, and the pack's own row."""

    def run(batches):
        *heavy, common = shared.value
        tokens = Tokens()
        task = TaskContext.get().partitionId()
        for nth, (part, texts) in enumerate(_slices_of(batches)):
            name = task << 32 | nth  # the same when a lost task runs again
            out = part.column("held_out").to_numpy()
            turn = np.argsort(out, kind="stable")  # training documents first
            train = int((~out).sum())
            code, doc = tokens([texts[k] for k in turn.tolist()])
            many, doc = len(texts), doc.astype(np.int32)
            words, pair = np.unique(code, return_inverse=True)
            del code, texts
            pair[1:] += pair[:-1] * len(words)  # the end token, code 0, comes before each first word
            order = np.argsort(pair, kind="stable")
            by, doc_by = pair[order], doc[order]
            del pair, order
            start = np.nonzero(np.append(True, by[1:] != by[:-1]))[0]
            n = np.diff(np.append(start, len(by)))
            u, w = by[start] // len(words), by[start] % len(words)
            del by
            taught = np.add.reduceat((doc_by < train).astype(np.int64), start)
            cell = _where(words[u], words[w], cells, heavy)
            turn_by = np.argsort(cell, kind="stable")
            place = np.minimum(np.searchsorted(common, words), max(0, len(common) - 1))
            often = common[place] == words if len(common) else np.zeros(len(words), bool)
            cut = np.searchsorted(cell[turn_by], np.arange(cells + 1))
            long = turn_by[n[turn_by] >= LONG]
            head = pickle.dumps((part.column("i").take(pa.array(turn)).to_pylist(), out[turn], np.bincount(doc, minlength=many), _small(cell[long]), _small(n[long]), _small(doc_by[_ranges(start[long], n[long])])), 5)
            rows = [(name % cells, name, None, head)]
            for b in np.nonzero(np.diff(cut))[0].tolist():
                x = turn_by[cut[b] : cut[b + 1]]
                own, first = np.unique(u[x], return_index=True)
                mine, inv = np.unique(w[x], return_inverse=True)
                short = x[n[x] < LONG]
                known = often[mine]
                rows.append((b, name, packed(words[own], _small(np.diff(np.append(first, len(x)))), _small(np.diff(place[mine[known]], prepend=0)), words[mine[~known]], _small(inv), _small(n[x]), _small(taught[x]), _small(doc_by[_ranges(start[short], n[short])])), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["cell", "pack", "data", "head"])
        del tokens
        release()

    return run


def _gathered(roots: int, shared):
    """Of a cell: its words (by root cell), its dishes, for each pack who holds them; and the packs' own rows."""

    def run(table: pa.Table) -> pa.Table:
        *heavy, common = shared.value
        words_of = lambda step, rest: np.sort(np.append(common[np.cumsum(step, dtype=np.int64)], rest), kind="stable")
        cell = table.column("cell")[0].as_py()
        rows = [("head", cell, p, h) for p, h in zip(table.column("pack").to_pylist(), table.column("head").to_pylist(), strict=True) if h is not None]
        packs = [(p, x) for p, x in zip(table.column("pack").to_pylist(), table.column("data"), strict=True) if x.is_valid]
        if packs:
            us, ws = [], []
            for _, x in packs:
                got = unpacked(x)
                us.append(got[0]), ws.append(words_of(*got[2:4]))
            us, ws = _distinct(us), _distinct(ws)
            keys = []
            for _, x in packs:
                u, per, step, rest, inv, *_ = unpacked(x)
                keys.append(np.repeat(np.searchsorted(us, u), per) * len(ws) + np.searchsorted(ws, words_of(step, rest))[inv])
            every = _distinct(keys)
            count, lists = np.zeros(len(every), np.int64), []
            for (name, x), key in zip(packs, keys, strict=True):
                *_, n, taught, docs = unpacked(x)
                at = np.searchsorted(every, key)
                count += np.bincount(at, taught, len(every)).astype(np.int64)
                lists.append((name, packed(_small(np.diff(at, prepend=0)), n, docs)))
            root = _mix(ws) % np.uint64(roots)
            turn = np.argsort(root, kind="stable")
            place = np.empty(len(ws), np.int64)
            place[turn] = np.arange(len(ws))
            u, w = every // len(ws), place[every % len(ws)]
            k = np.minimum(np.searchsorted(heavy[0], us), max(0, len(heavy[0]) - 1))
            on = np.nonzero(heavy[0][k] == us)[0] if len(heavy[0]) else np.zeros(0, np.int64)
            words = packed(ws[turn], root[turn], np.bincount(w, count, len(ws)).astype(np.int64), np.bincount(w, count > 0, len(ws)).astype(np.int64))
            state = packed(_small(np.bincount(u, minlength=len(us))), _small(w), _small(count), np.zeros(len(w), np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.float32), np.zeros(0, np.float32), on, k[on], np.array([len(ws)]))
            rows += [("words", cell, 0, words), ("state", cell, 0, state), ("lists", cell, 0, pickle.dumps(lists, 5))]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["kind", "cell", "pack", "data"])

    return run


# ---------------------------------------------------------------- the root


def _first_up(batches):
    """Of cells: to each root cell the words' codes, customers and tables."""
    for batch in batches:
        for b, x in zip(batch.column("cell").to_pylist(), batch.column("data"), strict=True):
            code, root, n, t = unpacked(x)
            yield _sent(b, root.astype(np.int64), code, _small(n), _small(t))


def _sent(cell: int, root: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    to, first = np.unique(root, return_index=True)
    edge = np.append(first, len(root)).tolist()
    rows = [packed(*(v[a:z] for v in values)) for a, z in zip(edge[:-1], edge[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([cell] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["root", "cell", "data"])


def _rooted(table: pa.Table) -> pa.Table:
    """Of a root cell: its words' customers, and which of them each cell has, in the cell's order."""
    got = [unpacked(x) for x in table.column("data")]
    words, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    n, t = (np.bincount(at, np.concatenate([g[k] for g in got]), len(words)).astype(np.int64) for k in (1, 2))
    cell = table.column("cell").to_numpy().astype(np.int64)
    state = packed(n, t, cell, np.array([len(g[0]) for g in got]), _small(at))
    return pa.table([pa.array([table.column("root")[0].as_py()], pa.int32()), pa.array([state], pa.binary()), pa.array([float(n.sum())]), pa.array([float((n > 0).sum())])], names=["root", "state", "n", "v"])


def _down(weight: float, seed: int, with_counts: bool):
    """Of a root cell: a draw for each known word, sent to the cells that have it (-1: unknown)."""

    def run(root: pa.Table, ups: pa.Table) -> pa.Table:
        names = ["cell", "root", "data", "g", "log_g"]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64())
        n, t, cell, sizes, at = unpacked(root.column("state")[0])
        b = root.column("root")[0].as_py()
        if ups.num_rows:
            now = dict(zip(ups.column("cell").to_pylist(), ups.column("data"), strict=True))
            edge = np.append(0, np.cumsum(sizes))
            t = np.zeros(len(n), np.int64)
            for k, c in enumerate(cell.tolist()):
                if c in now:
                    t += np.bincount(at[edge[k] : edge[k + 1]], unpacked(now[c])[0], len(n)).astype(np.int64)
        known = n > 0
        g = np.where(known, np.random.default_rng((seed, b)).standard_gamma(weight + t), -1).astype(np.float32)
        real = g[known].astype(float)
        edge = np.append(0, np.cumsum(sizes)).tolist()
        rows = [(c, b, packed(g[at[a:z]], *([_small(n[at[a:z]])] * with_counts)), None, None) for c, a, z in zip(cell.tolist(), edge[:-1], edge[1:], strict=True)]
        rows.append((-1, b, None, float(real.sum()), float(np.log(np.maximum(real, 1e-40)).sum())))
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


# ---------------------------------------------------------------- the contexts


class Cell:
    """Dishes of a cell; ``share``: G of its words when they were seated last."""

    def __init__(self, state):
        per, self.word, c, many, when, acc, share, self.here, self.heavy, words, *n = unpacked(state)
        self.n = n[0] if n else np.zeros(0, np.uint8)  # customers of each word, once they are known
        self.many, self.words = len(per), int(words[0])  # contexts, words
        self.u = np.repeat(np.arange(self.many), per)
        self.per, self.c, self.opened, self.when = per, c.astype(np.int64), many.astype(np.int64), when.astype(np.int64)
        self.acc = acc.astype(float) if len(acc) else np.zeros(len(c))
        self.share = share

    @property
    def t(self) -> np.ndarray:
        return self.opened + (self.c > 0)

    def totals(self, shared=None) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of the contexts; shared: those of contexts that lie in several cells."""
        c, t = np.bincount(self.u, self.c, self.many), np.bincount(self.u, self.t, self.many)
        if shared is not None and len(self.here):
            c[self.here], t[self.here] = shared[0][self.heavy], shared[1][self.heavy]
        return c, t

    def probabilities(self, shared, s: float, d: float) -> np.ndarray:
        c, t = self.totals(shared)
        return (np.maximum(self.c - d * self.t, 0) + (s + d * t)[self.u] * self.share[self.word].astype(float)) / (s + c)[self.u]

    def packed(self) -> bytes:
        return packed(self.per, self.word, _small(self.c), _small(self.opened), _small(self.when), self.acc.astype(np.float32), self.share.astype(np.float32), self.here, self.heavy, np.array([self.words]), _small(self.n))


def _received(rows: pa.Table, norm: float, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """G of a cell's words, and (with the last draw) their customers, from what the root cells sent."""
    order = np.argsort(rows.column("root").to_numpy(), kind="stable").tolist()
    got = [unpacked(rows.column("data")[k]) for k in order]
    g = np.concatenate([x[0] for x in got]).astype(float)
    n = [x[1].astype(np.int64) for x in got if len(x) > 1]
    return np.where(g < 0, unknown, g) / norm, np.concatenate(n) if n else np.zeros(0, np.uint8)


def _swept(shared):
    """Of a cell: seats drawn anew given the root's draw; the cell's new row, its tables for
    the root cells, and what the driver adds up."""

    def run(state: pa.Table, down: pa.Table) -> pa.Table:
        seed, norm, unknown, s, d, g, before, heavy_totals = shared.value
        b = state.column("cell")[0].as_py()
        x = Cell(state.column("state")[0])
        if before:  # the last seating was a sample: its probabilities count
            x.acc += x.probabilities(heavy_totals, *before)
        x.share, x.n = _received(down, norm, unknown)
        rng = np.random.default_rng((seed, b))
        given = (x.here, g[x.heavy]) if len(x.here) else None
        for _ in range(INNER):
            x.opened, x.when = sweep(x.u, x.c, x.opened, x.when, x.word, x.share, x.many, s, d, rng, given)
        c, t = x.totals()
        alone = np.ones(x.many, bool)
        alone[x.here] = False
        rows = [(b, None, x.packed(), None, None), (-1, None, None, strength_log(t[alone], c[alone], d).tolist(), None)]
        rows += [(-2, int(h), None, [float(c[k]), float(t[k])], None) for k, h in zip(x.here.tolist(), x.heavy.tolist(), strict=True)]
        tables = np.bincount(x.word, x.t, x.words).astype(np.int64)
        order = np.argsort(down.column("root").to_numpy(), kind="stable").tolist()
        at = 0
        for k in order:
            n = len(unpacked(down.column("data")[k])[0])
            rows.append((b, down.column("root")[k].as_py(), None, None, packed(_small(tables[at : at + n]))))
            at += n
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["cell", "root", "state", "sums", "up"])

    return run


def _first_sums(batches):
    """Of cells: dishes of one and two customers, and the totals of contexts in several cells."""
    for batch in batches:
        for x in map(Cell, batch.column("state")):
            c, t = x.totals()
            rows = [(-1, [float((x.c == 1).sum()), float((x.c == 2).sum())])] + [(int(h), [float(c[k]), float(t[k])]) for k, h in zip(x.here.tolist(), x.heavy.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["root", "sums"])


def _added(df: DataFrame, n: int) -> dict[int, np.ndarray]:
    """The sums by ``root`` of lists of n numbers: a row for all, and one for each of at most HEAVY contexts."""
    rows = df.groupBy("root").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(n)]).collect()
    return {r[0]: np.array([x or 0.0 for x in r[1:]]) for r in rows}


def _by_heavy(sums: dict[int, np.ndarray], many: int) -> tuple[np.ndarray, np.ndarray]:
    c, t = np.zeros(many), np.zeros(many)
    for k, x in sums.items():
        if k is not None and k >= 0:
            c[k], t[k] = x[:2]
    return c, t


# ---------------------------------------------------------------- scores


def _answered(shared):
    """Of cells: sums of log probabilities, base and known tokens for the documents of each pack."""

    def out(held):
        rows = [(name, packed(_small(at := np.nonzero(s[2])[0]), s[0][at], s[1][at], _small(s[2][at].astype(np.int64)), _small(s[3][at].astype(np.int64))), None) for name, s in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["pack", "data", "long"])

    def run(batches):
        before, heavy_totals, n, v, most = shared.value
        held: dict[int, list[np.ndarray]] = {}
        docs_held = 0
        for batch in batches:
            for b, state, lists in zip(batch.column("cell").to_pylist(), batch.column("state"), batch.column("lists"), strict=True):
                x = Cell(state)
                total = x.n.astype(np.int64)
                log = np.log10((x.acc + x.probabilities(heavy_totals, *before)) / SAMPLES)
                base, known = np.log10((total + 1) / (n + v + 1))[x.word], (total > 0)[x.word]
                rows = []
                for name, data in pickle.loads(lists.as_py()):
                    step, many, docs = unpacked(data)
                    at = np.cumsum(step, dtype=np.int64)
                    long = many >= LONG
                    if long.any():
                        k = at[long]
                        rows.append((name, None, packed(np.array([b]), log[k], base[k], known[k].astype(np.uint8))))
                    if len(docs):
                        k = np.repeat(at[~long], many[~long])
                        size = int(docs.max()) + 1
                        new = [np.bincount(docs, y[k], size) for y in (log, base)] + [np.bincount(docs, minlength=size), np.bincount(docs, known[k], size)]
                        old = held.get(name)
                        if old is None or len(old[0]) < size:
                            docs_held += size - (0 if old is None else len(old[0]))
                            held[name] = [y if old is None else y + np.pad(o, (0, size - len(o))) for y, o in zip(new, old or new, strict=True)]
                        else:
                            for o, y in zip(old, new, strict=True):
                                o[:size] += y
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["pack", "data", "long"])
                if docs_held > most:
                    yield out(held)
                    held, docs_held = {}, 0
        if held:
            yield out(held)
        del held
        release()

    return run


def _merged(kind, n: int):
    def run(heads: pa.Table, answers: pa.Table) -> pa.Table:
        ids, out, tokens, cell, many, docs = pickle.loads(heads.column("head")[0].as_py())
        log, base, known = (np.zeros(len(ids)) for _ in range(3))
        many, cell = many.astype(np.int64), cell.astype(np.int64)
        edge, first = np.append(0, np.cumsum(many)), np.searchsorted(cell, np.arange(cell.max(initial=-1) + 2))
        for data, long in zip(answers.column("data"), answers.column("long"), strict=True):
            if data.is_valid:
                at, a, b, _, k = unpacked(data)
                log[at] += a
                base[at] += b
                known[at] += k
            else:
                own, a, b, k = unpacked(long)
                lo, hi = first[own[0]], first[own[0] + 1]
                who, each = docs[edge[lo] : edge[hi]], many[lo:hi]
                for total, y in ((log, a), (base, b), (known, k)):
                    total += np.bincount(who, np.repeat(y, each), len(ids))
        cols = [pa.array(ids, kind), pa.array(out, pa.bool_()), pa.array(tokens, pa.int64()), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(len(ids), n), pa.int64()), pa.array(base), pa.array(log)]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, folds: int = 7, out_fold: int = 2, burn_in: int = BURN_IN, seed: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    cells = 2 * buckets(spark)
    roots = max(4, cells // 8)  # a root cell holds words with a few numbers each
    rng = np.random.default_rng(seed)
    bare = docs.select(F.col("doc_id").alias("i"), (crc_mod("doc_id", folds) == out_fold).alias("held_out"), F.coalesce("text", F.lit("")).alias("t"))
    heavy = _heavy(bare, cells)
    dealing = spark.sparkContext.broadcast(heavy)
    dealt = bare.mapInArrow(_packs(cells, dealing), "cell int, pack long, data binary, head binary")
    gathered = dealt.groupBy("cell").applyInArrow(_gathered(roots, dealing), "kind string, cell int, pack long, data binary")
    made = written_apart(gathered, "kind", ("head", "words", "state", "lists"))
    tidy(spark)
    first = made["state"].df().select("cell", F.col("data").alias("state"))
    ups = made["words"].df().select("cell", "data").mapInArrow(_first_up, "root int, cell int, data binary")
    roots = written(ups.groupBy("root").applyInArrow(_rooted, "root int, state binary, n double, v double"))
    made["words"].drop()
    n, v = (int(x or 0) for x in roots.df().agg(F.sum("n"), F.sum("v")).first())
    sums = _added(first.select("state").mapInArrow(_first_sums, "root int, sums array<double>"), 2)
    totals = _by_heavy(sums, len(heavy[0]))
    one, two = sums.get(-1, np.zeros(2))
    d = float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one else 0.5
    s, weight, before = 1.0, 1.0, None
    state, ups, old = first, None, made["state"]
    for turn in range(burn_in + SAMPLES):
        empty = spark.createDataFrame([], "root int, cell int, data binary")
        last = turn == burn_in + SAMPLES - 1
        sent = roots.df().groupBy("root").cogroup((ups if ups is not None else empty).groupBy("root"))
        down = written(sent.applyInArrow(_down(weight, seed * 1000 + turn, last), "cell int, root int, data binary, g double, log_g double"))
        g, log_g = (x or 0.0 for x in down.df().agg(F.sum("g"), F.sum("log_g")).first())
        unknown = float(rng.standard_gamma(weight))
        norm = g + unknown
        if v:
            weight = drawn(rng, WEIGHTS, weight_log(v + 1, log_g + np.log(max(unknown, 1e-300)) - (v + 1) * np.log(norm)))
        shared = spark.sparkContext.broadcast((seed * 1000 + turn, norm, unknown, s, d, rng.standard_gamma(s / d + totals[1]), before, totals))
        swept = state.groupBy("cell").cogroup(down.df().where("cell >= 0").select("cell", "root", "data").groupBy("cell")).applyInArrow(_swept(shared), "cell int, root int, state binary, sums array<double>, up binary")
        new = written(swept)
        before = (s, d) if turn >= burn_in else None
        added = _added(new.df().where("cell < 0").select(F.when(F.col("cell") == -1, -1).otherwise(F.col("root")).alias("root"), "sums"), len(STRENGTHS))
        totals = _by_heavy(added, len(heavy[0]))
        logs = added.get(-1, np.zeros(len(STRENGTHS))) + strength_log(totals[1], totals[0], d)
        s = drawn(rng, STRENGTHS, logs)
        old.drop()
        down.drop()
        old, state = new, new.df().where("state is not null").select("cell", "state")
        ups = new.df().where("up is not null").select("root", "cell", F.col("up").alias("data"))
        tidy(spark)
    roots.drop()
    shared = spark.sparkContext.broadcast((before, totals, n, v, 300_000))
    lists = made["lists"].df().select("cell", F.col("data").alias("lists"))
    asked = state.hint("merge").join(lists, "cell").select("cell", "state", "lists")
    answers = asked.mapInArrow(_answered(shared), "pack long, data binary, long binary")
    heads = made["head"].df().select("pack", F.col("data").alias("head"))
    kind = docs.schema["doc_id"].dataType
    out = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return heads.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_merged(to_arrow_type(kind), n), out)


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
