from __future__ import annotations

import fractions
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from acopio.llm import ann, chat, graph, top_k
from acopio.llm import vectors as vec


@pytest.fixture(scope="module")
def vectors(spark):
    """Random vectors, many of them equal, and rows that take no part."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16)) / 4
    x[100:350] = x[100]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 16), (1002, [None] * 16), (1003, [0.0] * 16), (1004, []), (None, [1.0] * 16), (1005, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), x


def brute(scores, own, k):
    ids = [i for i in np.lexsort((np.arange(len(scores)), -scores)) if i != own][:k]
    return [(int(i), scores[i]) for i in ids]


def whole_scores(x, q):
    """Exact integer products, with Python's integers."""
    f = lambda r: [int(fractions.Fraction(float(v)) * 256 // 1) for v in r]
    q = f(q)
    return [sum(a * b for a, b in zip(f(r), q, strict=True)) for r in x]


@pytest.mark.parametrize("shard", [16_384, 40])
def test_top_k_is_exact(vectors, monkeypatch, shard):
    """One shard, and many cells of which a query opens those that may hold better."""
    monkeypatch.setattr(vec, "SHARD_ROWS", shard)
    monkeypatch.setattr(vec, "BLOCK_ROWS", 5)
    df, x = vectors
    rows = top_k.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 600, 50):
        # row 1003 is a candidate with score 0
        want = sorted([(-s, i) for i, s in enumerate(whole_scores(x, x[q])) if i != q] + [(0, 1003)])[:5]
        assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == {*range(0, 600, 50)}  # 1000 has no vector
    assert top_k.top_k(df.where("1 = 0"), df).count() == 0 and top_k.top_k(df, df.where("1 = 0")).count() == 0


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "x"), (1, [0.5, 0.0], "y"), (1, [0.5, 0.0], "y"), (2, [0.5, 9.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 2, 32768)]
    near = [(r.query_id, r.vec_id) for r in ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert near == [(0, 1), (0, 1), (0, 2)]


@pytest.mark.parametrize(("scale", "dim"), [(7.0, 1536), (1e9, 8), (1e30, 4), (1e200, 3)])
def test_top_k_of_large_values(spark, scale, dim):
    """The same tree whatever the range: beyond 2**53 scores are those of Python's integers."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, dim)) * scale
    x[20:60] = x[20]
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in top_k.top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 50, 100):
        s = whole_scores(x, x[q])
        want = sorted((i for i in range(150) if i != q), key=lambda i: (-s[i], i))[:5]
        clamped = [max(-(2**63), min(2**63 - 1, s[i])) for i in want]
        if len(set(clamped)) == len({s[i] for i in want}):
            assert [(i, v) for _, i, v in sorted(got[q])] == list(zip(want, clamped, strict=True))
        else:  # scores no long can tell apart
            assert sorted(v for _, _, v in got[q]) == sorted(clamped)


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree(seed):
    """Nesting, separation and covering at every node."""
    rng = np.random.default_rng(seed)
    x = np.floor(256 * (rng.standard_normal((400, 3)) * np.exp(2 * rng.standard_normal((400, 1)))))
    x[50:120] = x[50]
    tree = top_k.CoverTree(x, leaf=4)
    rows = x[tree.order]
    assert sorted(tree.order) == list(range(400)) and len(tree.level) > 50
    for k in range(len(tree.level)):
        own, centre = rows[tree.first[k] : tree.last[k]], x[tree.centres[k]]
        far = np.sqrt(((own - centre) ** 2).sum(1)).max()
        assert far <= tree.radius[k] + 1e-6 and far <= 2.0 ** tree.level[k] * (1 + 1e-9)
        kids = np.arange(tree.child[k], tree.end[k])
        if len(kids):
            assert (tree.centres[kids] == tree.centres[k]).any()
            assert tree.first[kids[0]] == tree.first[k] and tree.last[kids[-1]] == tree.last[k] and (tree.first[kids[1:]] == tree.last[kids[:-1]]).all()
            c = x[tree.centres[kids]]
            d = np.sqrt(((c[:, None] - c) ** 2).sum(2)) + 1e18 * np.eye(len(c))
            assert (d > 2.0 ** tree.level[kids[0]] * (1 - 1e-9)).all()


def test_recall_on_the_larger_table(spark):
    """Every query against every row of sf0.1."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in ann.valid(df, zero=False).collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for cells in (16_384, 600):
        vec.SHARD_ROWS, old = cells, vec.SHARD_ROWS
        try:
            got = {}
            for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
                got.setdefault(r.query_id, set()).add(r.vec_id)
        finally:
            vec.SHARD_ROWS = old
        hits = total = 0
        for q in np.nonzero(ids % 20 == 0)[0]:
            s = x @ x[q]
            s[q] = -np.inf
            want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
            hits, total = hits + len(want & got[ids[q]]), total + 20
        assert hits / total >= 0.95


def test_neighbours(vectors, spark):
    df, x = vectors
    rows = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9 and r.query_id != r.vec_id
    hits = 0
    for q in range(0, 600, 20):
        want = [i for i, _ in brute(np.round(x @ x[q], 12), q, 20)]
        assert len(got[q]) == 20
        hits += len(set(want) & set(got[q]))
    assert hits / (30 * 20) >= 0.9
    assert got[100] == [i for i, _ in brute(np.round(x @ x[100], 12), 100, 20)]
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few, 20).count() == 6 and ann.nearest(few.where("1 = 0"), few.where("1 = 0")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7)]
    label = {v: v for e in edges for v in e}
    for _ in range(400):
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            break
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {v for v in label if all(a == b for a, b in edges if v in (a, b))}
    assert got == {k: v for k, v in label.items() if k not in alone}


def test_formatting_round_trip(spark):
    odd = ["", None, "<|im_end|>", "<\\|x", "<\\\\|im_start|>", "a<", "|b", "\n", "%0A%25", "<|im_start|>assistant\nx<|im_end|>\n"]
    rows = [(c, t, ["user", "assistant", "sys%\ntem", None][t % 4], odd[(c + t) % len(odd)]) for c in range(10) for t in range(9)] + [(None, 1, "user", "x"), (None, None, "assistant", "y"), (3, 3, "user", "tie"), (3, 3, "user", "tie")]
    rows += [(77, t, "assistant", f"t{t}") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_trees(chat.thread(df)).withColumn("turns", chat.read_back(F.col("formatted")))
    lost = F.transform("loss", lambda s: chat.unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    got = made.select("tree", "turns", lost.alias("lost"), "formatted").collect()
    assert len(got) == len(by)
    for r in got:
        assert [tuple(t) for t in r.turns] == by[r.tree]
        assert r.lost == [t for role, t in by[r.tree] if role == "assistant"]
        assert r.formatted.count("<|im_end|>") == len(by[r.tree])


def test_best_branch(spark):
    rows = [("t", "a", None, "user", "q", 0.0), ("t", "b", "a", "assistant", "bad", 1.0), ("t", "c", "a", "assistant", "good", 2.0), ("t", "d", "c", "user", "more", None), ("t", "e", "f", "user", "loop", 9.0), ("t", "f", "e", "user", "loop", 9.0), ("u", "g", "gone", "user", "orphan", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    got = {r.tree: [t.text for t in r.turns] for r in chat.format_trees(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert got == {"t": ["q", "good", "more"], "u": ["orphan"]}
    assert chat.format_trees(df, branches=0).count() == 3 and chat.format_trees(df.where("1 = 0")).count() == 0


def test_threads_of_clashing_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "a", "t", 5), (1, 2, "assistant", "b", "u", 6)], "conv_id long, turn long, role string, text string, tree string, at int")
    assert [t.text for t in chat.format_trees(chat.thread(df)).select(chat.read_back(F.col("formatted")).alias("turns")).first().turns] == ["a", "b"]
    assert chat.format_trees(chat.thread(df.where("1 = 0"))).count() == 0


def test_query_adds_a_conversation(spark):
    rows = {r.conv_id: r for r in chat.op8_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(text) and rows[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
