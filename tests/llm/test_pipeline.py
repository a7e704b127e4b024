"""The corpus pipeline, stage by stage, against plain versions of each stage's decision."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from acopio.llm import bpe, language, packing, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.toPandas())]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        docs = spark.createDataFrame(found.collect(), found.schema)
        out.append((name, docs.toPandas()))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_order_and_columns(stages):
    names = [n for n, _ in stages[1:]]
    assert names == ["language_id", "quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for _, rows in stages[1:-1]:
        assert list(rows.columns) == list(stages[0][1].columns)
    assert all(set(b.doc_id) <= set(a.doc_id) for (_, a), (_, b) in zip(stages, stages[1:], strict=False))


def test_language_and_quality_decide(spark, stages):
    docs, kept, good = (stages[k][1] for k in range(3))
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in language.label(table.select("doc_id", "text"), language.fit(table)).collect()}
    assert set(kept.doc_id) == {d for d in docs.doc_id if found[d].lang_pred != "und" and found[d].score >= 0.35}
    after = spark.createDataFrame(kept)
    scores = {r.doc_id: r.score for r in quality.score(after, quality.fit(after, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert set(good.doc_id) == {d for d in kept.doc_id if scores[d] >= 0.3}


def test_one_of_each_group_stays(stages):
    before, after = stages[2][1], stages[3][1]
    sets = {d: shingles(t) for d, t in zip(before.doc_id, before.text, strict=True)}
    label = {d: d for d in sets}
    ids = sorted(sets)
    for i, d in enumerate(ids):
        for e in ids[:i]:
            if label[d] != label[e] and sets[d] and sets[e] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                old, new = max(label[d], label[e]), min(label[d], label[e])
                label = {k: new if v == old else v for k, v in label.items()}
    assert set(after.doc_id) == {d for d in ids if label[d] == d}


def test_repeats_go(stages):
    before, after = stages[3][1], stages[4][1]
    seen, want = set(), {}
    for d, t in sorted(zip(before.doc_id, before.text, strict=True)):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                cover[p : p + 50] = True
        seen |= {b[p : p + 50] for p in range(len(b) - 49)}
        want[d] = bytes(np.frombuffer(b, np.uint8)[~cover]).decode("utf-8", "ignore")
    assert {d: t or "" for d, t in zip(after.doc_id, after.text, strict=True)} == want


def test_packed_tokens_are_the_texts(stages):
    before, after = stages[4][1], stages[5][1]
    coder = bpe.Bpe()
    ids = {d: np.array([*coder.encode(t), 1], "<u4") for d, t in zip(before.doc_id, before.text, strict=True)}
    got: dict = {}
    for r in after.itertuples():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length <= packing.SIZE and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.start == r.piece * packing.SIZE
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {d: len(x) for d, x in ids.items()}


def test_nothing_in_nothing_out(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("1 = 0").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass(spark, tmp_path, odd):
    odd.drop("score", "a.b").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.length >= 1 for r in rows)
