"""Operators over whole texts, against libraries, brute force and held-out labels."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from acopio.llm import bpe, language, language_model, near_dup, packing, quality, suffixes


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_bpe_is_the_library(odd, some):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    for df in (odd, some):
        for r in bpe.encode(df).collect():
            want = t.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == want and r.decoded == t.decode(want, skip_special_tokens=False)
    back = bpe.decode(bpe.encode(odd, decoded=None).select("doc_id", "ids"))
    assert {r.decoded for r in back.collect()} == {r.decoded for r in bpe.encode(odd).collect()}
    assert "a.b" in bpe.encode(odd, as_text=True).columns and bpe.encode(odd.where("1 = 0")).count() == 0


def test_packing(odd, nothing, some):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    for df, size in ((odd, 64), (some, 4096), (nothing, 64)):
        rows = packing.best_fit(df, size).collect()
        ids = collections.Counter()
        for r in rows:
            ids[r.doc_id] += r.length
        want = collections.Counter()
        for d, x in texts_of(df):
            want[d] += len(t.encode(x, add_special_tokens=False).ids) + 1
        assert ids == want
        used = collections.defaultdict(list)
        for r in rows:
            used[r.sequence_id].append((r.offset, r.length))
        for spans in used.values():
            at = 0
            for a, n in sorted(spans):
                assert a == at
                at += n
            assert at <= size
        if rows:
            assert len(used) <= math.ceil(sum(want.values()) / size * 1.1) + 1


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit(seed):
    """The plan over counts opens as many sequences as best fit over single pieces."""
    rng, size = random.Random(seed), 50
    lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 300))]
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in free if r >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(size - n)
    steps = packing.plan(collections.Counter(lengths), size)
    last = {}
    for length, rank, first, each, _ in steps.tolist():
        nxt = min([s[1] for s in steps.tolist() if s[0] == length and s[1] > rank], default=collections.Counter(lengths)[length])
        last[length, rank] = first + (nxt - rank - 1) // each
    assert max(last.values()) + 1 == len(free)


def test_quality(spark, odd, nothing):
    some, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(some, labels)
    rows = {r.doc_id: r.score for r in quality.score(some, model).collect()}
    held = [(rows[r.doc_id] >= 0.3, r.quality == 1) for r in labels.collect() if r.doc_id in rows and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) >= 0.9
    scored = quality.score(odd, model)
    assert scored.count() == odd.count() and "a.b" in scored.columns and all(0 <= r.score <= 1 for r in scored.collect())
    assert quality.score(nothing, model).count() == 0
    plain = quality.fit(some, labels.where("1 = 0"))
    assert {r.score for r in quality.score(some, plain).collect()} == {0.5}
    assert quality.keep(odd, model, 0.0).columns == odd.columns


def test_scores_are_sums_of_looked_up_steps():
    """Against a plain walk over the tables, a row and a feature at a time; and features against plain counts."""
    rng = np.random.default_rng(5)
    x = np.round(rng.random((400, 4)), 2)
    y = (x[:, 0] + (x[:, 1] > 0.5) * x[:, 2] > 0.8).astype(float)
    model = quality.Gam(pairs=3, turns=20, pair_turns=10).fit(x, y)
    for row, got in zip(x, model.score(x), strict=True):
        f = model.base
        for k, v in enumerate(row):
            f += model.tables[k][sum(v >= e for e in model.edges[k])]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            f += table[sum(row[i] >= e for e in model.coarse[i])][sum(row[j] >= e for e in model.coarse[j])]
        assert math.isclose(got, 1 / (1 + math.exp(-f)), rel_tol=1e-9)
    text = "One two TWO two.\nOne two TWO two.\n\n3é!"
    got = dict(zip(quality.FEATURES, quality.features(text), strict=True))
    b, words = text.encode(), text.split()
    assert math.isclose(got["log_bytes"], math.log1p(len(b))) and math.isclose(got["digits"], 1 / len(b)) and math.isclose(got["lines"], 3 / len(words))
    assert math.isclose(got["line_copies"], 1 / 3) and math.isclose(got["non_ascii"], 2 / len(b)) and math.isclose(got["upper_words"], 2 / len(words))
    assert [k for k, v in zip(quality.FEATURES, quality.features(""), strict=True) if v] == ["non_ascii", "line_copies"]


def test_quality_of_repeated_labels_and_long_texts(spark):
    """A doc_id that is labelled twice counts once, with its largest label; a text of any length is read whole."""
    docs = spark.createDataFrame([(k, "good words here. " * (k + 1) if k % 2 else "x ! # " * (k + 1)) for k in range(60)] + [(60, "good words here. " * 60_000), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 2 + [(3, 0), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(rows) == 62 and rows[59] > 0.5 > rows[58] and rows[60] > 0.5


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = quality.Gam(pairs=2).fit(x[:2000], y[:2000]).score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.9


def test_language(spark, odd, nothing, some):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, sample=200)
    got = language.label(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0), model)
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    rows = language.label(odd, model, words=True).collect()
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in rows)
    assert all(len(r.word_langs) == len((r.text or "").split()) for r in rows)
    assert language.label(nothing, model).count() == 0 and "a.b" in language.label(odd, model).columns
    assert language.fit(nothing).labels == []
    unlearned = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.label(odd, unlearned).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10**6 + k, "zzyx qwov yxq wozz vyq", "zz") for k in range(3)], "doc_id long, text string, lang string")
    model = language.fit(docs.unionByName(rare), sample=40, folds=10**9)
    assert "zz" in model.labels
    assert {r.lang_pred for r in language.label(rare, model).collect()} == {"zz"}
    few = language._chosen(docs.unionByName(rare), 40)
    assert few.count() == few.distinct().count() == 40 and few.where("doc_id >= 1000000").count() == 3
    assert language._chosen(docs, 10**6).count() == docs.select("doc_id").distinct().count()


def test_language_switches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, sample=200)
    one = {r.lang: " ".join(r.text.split()[:40]) for r in docs.where("lang in ('de', 'en') and n_chars > 500").limit(50).collect()}
    mixed = spark.createDataFrame([(1, one["de"] + " " + one["en"])], "doc_id long, text string")
    tags = language.label(mixed, model, words=True).first().word_langs
    assert np.mean([t == "de" for t in tags[:40]]) > 0.85 and np.mean([t == "en" for t in tags[40:]]) > 0.85


@pytest.mark.parametrize("seed", range(5))
def test_forward_backward(seed):
    rng = np.random.default_rng(seed)
    starts = np.unique(np.concatenate([[0], rng.integers(1, 400, 6), [400]]))
    e, a, first = rng.random((400, 3)) + 0.01, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    p = language._forward_backward(e, starts, a, first)
    for s, z in zip(starts, starts[1:], strict=False):
        alphas, b = [first * e[s]], np.ones(3)
        for t in range(s + 1, z):
            alphas.append((alphas[-1] / alphas[-1].sum()) @ a * e[t])
        for t in range(z - 1, s - 1, -1):
            g = alphas[t - s] * b
            assert np.allclose(g / g.sum(), p[t])
            b = a @ (e[t] * b)
            b /= b.sum()


@pytest.mark.parametrize("seed", range(5))
def test_pair_probabilities(seed):
    """Against the sum over every labelling of short sequences."""
    rng = np.random.default_rng(seed)
    starts = np.array([0, 1, 5, 9])
    e, a, first = rng.random((9, 3)) + 0.01, rng.random((3, 3)) ** 3 + 0.01, rng.random(3) + 0.1
    want, own = np.zeros((3, 3)), np.zeros((9, 3))
    for s, z in zip(starts, starts[1:], strict=False):
        found = []
        for y in itertools.product(range(3), repeat=int(z - s)):
            found.append((first[y[0]] * np.prod([e[s + k, y[k]] for k in range(z - s)]) * np.prod([a[y[k - 1], y[k]] for k in range(1, z - s)]), y))
        total = sum(w for w, _ in found)
        for w, y in found:
            for k in range(z - s):
                own[s + k, y[k]] += w / total
                if k:
                    want[y[k - 1], y[k]] += w / total
    pairs = np.zeros((3, 3))
    assert np.allclose(language._forward_backward(e, starts, a, first, pairs), own) and np.allclose(pairs, want)
    language.BLOCK, old = 2, language.BLOCK  # the same across blocks
    try:
        pairs = np.zeros((3, 3))
        assert np.allclose(language._forward_backward(e, starts, a, first, pairs), own) and np.allclose(pairs, want)
    finally:
        language.BLOCK = old


def test_crf_learns_transitions():
    """Sequences whose words say nothing: only transitions and starts can tell the labels."""
    runs = [("ab"[k % 2], ["x" if k % 2 == 0 else "y"] * 20) for k in range(60)]
    crf = language.Crf(slots=1 << 10).fit(runs, epochs=6)
    assert crf.a[0, 0] > crf.a[0, 1] and crf.a[1, 1] > crf.a[1, 0] and crf.first.shape == (2,)


def test_keep(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, sample=100)
    stays = language.keep(odd, model, 0.0)
    assert stays.columns == odd.columns
    assert sorted(map(str, (r.text for r in stays.collect()))) == sorted(str(t) for t in [*odd.rdd.map(lambda r: r.text).collect()] if any(map(str.isalpha, t or "")))
    assert language.keep(nothing, model).count() == 0


def test_near_duplicates(spark, odd, nothing, some):
    def brute(df, percent):
        sets = {}
        for d, t in texts_of(df):
            w = t.encode().lower().split()
            sets.setdefault(d, []).append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
        flat = [(d, s) for d, x in sets.items() for s in x if s and d is not None]
        label = {d: d for d in sets}
        for i, (d, s) in enumerate(flat):
            for e, u in flat[:i]:
                if label[d] != label[e] and 100 * len(s & u) >= percent * len(s | u):
                    old, new = max(label[d], label[e]), min(label[d], label[e])
                    label = {k: new if v == old else v for k, v in label.items()}
        return label

    copies = some.unionByName(some.limit(40).withColumns({"doc_id": F.col("doc_id") + 100000, "text": F.concat("text", F.lit(" one more")), "lang": F.col("lang")}))
    for df, part in ((copies, 1_000_000), (copies, 2_000), (odd, 1_000_000)):
        want = brute(df, 85)
        got = near_dup.near_duplicates(df, 85, part=part).collect()
        assert len(got) == df.count() and all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)
    assert near_dup.near_duplicates(nothing).count() == 0
    assert near_dup.keep_one(odd).columns == odd.columns
    clash = odd.withColumnRenamed("lang", "acopio_gone")
    assert near_dup.keep_one(clash).columns == clash.columns and near_dup.keep_one(clash).count() == near_dup.keep_one(odd).count()


def test_near_duplicates_of_one_id_on_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (8, ""), (8, "c"), (9, "c"), (10, "d"), (11, "d"), (11, "")], "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in near_dup.near_duplicates(df).collect():
        got[r.doc_id].add((r.component_id, r.kept))
    assert got == {1: {(1, True)}, 5: {(1, False)}, 7: {(1, False)}, 8: {(8, True)}, 9: {(8, False)}, 10: {(10, True)}, 11: {(10, False)}}
    assert sorted(r.doc_id for r in near_dup.keep_one(df).collect()) == [1, 8, 8, 10]


def brute_repeats(df):
    seen, out = set(), {}
    for d, t in sorted(texts_of(df), key=lambda x: (x[0] is None, x[0] or 0)):
        b = t.encode()
        cover = np.zeros(len(b), bool)
        mine = {b[p : p + 50] for p in range(len(b) - 49)}
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                cover[p : p + 50] = True
        seen |= mine
        out[d] = (len(b), int(cover.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest())
    return out


def test_repeats(spark, odd, nothing, some):
    base = [r.text for r in some.limit(12).collect()]
    rng = random.Random(3)
    mixed = [(k, "".join(x[a : a + rng.randint(30, 200)] for x in rng.sample(base, 4) for a in [rng.randint(0, 200)])) for k in range(60)] + [(100 + k, t) for k, t in enumerate(base)]
    made = spark.createDataFrame(mixed, "doc_id long, text string")
    for df in (made, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        want = brute_repeats(df)
        for r in suffixes.remove_repeats(df).collect():
            assert (r.n_bytes, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id]
    assert suffixes.remove_repeats(odd).count() == odd.count() and suffixes.remove_repeats(nothing).count() == 0
    cleaned = suffixes.without_repeats(odd)
    assert cleaned.columns == odd.columns and cleaned.where("text is null").count() == 1


def test_repeats_in_rounds(spark, some, monkeypatch):
    """The cuttings of a round are a share of all, and each bucket is in one round."""
    seen, keep = [], suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, codec: seen.append(keep(df, codec)) or seen[-1])
    rows = suffixes.remove_repeats(some.select("doc_id", "text")).collect()
    assert len(seen) == 3 and all(t.df().count() for t in seen)
    want = brute_repeats(some)
    assert all((r.n_bytes, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id] for r in rows)


def test_periodic_repeats(spark):
    """Stretches of one run that have more starts than 16 bits count, in two documents."""
    line = "the same line of 34 letters again."
    texts = ["a" * 70_000, "xy" + "a" * 80_000 + "z", "ha ha, " * 10_000, "so: " + "ha ha, " * 11_000, f"{line}\n" * 2_000, f"-{line}\n" + f"{line}\n" * 2_100]
    for t in texts:
        h, first, many = suffixes.runs(t.encode())
        assert many.sum() == len(t) - 49 and (np.diff(first) == many[:-1]).all() and many.max() <= 35
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_repeats(df)
    for r in suffixes.remove_repeats(df).collect():
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id]


def bucket_of(strings, code, ids):
    """What a bucket gets of one group: equal strings of a code once, each of a document of its own."""
    names = np.array([xxhash.xxh3_64_intdigest(x) for x in strings], np.uint64)
    each, place = np.ones(len(strings), np.uint32), np.arange(len(strings), dtype=np.uint32)
    sizes = np.array([len(x) for x in strings], np.uint16)
    row = suffixes.pressed((np.array(code, np.uint32), names, sizes, b"".join(strings), place, np.array(ids), place, each, np.zeros(len(strings), np.uint32), 0))
    return suffixes._table([(0, row)], ("bucket", "data"))


def marked(strings, code, ids):
    cover = [np.zeros(len(x), bool) for x in strings]
    for x in suffixes._marks(1)(bucket_of(strings, code, ids)).column("data"):
        for d, a, n in zip(*(v.tolist() for v in suffixes.opened(x)), strict=True):
            cover[d][a : a + n] = True
    return cover


@pytest.mark.parametrize("chunk", [100, 3_000, 1 << 20])
def test_marks_in_chunks(monkeypatch, chunk):
    """Strings of many codes and of one large code, taken whole, in pieces and in parts by hash."""
    monkeypatch.setattr(suffixes, "CHUNK", chunk, raising=False)
    rng = random.Random(chunk)
    strings, code = [], []
    for c, many in enumerate((3, 200, 4, 40, 2)):  # each code has bytes of its own, as equal strings have equal codes
        some = bytes([3 * c, 3 * c + 1, 3 * c + 2])
        text = bytes(rng.choices(some[:2], k=150 if many > 9 else 60)) + bytes(rng.choices(some, k=60))
        new = {text[a : a + n] + bytes(rng.choices(some, k=rng.choice([0, 0, 3]))) for _ in range(many) for a, n in [(rng.randint(0, len(text) - 50), rng.randint(50, 81))]}
        strings += sorted(new)
        code += [c] * len(new)
    ids = rng.sample(range(1000), len(strings))
    first = {}
    for x, c, d in zip(strings, code, ids, strict=True):
        for p in range(len(x) - 49):
            first[c, x[p : p + 50]] = min(d, first.get((c, x[p : p + 50]), d))
    got = marked(strings, code, ids)
    assert any(x.any() for x in got)
    for x, c, d, have in zip(strings, code, ids, got, strict=True):
        want = np.zeros(len(x), bool)
        for p in range(len(x) - 49):
            if first[c, x[p : p + 50]] < d:
                want[p : p + 50] = True
        assert (have == want).all()


def test_marks_of_one_hash(monkeypatch):
    """Suffixes whose hashes are equal by chance are told apart by their bytes."""
    monkeypatch.setattr(suffixes, "window_hashes", lambda data, least=50: np.zeros(max(len(data) - least + 1, 0), np.uint64), raising=False)
    strings = [b"a" * 50 + b"bcd", b"a" * 51 + b"bc", b"x" + b"a" * 50 + b"b", b"q" * 55]
    got = marked(strings, [0] * 4, [5, 6, 7, 8])
    assert [int(x.sum()) for x in got] == [0, 53, 51, 0]


def test_marks_take_no_loop_by_code():
    """20,000 codes of two strings, and the end of a passage that 5,000 documents have: less time than
    to cut the suffixes as Python's strings and to sort them five times."""
    rng = random.Random(5)
    tail = lambda n: bytes(rng.choices(range(97, 123), k=n))
    pairs = [x + tail(2) for x in (tail(50) for _ in range(20_000)) for _ in range(2)]
    one = [b"p" * 20 + b"this is the end of the passage that all of them have" + tail(12) for _ in range(5_000)]
    for strings, code in ((pairs, [k // 2 for k in range(len(pairs))]), (one, [0] * len(one))):
        table = bucket_of(strings, code, range(len(strings)))
        t = time.process_time()
        suffixes._marks(1)(table)
        took = time.process_time() - t
        t = time.process_time()
        for _ in range(5):
            sorted((x[p:], k, p) for k, x in enumerate(strings) for p in range(len(x) - 49))
        assert took < time.process_time() - t


@pytest.mark.parametrize("seed", range(20))
def test_maximal_repeats(seed):
    rng, least = random.Random(seed), 4
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(6, 20))) for _ in range(rng.randint(2, 5))]
    found = collections.defaultdict(set)
    for k, x in enumerate(strings):
        for p in range(len(x)):
            for n in range(least, len(x) - p + 1):
                found[x[p : p + n]].add((k, p))
    want = {}
    for w, o in found.items():
        right = {strings[k][p + len(w)] if p + len(w) < len(strings[k]) else (k,) for k, p in o}
        left = {strings[k][p - 1] if p else None for k, p in o}
        if len(o) > 1 and len(right) > 1 and (len(left) > 1 or None in left):
            want[w] = o
    got = {strings[o[0][0]][o[0][1] : o[0][1] + n]: set(o) for n, o in suffixes.repeats(strings, [len(x) - least + 1 for x in strings], least)}
    assert got == want


def test_language_model(odd, nothing, some):
    for df in (odd, some):
        rows = language_model.score(df).collect()
        train, seen = collections.Counter(), {}
        for d, t in texts_of(df):
            w = [*t.encode().lower().split(), None]
            if zlib.crc32(str(d if d is not None else "").encode()) % 7 != 2:
                train.update(w)
            seen.setdefault(d, []).append(w)
        n, v = sum(train.values()), len(train)
        assert len(rows) == df.count()
        for r in rows:
            w = next(x for x in seen[r.doc_id] if len(x) == r.n_tokens)
            assert (r.n_known, r.train_tokens) == (sum(x in train for x in w), n)
            assert math.isclose(r.base_score, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
            assert r.score <= 0 and math.isfinite(r.score)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.score(nothing).count() == 0
    long = odd.select("doc_id", F.repeat(F.concat(F.coalesce("text", F.lit("")), F.lit(" ab c")), 4_000).alias("text"), F.lit(1).alias("score"), F.lit(2).alias("cell")).where("doc_id in (3, 5)")
    assert {r.n_tokens for r in language_model.score(long).collect()} == {4_000 * 2 + 2, 4_000 * 9 + 2}


def stirling(c, d):
    """Generalised Stirling numbers S(c, 1..c) of discount d."""
    row = np.array([1.0])
    for n in range(1, c):
        row = np.append((n - d * np.arange(1, n + 1)) * row, 0) + np.append(0, row)
    return row


@pytest.mark.parametrize(("c", "lam", "d"), [(2, 0.01, 0.5), (3, 2.0, 0.8), (7, 0.3, 0.2), (12, 5.0, 0.6), (40, 1.5, 0.9), (40, 30.0, 0.4)])
def test_seating(c, lam, d):
    """Seating jumps with the Metropolis ratio, against the exact distribution of tables."""
    rng, many = np.random.default_rng(1), 40_000
    x, n = np.full(many, lam), np.full(many, c)
    opened, when = np.full(many, c - 1), np.tile(np.arange(1, c), many)  # everybody alone, to begin with
    for _ in range(60):
        opened, when = language_model.resat(n, opened, when, x, d, rng)
        assert len(when) == opened.sum()
    want = stirling(c, d) * lam ** np.arange(1, c + 1)
    assert np.abs(np.bincount(opened, minlength=c) / many - want / want.sum()).max() < 0.012
    own = np.split(when, np.cumsum(opened)[:-1])
    assert all((np.diff(o) > 0).all() and (o >= 1).all() and (o < c).all() for o in own[:500])
    again, moments, log = language_model.seated(n, x, d, None, opened, when)
    assert (again == opened).all() and (moments == when).all()

    def ratio(o):
        """Target over proposal, customer by customer."""
        t, out = 1, 0.0
        for k in range(1, c):
            y = lam * (min(2 ** k.bit_length(), c) / c) ** d
            if k in o:
                out, t = out + math.log(lam) - math.log(y / (y + k - d * t)), t + 1
            else:
                out += math.log(y + k - d * t)
        return out

    assert np.allclose(log[:50], [ratio(set(o.tolist())) for o in own[:50]])


def test_seating_of_very_many_customers():
    rng = np.random.default_rng(1)
    c = np.array([10**12, 10**9, 2, 1])
    opened, when, _ = language_model.seated(c, np.array([200.0, 0.5, 1.0, 1.0]), 0.7, rng)
    assert 50 < opened[0] < 2000 and opened[3] == 0 and len(when) == opened.sum()
    x = np.array([1e-9, 0.3, 1, 2.5, 10, 1e6, 1e12])
    assert np.allclose(language_model.lgamma(x), [math.lgamma(v) for v in x])


def test_model_against_one_customer_at_a_time():
    """Averaged predictions of a small corpus: our steps against removing and seating single customers."""
    rng, d, s, weight = np.random.default_rng(3), 0.6, 1.3, 0.5
    data = {(0, 0): 6, (0, 1): 2, (0, 2): 1, (1, 0): 3, (1, 2): 4, (2, 1): 9, (2, 3): 1}
    v, contexts, rounds = 4, 3, 4_000
    pairs = sorted(data)
    u, w = (np.array([p[k] for p in pairs]) for k in (0, 1))
    c, many, when, mine = np.array([data[p] for p in pairs]), np.zeros(len(pairs), np.int64), np.zeros(0, np.int64), np.zeros((contexts, v))
    for _ in range(rounds):
        g = rng.standard_gamma(weight + np.append(np.bincount(w, many + 1, v), 0))
        share = g / g.sum()
        many, when = language_model.sweep(u, c, many, when, w, share, contexts, s, d, rng)
        t = many + 1
        own = np.zeros((contexts, v))
        own[u, w] = c - d * t
        mine += (own + (s + d * np.bincount(u, t, contexts))[:, None] * share[:v]) / (s + np.bincount(u, c, contexts))[:, None]
    tables, theirs = {p: [1] * n for p, n in data.items()}, np.zeros((contexts, v))
    root = lambda: np.array([sum(len(x) for (_, b), x in tables.items() if b == k) for k in range(v)])
    for turn in range(rounds):
        for (a, b), x in tables.items():
            for _ in range(data[a, b]):
                k = rng.choice(len(x), p=np.array(x) / sum(x))
                x[k] -= 1
                if not x[k]:
                    x.pop(k)
                r, total = root(), sum(len(y) for (e, _), y in tables.items() if e == a)
                new = (s + d * total) * (r[b] + weight) / (r.sum() + weight * (v + 1))
                p = np.array([n - d for n in x] + [new])
                k = rng.choice(len(p), p=p / p.sum())
                if k == len(x):
                    x.append(1)
                else:
                    x[k] += 1
        if turn >= 100:
            r = root()
            for a in range(contexts):
                total = sum(len(y) for (e, _), y in tables.items() if e == a)
                n = sum(k for (e, _), k in data.items() if e == a)
                for b in range(v):
                    theirs[a, b] += (max(data.get((a, b), 0) - d * len(tables.get((a, b), [])), 0) + (s + d * total) * (r[b] + weight) / (r.sum() + weight * (v + 1))) / (s + n)
        if turn == 600:
            break
    mine, theirs = mine / rounds, theirs / (turn - 99)
    assert np.abs(mine - theirs).max() < 0.015


def test_probabilities_sum_to_one():
    """Over all known words and one unknown, in every context of a cell, as it is scored."""
    rng, many, words, d, s = np.random.default_rng(0), 5, 30, 0.7, 2.0
    count = rng.integers(0, 4, (many, words)) * rng.integers(0, 60, (many, words))
    count[:, -1] = 0  # the unknown word
    g = rng.standard_gamma(0.5, words).astype(np.float32)
    n = language_model._small
    whole = np.zeros(0, np.int64)
    x = language_model.Cell(language_model.packed(n(np.full(many, words)), n(np.tile(np.arange(words), many)), n(count.ravel()), n(0 * count.ravel()), n(whole), np.zeros(0, np.float32), (g / g.sum()).astype(np.float32), whole, whole, np.array([words])))
    for _ in range(3):
        x.opened, x.when = language_model.sweep(x.u, x.c, x.opened, x.when, x.word, x.share, x.many, s, d, rng)
        assert (x.t[x.c > 0] >= 1).all() and (x.t <= x.c).all()
        p = x.probabilities(None, s, d).reshape(many, words)
        assert np.allclose(p.sum(1), 1, rtol=1e-6)
        x = language_model.Cell(x.packed())


def test_scores_do_not_depend_on_dealing(spark, some, monkeypatch):
    """Frequent pairs and contexts take other ways; sums stay those of the texts."""
    plain = {(r.doc_id, r.n_tokens): r for r in language_model.score(some).collect()}
    monkeypatch.setattr(language_model, "LONG", 3)
    monkeypatch.setattr(language_model, "PACK", 1 << 16)
    for r in language_model.score(some).collect():
        p = plain[r.doc_id, r.n_tokens]
        assert (r.n_known, r.train_tokens, r.held_out) == (p.n_known, p.train_tokens, p.held_out) and math.isclose(r.base_score, p.base_score, rel_tol=1e-9)
        assert abs(r.score - p.score) < 0.05 * abs(p.score) + 1
