"""Operator 9: removal of repeated passages through maximal repeats of an enhanced suffix array.

Contract: a byte goes if a string of LEAST bytes that covers it also starts in a document
with a smaller doc_id.  Matches never cross documents.

Dealing: each string of LEAST bytes has a minimizer, the gram of GRAM bytes with the
smallest hash in it, so equal strings have equal minimizers at equal places.  Consecutive
strings with one minimizer are a run, of LEAST - GRAM + 1 strings at most.  Packs of documents send the hashes of their runs to
buckets (packed arrays, not rows); only runs whose hash is in two documents or more are
then cut out of the texts and dealt by that hash, so that all equal strings meet.  This takes ROUNDS rounds, each of
a share of the buckets, so that not all cuttings are on disk at once.

Method, inside a bucket: equal cuttings are one string with the smallest doc_id of its
occurrences; an enhanced suffix array (suffixes sorted, with their common prefixes) of what is left gives
the tree of common-prefix intervals, level by level from long to short; an interval of LEAST or more
whose suffixes are preceded by different bytes (or start a run) is a maximal repeat, put
out with all its occurrences.  Every repeat marks its occurrences in documents after its first.
All of this is done with arrays, on chunks of CHUNK bytes of cuttings, a larger code in parts by hash.

Defined results: null text is empty; texts under LEAST bytes lose nothing; a null doc_id comes after
all others (and null ones don't make each other's bytes go); rows that share a
doc_id are one place: they lose nothing to each other; texts of any length, periodic ones too, are
read whole; an empty table gives no rows; all other columns, whatever their names, stay as they are (``n_bytes``,
``spans`` and ``kept`` are added).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acopio.llm.shared import buckets, opened, pressed, text_slices, tidy, written, written_apart

LEAST, GRAM = 50, 16
NO_ID = np.iinfo(np.int64).max
#: Bytes of cuttings whose suffixes are looked at together.
CHUNK = 1 << 20
#: Rounds of cutting and marking, each of a share of the buckets: cuttings are several times a round's share of the texts.
ROUNDS = 3
_BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(data: bytes, least: int = LEAST, gram: int = GRAM, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the minimizer, first start and number of starts of each run of a text, or of the texts
    that end at ``ends``, one after the other (a run lies within one of them)."""
    n = len(data) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, width, base = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 1, _BASE
    while width < gram:  # gram is a power of two: hashes of twice the width from pairs
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % 2**64, width * 2
    h = _mix(h)
    span = least - gram + 1
    low, width = h, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    # a run is a stretch of starts with the same smallest hash; in a periodic text a stretch has no
    # end, so stretches are cut at every ``span`` starts from the first: counts and lengths stay
    # small, and a long stretch is few different strings
    ends = np.array([len(data)]) if ends is None else ends
    begin = np.append(0, ends[:-1])
    new = np.append(True, low[1:] != low[:-1])
    begin, last = begin[ends - begin >= least], (ends - least + 1)[ends - begin >= least]
    new[begin] = True
    first = np.nonzero(new)[0]
    text = np.searchsorted(begin, first, "right") - 1
    inside = (text >= 0) & (first < np.append(last, 0)[text])  # starts before the last LEAST - 1 bytes of a text
    first, text = first[inside], text[inside]
    end = np.minimum(np.append(first[1:], n), last[text])
    parts = -(-(end - first) // span)
    first = np.repeat(first, parts) + span * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return low[first], first, np.minimum(np.append(first[1:], n), np.repeat(end, parts)) - first


def window_hashes(data: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Hash of the ``least`` bytes from each place, joined from hashes of 1, 2, 4, ... bytes."""
    h, width, base, whole, have = data.astype(np.uint64) + np.uint64(1), 1, _BASE, None, 0
    while True:
        if least & width:
            n = max(len(data) - have - width + 1, 0)
            whole = h if whole is None else whole[:n] * np.uint64(base) + h[have : have + n]
            have += width
        if width * 2 > least:
            return _mix(whole)
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % 2**64, width * 2


def _words(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big-endian number, zero from ``left`` bytes on."""
    cover = np.array([0] + [2**64 - 2 ** (64 - 8 * k) for k in range(1, 9)], np.uint64)
    raw = np.lib.stride_tricks.sliding_window_view(data, 8)[np.minimum(at, len(data) - 8)]
    return raw.view(">u8")[:, 0].astype(np.uint64) & cover[np.clip(left, 0, 8)]


def suffix_array(data: np.ndarray, at: np.ndarray, size: np.ndarray, least: int = LEAST, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes data[at : at + size] sorted, and the length each has in common with the one before.

    ``data`` ends with eight bytes more than any suffix.  ``own``: hashes of their first ``least`` bytes; suffixes
    are then in the order of these, and of their bytes within one: what shares ``least`` bytes is together either way.
    """
    skip, longest = least if own is not None else 0, int(size.max(initial=0))
    keys = [_words(data, at + k, size - k) for k in range(skip, longest, 8)]
    order = np.lexsort([size, *keys[::-1]] + ([own] if own is not None else []))
    at, size = at[order], size[order]
    common, same = np.zeros(len(at), np.int64), np.ones(max(len(at) - 1, 0), bool)
    for k in [*range(0, skip, 8), *range(skip, longest, 8)]:
        key = _words(data, at + k, np.minimum(size, skip if k < skip else longest) - k) if k < skip else keys[(k - skip) // 8][order]
        differ = key[1:] ^ key[:-1]
        equal = sum((differ < np.uint64(1 << b)).astype(np.int64) for b in range(0, 64, 8))
        common[1:] += same * (np.minimum(equal, skip - k) if k < skip else equal)
        same &= differ == 0
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    if own is not None and ((own[order][1:] == own[order][:-1]) & (common[1:] < least)).any():  # one hash, other bytes
        back = np.argsort(order)
        order, common = suffix_array(data, at[back], size[back], least)
    return order, common


def maximal_repeats(common: np.ndarray, before: np.ndarray, least: int = LEAST):
    """(length, firsts, ends) of the maximal repeats in a suffix array, from long to short.

    ``before``: the byte before each suffix (-1: none).  An interval of common prefixes is a repeat that can't be
    longer to the right; it is maximal if its suffixes have different bytes before them, or one has none.
    """
    for length in np.unique(common[common >= least])[::-1].tolist():
        near = np.nonzero(common >= length)[0]
        head = np.nonzero(np.append(True, near[1:] != near[:-1] + 1))[0]
        first, end = near[head] - 1, near[np.append(head[1:], len(near)) - 1] + 1
        low = np.minimum(np.minimum.reduceat(before[near], head), before[first])
        high = np.maximum(np.maximum.reduceat(before[near], head), before[first])
        good = (np.minimum.reduceat(common[near], head) == length) & ((low < high) | (low < 0))
        yield length, first[good], end[good]


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each stretch, one after the other."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def repeats(strings: list[bytes], starts: list[int], least: int = LEAST) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of ``least`` bytes or more: (length, all occurrences as (string, start)).

    ``starts``: suffixes of a string from its first on."""
    data = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    size, many = (np.array(x, np.int64) for x in ([len(s) for s in strings], starts))
    k, p = np.repeat(np.arange(len(strings)), many), _spread(np.zeros(len(many), np.int64), many)
    at = (np.cumsum(size) - size)[k] + p
    order, common = suffix_array(data, at, size[k] - p, least)
    k, p = k[order], p[order]
    before = np.where(p > 0, data[at[order] - 1].astype(np.int64), -1)
    return [(n, list(zip(k[a:z].tolist(), p[a:z].tolist(), strict=True))) for n, firsts, ends in maximal_repeats(common, before, least) for a, z in zip(firsts.tolist(), ends.tolist(), strict=True)]


def _alike(data: np.ndarray, begin: np.ndarray, size: np.ndarray, smallest: np.ndarray):
    """(string, start in it, hash) of the suffixes of strings whose first LEAST bytes also start in a string
    with another smallest id, those with equal bytes together.  Many strings of one code come in
    parts by hash, so that what is held at once stays bounded."""
    many = size - LEAST + 1
    own, cut = [], np.nonzero(np.diff(np.cumsum(size) // CHUNK, prepend=-1))[0].tolist()
    for a, z in zip(cut, [*cut[1:], len(size)], strict=True):
        text = data[_spread(begin[a:z], size[a:z])]
        own.append(window_hashes(text)[_spread(np.cumsum(size[a:z]) - size[a:z], many[a:z])])
    own, edge = np.concatenate(own), np.cumsum(many)
    parts = -(-len(own) // CHUNK)
    for part in range(parts):
        row = np.nonzero(own % np.uint64(parts) == part)[0] if parts > 1 else np.arange(len(own))
        row = row[np.argsort(own[row])]
        if not len(row):
            continue
        name = own[row]
        string = np.searchsorted(edge, row, "right")
        first = np.nonzero(np.append(True, name[1:] != name[:-1]))[0]
        low, high = (f.reduceat(smallest[string], first) for f in (np.minimum, np.maximum))
        stay = np.repeat(low != high, np.diff(np.append(first, len(row))))
        yield string[stay], (row - (edge - many)[string])[stay], name[stay]


def _joined(texts: list[str], most: int = 1 << 17):
    """Lists of texts in bytes, each of ``most`` bytes and one text at most."""
    some, total = [], 0
    for t in texts:
        some.append(t.encode("utf-8", "replace"))
        total += len(some[-1])
        if total >= most:
            yield some
            some, total = [], 0
    if some:
        yield some


def _packed(docs: DataFrame, deal: int) -> DataFrame:
    """(bucket, data): the runs of a slice of documents whose hash falls into the bucket."""

    def run(batches):
        for part, texts in text_slices(batches, "t", 12 << 20):
            ids, keys = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            hashes, places, counts, ends, at = [], [], [], [], 0
            for some in _joined(texts):
                end = np.cumsum([len(x) for x in some])
                h, first, many = runs(b"".join(some), ends=end)
                hashes.append(h), places.append(first + at), counts.append(many), ends.append(end + at)
                at += int(end[-1])
            h, place, many = np.concatenate(hashes), np.concatenate(places), np.concatenate(counts)
            bucket = (h % np.uint64(deal)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, place, many = h[order], place[order], many[order].astype(np.uint16)
            cut = np.searchsorted(bucket[order], np.arange(deal + 1))
            ends = np.concatenate(ends)
            code = h // np.uint64(deal)
            rows = []
            for b in range(deal):
                x = slice(cut[b], cut[b + 1])
                if cut[b] < cut[b + 1]:
                    step = np.diff(place[x], prepend=0)
                    of = np.unique(np.searchsorted(ends, place[x], "right"))
                    narrow = np.uint16 if step.max() < 65536 else np.uint32
                    rows.append((b, pressed((code[x].astype(np.uint32), (code[x] >> np.uint64(32)).astype(np.uint16), step.astype(narrow), many[x].astype(np.uint8 if many[x].max() < 256 else np.uint16), np.diff(ends[of], prepend=0), ends[of] - ends[of - 1] * (of > 0), np.diff(ids[of], prepend=0), keys[of]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "data"])

    return docs.mapInArrow(run, "bucket int, data binary")


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=list(names))


def _split(group: np.ndarray, many: int):
    """(value, rows) for the values below ``many`` that occur."""
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(many + 1))
    return [(g, order[cut[g] : cut[g + 1]]) for g in range(many) if cut[g] < cut[g + 1]]


def _shared_runs(deal: int):
    """Of a bucket: for each group of documents the runs whose hash two documents have."""

    def run(table: pa.Table) -> pa.Table:
        hashes, starts, counts, ids, keys = [], [], [], [], []
        for x in table.column("data"):
            low, high, step, many, end, size, doc, key = opened(x)
            place, end = np.cumsum(step, dtype=np.int64), np.cumsum(end)
            of = np.searchsorted(end, place, "right")
            hashes.append(low | high.astype(np.uint64) << np.uint64(32)), starts.append((place - (end - size)[of]).astype(np.uint32)), counts.append(many.astype(np.uint16))
            ids.append(np.cumsum(doc)[of]), keys.append(key[of])
        h, start, many, doc, key = map(np.concatenate, (hashes, starts, counts, ids, keys))
        del hashes, starts, counts, ids, keys
        order = np.argsort(h, kind="stable")
        head = np.append(True, h[order][1:] != h[order][:-1])
        first = np.nonzero(head)[0]
        low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
        stay = order[(low != high)[np.cumsum(head) - 1]]
        stay = stay[np.argsort(key[stay], kind="stable")]
        h, start, many, key = h[stay], start[stay], many[stay], key[stay]
        code, bucket = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), int(table.column("bucket")[0].as_py())
        rows = [(int(g), pressed((*np.unique(key[x], return_counts=True), start[x], many[x], code[x], bucket))) for g, x in _split(key % deal, deal)]
        return _table(rows, ("grp", "data")).append_column("part", pa.array([str(bucket % ROUNDS)] * len(rows), pa.string()))

    return run


def _cuttings(deal: int):
    """Of a group of documents: the text of their shared runs, equal ones once, by bucket."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if not found.num_rows or not docs.num_rows:
            return _table(rows, ("bucket", "data"))
        all_keys, at = np.unique(docs.column("key").to_numpy(), return_index=True)
        doc_ids, column, grp = docs.column("id").to_numpy(), docs.column("t"), int(docs.column("grp")[0].as_py())
        texts: dict[int, bytes] = {}
        for x in found.column("data"):
            keys, each, start, many, code, bucket = opened(x)
            place = np.searchsorted(all_keys, keys)
            cut: list[bytes] = []
            edge = np.append(0, np.cumsum(each))
            sizes = many.astype(np.int64) + LEAST - 1
            for d, a, z in zip(place.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if d not in texts:
                    texts[d] = column[int(at[d])].as_py().encode("utf-8", "replace")
                data = texts[d]
                cut += [data[p : p + n] for p, n in zip(start[a:z].tolist(), sizes[a:z].tolist(), strict=True)]
            names = np.fromiter(map(xxhash.xxh3_64_intdigest, cut), np.uint64, len(cut))
            _, first, of = np.unique(names, return_index=True, return_inverse=True)
            blob = b"".join([cut[k] for k in first.tolist()])
            rows.append((bucket, pressed((code[first], names[first], sizes[first].astype(np.uint16), blob, of.astype(np.uint32), doc_ids[at[place]], place.astype(np.uint32), each.astype(np.uint32), start, grp))))
        return _table(rows, ("bucket", "data"))

    return run


def _marks(deal: int):
    """Of a bucket: for each group of documents the spans that repeat an earlier document.

    Strings are known by a 32-bit code of their minimizer and 64 bits of hash of their own; the bytes
    of those that share a code with another are compared.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = [opened(x) for x in table.column("data")]
        code, name, size = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        order = np.lexsort((name, code))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (code[order][1:] != code[order][:-1]))
        number = np.empty(len(code), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        of = np.concatenate([number[a + p[4]] for a, p in zip(base, parts, strict=False)])
        ids, docs = (np.concatenate([np.repeat(p[k], p[7]) for p in parts]) for k in (5, 6))
        starts = np.concatenate([p[8] for p in parts])
        groups = np.repeat([p[9] for p in parts], [len(p[4]) for p in parts])
        smallest = np.full(len(first), NO_ID)
        np.minimum.at(smallest, of, ids)
        # (string, start in it, length, smallest id): first each whole string, then maximal repeats
        sizes = size[first].astype(np.int64)
        spans = [(np.arange(len(first)), np.zeros(len(first), np.int64), sizes, smallest)]
        begin = (np.cumsum(size, dtype=np.int64) - size)[first]
        data = np.frombuffer(b"".join([p[3] for p in parts] + [bytes(8)]), np.uint8)
        del parts
        # only strings of a code that has several, with several smallest ids; chunks of whole codes
        head = np.nonzero(np.append(True, code[first][1:] != code[first][:-1]))[0]
        each = np.diff(np.append(head, len(first)))
        mixed = np.repeat(np.minimum.reduceat(smallest, head) != np.maximum.reduceat(smallest, head), each)
        held = np.nonzero(mixed)[0]
        weight = np.cumsum(sizes[held]) - sizes[held]
        same = np.append(False, code[first][held][1:] == code[first][held][:-1])
        weight = np.maximum.accumulate(np.where(same, 0, weight)) // CHUNK
        cut = np.nonzero(np.append(True, weight[1:] != weight[:-1]))[0].tolist() if len(held) else []
        for a, z in zip(cut, [*cut[1:], len(held)], strict=False):
            some = held[a:z]
            for string, place, own in _alike(data, begin[some], sizes[some], smallest[some]):
                string = some[string]
                at = begin[string] + place
                array, common = suffix_array(data, at, sizes[string] - place, LEAST, own)
                string, place = string[array], place[array]
                before = np.where(place > 0, data[at[array] - 1].astype(np.int64), -1)
                # from long to short: a repeat adds to a suffix only what has an earlier document
                low = smallest[string]
                best = low.copy()
                for length, firsts, ends in maximal_repeats(common, before):
                    if not len(firsts):
                        continue
                    many = ends - firsts
                    x = _spread(firsts, many)
                    lead = np.repeat(np.minimum.reduceat(low[x], np.cumsum(many) - many), many)
                    good = lead < best[x]
                    x, lead = x[good], lead[good]
                    best[x] = lead
                    spans.append((string[x], place[x], np.full(len(x), length), lead))
        string, place, length, head = (np.concatenate(x) for x in zip(*spans, strict=True))
        order = np.argsort(string, kind="stable")
        cut = np.searchsorted(string[order], np.arange(len(first) + 1))
        many = (cut[1:] - cut[:-1])[of]
        at = order[np.repeat(cut[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        row = np.repeat(np.arange(len(of)), many)
        good = head[at] < ids[row]
        at, row = at[good], row[good]
        doc, begin, length = docs[row], (starts[row] + place[at]).astype(np.uint32), length[at].astype(np.uint16)
        rows = [(int(g), pressed((doc[x], begin[x], length[x]))) for g, x in _split(groups[row].astype(np.int64), deal)]
        return _table(rows, ("grp", "data"))

    return run


def remove_repeats(docs: DataFrame, text: str = "text", as_text: bool = False) -> DataFrame:
    """All columns of docs (doc_id and text among them) and n_bytes, spans (start, end of what
    goes, in bytes) and kept (the other bytes; as_text: a string without characters that lost a byte)."""
    spark = docs.sparkSession
    deal = buckets(spark)
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    doc_id = F.coalesce(F.col(f"c{names.index('doc_id')}").cast("long"), F.lit(NO_ID)).alias("id")
    source = F.coalesce(F.col(f"c{names.index(text)}"), F.lit("")).alias("t")
    # rows that share a doc_id stay apart by their texts
    group = lambda df: df.withColumn("key", F.xxhash64("id", "t")).withColumn("grp", F.pmod("key", F.lit(deal)).cast("int"))
    bare = group(plain.select(doc_id, source))
    rounds = written_apart(_packed(bare, deal).groupBy("bucket").applyInArrow(_shared_runs(deal), "grp int, data binary, part string"), "part", tuple(map(str, range(ROUNDS))), "lz4")
    tidy(spark)
    marked = None
    for shared in rounds.values():  # a round's shuffle files go before the next begins
        found = written(bare.groupBy("grp").cogroup(shared.df().groupBy("grp")).applyInArrow(_cuttings(deal), "bucket int, data binary").groupBy("bucket").applyInArrow(_marks(deal), "grp int, data binary"), "lz4").df()
        marked = found if marked is None else marked.unionAll(found)
        shared.drop()
        tidy(spark)
    kept = [f"c{k}" for k in range(len(names))]
    full = group(plain.select(*kept, doc_id, source))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + ["n_bytes long", "spans array<struct<start:long,end:long>>", "kept string" if as_text else "kept binary"])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def clean(rows: pa.Table, found: pa.Table) -> pa.Table:
        key, begin, size = [], [], []
        for x in found.column("data"):
            k, b, s = opened(x)
            key.append(k), begin.append(b), size.append(s)
        key = np.concatenate(key) if key else np.zeros(0, np.uint32)
        begin, size = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (begin, size))
        order = np.lexsort((begin, key))
        key, begin, end = key[order], begin[order], (begin + size)[order]
        n_bytes, spans, left = [], [], []
        names = (np.unique(rows.column("key").to_numpy(), return_inverse=True)[1] if rows.num_rows else np.zeros(0)).astype(np.uint32)
        # all at once, and of one type: else the marks are copied for each document
        edges = zip(*(np.searchsorted(key, names, side).tolist() for side in ("left", "right")), strict=True)
        for (a, z), t in zip(edges, rows.column("t"), strict=True):
            data = t.as_py().encode("utf-8", "replace")
            n_bytes.append(len(data))
            if a == z:
                spans.append([]), left.append(data)
                continue
            b, e = begin[a:z], np.maximum.accumulate(end[a:z])
            first = np.concatenate([[True], b[1:] > e[:-1]])
            b, e = b[first], e[np.append(np.nonzero(first)[0][1:] - 1, len(e) - 1)]
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(b, e, strict=True)])
            left.append(b"".join([data[x:y] for x, y in zip([0, *e.tolist()], [*b.tolist(), len(data)], strict=True)]))
        if as_text:
            left = [x.decode("utf-8", "ignore") for x in left]
        return pa.table([*(rows.column(c) for c in kept), pa.array(n_bytes, pa.int64()), pa.array(spans, span), pa.array(left, pa.string() if as_text else pa.binary())], names=[*kept, "n_bytes", "spans", "kept"])

    done = full.groupBy("grp").cogroup(marked.groupBy("grp")).applyInArrow(clean, schema)
    return done.toDF(*names, "n_bytes", "spans", "kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes gone from text (a character of which a byte went goes whole)."""
    done = remove_repeats(docs, as_text=True)
    return done.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
