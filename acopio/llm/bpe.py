"""Operator 10: byte-pair encoding and decoding (and the encoder that packing uses).

Method: a word is a doubly linked list of symbols; every adjacent pair that has a
merge rank sits in a priority queue.  The lowest (rank, position) is taken, entries
whose symbols have changed since are stale and skipped, and a merge pushes the two
new pairs.  Decoding concatenates vocabulary strings, with the joint that the
tokenizer file asks for (no decoder in the file: one space).

White space never joins a token of this tokenizer, so a text is its white-space
separated chunks, and a bounded per-worker table remembers the chunks seen lately.
The table only saves time: it is emptied when full and every chunk is still encoded.

Defined results: null text is the empty text; the empty text has no ids and decodes
to the empty string; repeated rows and any other columns are kept as they are (a column named like a new
one is replaced); texts of any length are encoded whole, of pairs of equal rank the leftmost first; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acopio.llm.shared import add_columns

# Unicode White_Space, as the tokenizer file's \s
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPLIT = regex.compile(f"[{SPACE}]+")
#: str.split() also splits at these, the tokenizer doesn't
_ODD = regex.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks_of(text: str) -> list[str]:
    """The white-space separated parts of a text."""
    if _ODD.search(text):
        return [x for x in _SPLIT.split(text) if x]
    return text.split()


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of one tokenizer file (byte-level BPE with a word-end suffix)."""

    def __init__(self, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.joint = " " if spec.get("decoder") is None else ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
        letters = _byte_letters()
        self.inner = [self.vocab.get(x) for x in letters]
        self.last = [self.vocab.get(x + self.end) for x in letters]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}")).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def encode_word(self, word: bytes) -> list[int]:
        """Merge the bytes of one word: lowest rank first, leftmost among equals."""
        sym = [self.inner[b] for b in word]
        sym[-1] = self.last[word[-1]]
        if None in sym:
            sym = [s for s in sym if s is not None]
        n, ranks = len(sym), self.ranks
        if n < 2:
            return sym
        heap = []
        for i in range(n - 1):
            found = ranks.get((sym[i], sym[i + 1]))
            if found:
                heap.append((found[0], i, found[1], sym[i], sym[i + 1]))
        if not heap:
            return sym
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, new, a, b = pop(heap)
            if sym[i] != a or (j := after[i]) >= n or sym[j] != b:
                continue  # stale: one of the two has been merged away or changed
            sym[i], sym[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((new, sym[k]))
                if found:
                    push(heap, (found[0], i, found[1], new, sym[k]))
            h = before[i]
            if h >= 0:
                found = ranks.get((sym[h], new))
                if found:
                    push(heap, (found[0], h, found[1], sym[h], new))
        return [s for s in sym if s != -1]

    def pieces(self, chunk: str) -> list[bytes | int]:
        """Ids of special strings and the UTF-8 words of what is between them."""
        if self.specials is not None and "<|" in chunk:
            out: list[bytes | int] = []
            for k, part in enumerate(self.specials.split(chunk)):
                if k % 2:
                    out.append(self.added[part])
                elif part:
                    out += self._normal(part)
            return out
        return self._normal(chunk)

    def _normal(self, part: str) -> list[bytes | int]:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        part = part.lower()
        if part.isalpha():
            return [part.encode()]
        return [w.encode("utf-8", "replace") for w in self.words(part)]

    def encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for w in self.pieces(chunk):
            if isinstance(w, int):
                out.append(w)
            else:
                out += self.encode_word(w)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for c in chunks_of(text or "") for i in self.encode_chunk(c)]

    def decode(self, ids) -> str:
        return self.joint.join(self.strings[i] for i in ids)


class Remembered(dict):
    """chunk -> value; a bounded memory of make(chunk)."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk):
        if len(self) >= self.most:
            self.clear()
        self[chunk] = value = self.make(chunk)
        return value


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str | None = "decoded", as_text: bool = False, remember: int = 400_000) -> DataFrame:
    """Add the ids of ``text`` (array<int>, or with as_text decimal ids joined by a space)
    and, unless ``decoded`` is None, the text that the ids decode to.

    One narrow pass: no shuffle, memory is one slice of a batch and ``remember`` chunks.
    """
    new = [(ids, "string" if as_text else "array<int>")] + ([(decoded, "string")] if decoded else [])

    def maker():
        coder = Bpe(path)

        def known(chunk):
            found = coder.encode_chunk(chunk)
            return " ".join(map(str, found)), coder.joint.join([coder.strings[i] for i in found])

        memory = Remembered(known, remember)

        def make(texts):
            a, b = [], []
            for t in texts:
                pairs = [memory[c] for c in chunks_of(t)]
                a.append(" ".join([x for x, _ in pairs if x]))
                if decoded:
                    b.append(coder.joint.join([y for x, y in pairs if x]))
            coded = pa.array(a, pa.string()) if as_text else pa.array([[int(i) for i in x.split()] for x in a], pa.list_(pa.int32()))
            return [coded, pa.array(b, pa.string())] if decoded else [coded]

        return make

    return add_columns(df, text, new, maker)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """Add the text of an ids column (array<int>; null: the empty string)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out] + [f"`{out}` string"])
    keep = [c for c in df.columns if c != out]

    def run(batches):
        coder = Bpe(path)
        for part in batches:
            texts = [coder.decode(x or []) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, out])

    return df.mapInArrow(run, schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, as_text=True)
    n = F.when(F.col("ids") == "", F.lit(0)).otherwise(F.octet_length("ids") - F.octet_length(F.replace("ids", F.lit(" "), F.lit(""))) + 1)
    return coded.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
