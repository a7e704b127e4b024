"""The portal's documents: JSON pages, HTML pages and the limits of its windows.

Landed files are read by Spark; parsing runs where the bytes are (Arrow batches), and
whatever fails to parse becomes an error column instead of a lost row.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The dashes that alone, or after TEMP, make an identifier unusable.
DASH = "[\u002d\u2010\u2011\u2012\u2013\u2014\u2015\u2212]"
CONTRACT_PAGE = "recordsTotal bigint, data array<struct<id: bigint, publicado: string, objeto: string, importe: decimal(38,6), nif: string, adjudicatario: string, duracion: string>>"
TENDER_PAGE = "recordsTotal bigint, data array<struct<id: string, publicado: string, modificado: string, objeto: string, importe: decimal(38,6), estado: int, estadoDesc: string>>"


@dataclass(frozen=True)
class Window:
    """SRC3: what one request may ask for."""

    body: str
    start: date
    end: date
    offset: int = 0
    size: int = 100

    def __post_init__(self):
        if not self.body.strip():
            raise ValueError("a body is needed")
        if self.end < self.start:
            raise ValueError("the window ends before it starts")
        months = (self.end.year - self.start.year) * 12 + self.end.month - self.start.month
        if months > 3 or (months == 3 and self.end.day > self.start.day):
            raise ValueError("a window spans three months at most")
        if not 1 <= self.size <= 100 or self.offset < 0:
            raise ValueError("page size or offset out of range")


def within_limits(body: Column, start: Column, end: Column, offset: Column, size: Column) -> Column:
    """SRC3 over a table of requests: what ``Window`` accepts."""
    return (F.trim(body) != "") & (end >= start) & (end <= F.add_months(start, 3)) & (offset >= 0) & size.between(1, 100)


def pages(raw: DataFrame, schema: str, column: str = "value", required: tuple[str, ...] = ("id",)) -> DataFrame:
    """SRC2, SRC4-SRC6, JS1: JSON pages to rows; a page with a missing envelope field, a null
    row or a null required field fails whole, with an error."""
    page = raw.select("*", F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("p"))
    missing = F.exists("p.data", lambda r: r.isNull() | F.array_contains(F.array(*[r[c].isNull() for c in required]), True))
    error = F.when(F.col("p").isNull() | F.col("p.recordsTotal").isNull() | (F.col("p.recordsTotal") < 0), "recordsTotal is missing").when(F.col("p.data").isNull(), "data is missing").when(missing, "a row is incomplete")
    return page.withColumn("error", error)


def entries(checked: DataFrame) -> DataFrame:
    """AR2: rows of good pages with their position."""
    keep = [c for c in checked.columns if c not in ("p", "error")]
    return checked.where("error is null").select(*keep, F.posexplode("p.data").alias("pos", "row")).select(*keep, "pos", "row.*")


class Node:
    """An element: its tag, attributes and parts (strings and elements, in order)."""

    __slots__ = ("attrs", "parts", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str | None], up: Node | None):
        self.tag, self.attrs, self.up, self.parts = tag, attrs, up, []

    @property
    def inner(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def all(self, *tags: str) -> Iterator[Node]:
        """Elements below this one with one of the tags, in document order."""
        waiting = self.inner[::-1]
        while waiting:
            node = waiting.pop()
            if node.tag in tags:
                yield node
            waiting += node.inner[::-1]

    def first(self, tag: str, **having: str) -> Node | None:
        """The first element below with that tag and, word for word, those attributes."""
        return next((n for n in self.all(tag) if all(v in (n.attrs.get(k) or "").split() for k, v in having.items())), None)

    def said(self, leave_out: tuple[str, ...] = (), deep: bool = True) -> str:
        """The text as it stands."""
        out, waiting = [], self.parts[::-1]
        while waiting:
            p = waiting.pop()
            if isinstance(p, str):
                out.append(p)
            elif deep and p.tag not in leave_out:
                waiting += p.parts[::-1]
        return "".join(out)


#: An opening tag ends these elements, up to the nearest of those around.
_ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "p": (("p",), ("div", "td", "li", "dd")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "div": (("p",), ("div", "td", "li", "dd")), "ul": (("p",), ("div", "td", "li", "dd")),
}
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends, around = _ENDS.get(tag, ((), ()))
        node, last = self.at, None
        while node is not None and node.tag not in around:
            last = node if node.tag in ends else last
            node = node.up
        self.at = last.up if last is not None else self.at
        made = Node(tag, dict(attrs), self.at)
        self.at.parts.append(made)
        if tag not in _VOID:
            self.at = made

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str) -> Node:
    """The elements of a page, however carelessly it closes them."""
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def one_line(x: str) -> str:
    return " ".join(x.split())


def published(x: str | None) -> str | None:
    """Stripped at both ends, no further; null where nothing is left."""
    return (x or "").strip() or None


def lot_key(cell: str | None) -> str | None:
    """SF12 in Python: null for the whole procedure, without leading zeros."""
    x = (cell or "").strip()
    return None if x in ("", "_", "-") else x.lstrip("0") or "0"


def identifier(cell: str | None, shaped: bool = False) -> str | None:
    """SF6-SF8 in Python: the canonical identifier, or null where it identifies nobody; ``shaped``: only one
    of 8 to 14 letters and digits, six of them digits."""
    x = (cell or "").strip().upper()
    if shaped and not (re.fullmatch("[A-Z0-9]{8,14}", x) and sum(c.isdigit() for c in x) >= 6):
        return None
    return None if re.fullmatch(rf"|{DASH}|TEMP{DASH}.*", x, re.DOTALL) else x


class Table:
    """HX3, MP1: rows of the table in a container, as cells by header; a missing table has no rows."""

    def __init__(self, page: Node, name: str, where: str, required: tuple[str, ...]):
        box = page.first("div", id=where)
        table = box.first("table") if box else None
        self.rows: list[dict[str, Node]] = []
        if table is None:
            return
        sections = [table, *table.inner]
        heads = [c for part in sections if part.tag == "thead" for r in part.inner if r.tag == "tr" for c in r.inner if c.tag == "th"]
        names = list(dict.fromkeys(one_line(c.said()) for c in heads))
        for c in required:
            if c not in names:
                raise ValueError(f"{name}: column {c} is missing")
        for part in sections:
            for r in part.inner if part.tag in ("table", "tbody") else ():
                if r.tag == "tr":
                    cells = [c for c in r.inner if c.tag == "td"]
                    if len(cells) != len(names) or len(names) != len(heads):
                        raise ValueError(f"{name}: a row has other cells than the header")
                    self.rows.append(dict(zip(names, cells, strict=True)))

    def texts(self) -> list[dict[str, str | None]]:
        return [{k: published(c.said()) for k, c in r.items()} for r in self.rows]


def bodies(html: str, least: int = 50) -> list[tuple[str, str]]:
    """SRC1: (key, name) of the page's bodies; an error if there are implausibly few."""
    box = tree(html).first("select", id="organoA")
    found = [((o.attrs.get("value") or "").strip(), o.said().strip()) for o in (box.all("option") if box else ())]
    found = [(k, v) for k, v in found if k]
    if len(found) < least:
        raise ValueError(f"{len(found)} bodies: not the page that was expected")
    return found


#: Fixed values of the format: a record's blocks, labels, containers and column heads.
MAIN_BLOCK, REFERENCE_BLOCK = "infoConcurso", "infoReferencia"
OBJECT, REFERENCE, STATE = "Obxecto", "Referencia", "Estado do procedemento"
TABLES = {
    "awards": ("consulta-resolucion", ("Lote", "Part.", "Resolución", "Adxudicatario", "Importe", "Data difusión", "Prazo de execución")),
    "formalisations": ("consulta-formalizacion", ("Data formalización", "Lote", "Contratista", "Nacionalidade", "Importe")),
    "cpv": ("collapseCPV", ("código CPV", "Lote", "Data difusión")),
    "nuts": ("collapseNUT", ("NUT", "Lote", "Data difusión")),
    "bidders": ("ventanaModalLicitadores", ("Lote", "NIF", "Nome")),
    "lots": ("ventanaModalLotes", ("Lote",)),
}
PARTY = "lot: string, consortium: boolean, name: string, fiscal_id: string, members: array<struct<name: string, fiscal_id: string>>"
LOT = "lot: string, printed: string, description: string, value: string"
RECORD = f"reference string, labels map<string,string>, state string, tables map<string,array<map<string,string>>>, parties array<struct<{PARTY}>>, lots array<struct<{LOT}>>, error string"


def labelled(block: Node) -> dict[str, str | None]:
    """HX1: values by label; the first wins, and a label may stand without a value."""
    found: dict[str, str | None] = {}
    for t in block.all("dt"):
        after = t.up.inner[t.up.inner.index(t) + 1 :]
        value = published(after[0].said()) if after and after[0].tag == "dd" else None
        name = one_line(t.said())
        if found.get(name) is None:
            found[name] = value
    return found


def state_of(page: Node) -> str:
    """HX2: the emphasised text of the paragraph that begins with the label."""
    for p in page.all("p"):
        mark = p.first("em")
        if mark is not None and p.said(deep=False).strip().startswith(STATE) and published(mark.said()):
            return published(mark.said())
    raise ValueError(f"no {STATE}")


def party(row: dict[str, Node]) -> dict:
    """HX4, HX6: a bidder.  A consortium is one whose cell has a list within (or, as pages close their items
    early, right below) its list, whatever its name; its identifier must look like one."""
    cell = row["Nome"]
    outer = cell.first("ul")
    own = [n for n in outer.inner if n.tag == "li"] if outer else []
    nested = next((n for n in outer.inner if n.tag == "ul"), None) or next((n for i in own for n in i.inner if n.tag == "ul"), None) if outer else None
    name = published(own[0].said(leave_out=("ul",)) if own else cell.said())
    members = None
    if nested is not None:
        members = []
        for entry in (published(n.said()) for n in nested.inner if n.tag == "li"):
            parts = re.fullmatch(r"(\S+)\s+-\s+(.+)", entry or "", re.DOTALL)
            known = identifier(parts[1], shaped=True) if parts else None
            members.append({"name": parts[2] if known else entry, "fiscal_id": known})
    return {"lot": lot_key(row["Lote"].said()), "consortium": nested is not None, "name": name, "fiscal_id": identifier(row["NIF"].said(), shaped=nested is not None), "members": members}


def lots(tables: dict[str, list[dict[str, str | None]]]) -> list[dict]:
    """HX5: each lot once, as it was first printed, with what the lots table says of it."""
    told: dict[str, dict] = {}
    for r in tables["lots"]:
        if (k := lot_key(r["Lote"])) is not None:
            told.setdefault(k, {"lot": k, "printed": r["Lote"], "description": r.get("Descrición"), "value": r.get("Valor estimado")})
    found: dict[str, dict] = {}
    for name in ("awards", "formalisations", "cpv", "nuts", "bidders"):
        for r in tables[name]:
            if (k := lot_key(r["Lote"])) is not None:
                found.setdefault(k, (told.get(k) or {"lot": k, "description": None, "value": None}) | {"printed": r["Lote"]})
    return [*found.values(), *(v for k, v in told.items() if k not in found)]


def _check_participants(awards: list[dict], parties: list[dict]) -> None:
    """AG6: a lot with bidders must have as many as the award states; a lot without is not checked."""
    count = Counter(p["lot"] for p in parties)
    for a in awards:
        stated, k = a["Part."], lot_key(a["Lote"])
        if k in count and stated and stated.isdecimal() and int(stated) != count[k]:
            raise ValueError(f"{stated} participants stated and {count[k]} bidders published")


def record(html: str | None) -> dict:
    """SRC7, HX1-HX6: one record, or why it can't be read: nothing of a page is kept if a part of it fails."""
    empty = dict.fromkeys(("reference", "labels", "state", "tables", "parties", "lots"))
    try:
        page = tree(html or "")
        block = page.first("div", **{"class": MAIN_BLOCK})
        if block is None:
            raise ValueError("no main block")
        labels, state = labelled(block), state_of(page)
        if OBJECT not in labels:
            raise ValueError(f"no {OBJECT}")
        other = page.first("div", **{"class": REFERENCE_BLOCK})
        read = {k: Table(page, k, where, need) for k, (where, need) in TABLES.items()}
        tables = {k: t.texts() for k, t in read.items()}
        parties = [party(r) for r in read["bidders"].rows]
        _check_participants(tables["awards"], parties)
        return {"reference": labelled(other).get(REFERENCE) if other else None, "labels": labels, "state": state, "tables": tables, "parties": parties, "lots": lots(tables), "error": None}
    except ValueError as e:
        return empty | {"error": str(e)}


def records(pages_: DataFrame, key: str, html: str) -> DataFrame:
    """Records parsed where their pages are; one row a page, errors included."""
    kind = pages_.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([record(x) for x in b["_html"]], columns=["reference", "labels", "state", "tables", "parties", "lots", "error"])
            made.insert(0, "key", b["_key"].to_numpy())
            yield made

    return pages_.select(F.col(key).alias("_key"), F.col(html).alias("_html")).mapInPandas(run, f"key {kind}, {RECORD}")


def table(found: DataFrame, name: str) -> DataFrame:
    """HX4: (key, pos, row) of one of the records' tables; row: cells by header."""
    return found.where("error is null").select("key", F.posexplode(F.col("tables")[name]).alias("pos", "row"))


def parties(found: DataFrame) -> DataFrame:
    """HX4, HX6: (key, pos, lot, consortium, name, fiscal_id, members) of the records' bidders."""
    return found.where("error is null").select("key", F.posexplode("parties").alias("pos", "p")).select("key", "pos", "p.*")


def read_html(spark: SparkSession, path: str, charset: str = "ISO-8859-1") -> DataFrame:
    """SRC1, SRC7: landed HTML files with their text."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", charset).alias("html"))


def read_pages(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ("id",)) -> DataFrame:
    """SRC2, SRC5: landed JSON pages, one file a page."""
    return pages(spark.read.text(path, wholetext=True), schema, required=required)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """SRC5, SRC6: the tender listing's landed pages as rows, by identifier; id and state are required."""
    return entries(read_pages(spark, path, TENDER_PAGE, ("id", "estado")).drop("value")).orderBy("id")


def body_rows(found: DataFrame, html: str = "html", least: int = 50) -> DataFrame:
    """SRC1: (key, name) of the bodies on landed pages, and an error row for a page that isn't theirs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b[html]:
                try:
                    yield pd.DataFrame([(k, v, None) for k, v in bodies(x or "", least)], columns=["body", "name", "error"])
                except ValueError as e:
                    yield pd.DataFrame([(None, None, str(e))], columns=["body", "name", "error"])

    return found.select(html).mapInPandas(run, "body string, name string, error string")


def check_types(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """JS2: JSON bodies whose values have exactly the schema's types: ``parsed``, or null and an ``error``; nothing is coerced."""
    kinds = {"string": "string", "boolean": "boolean", "bigint": "long", "int": "long"}
    want = [(n.strip(), t.strip()) for n, t in (x.strip().split(" ", 1) for x in schema.split(","))]
    as_text = F.from_json(column, "map<string,string>")
    raw = F.schema_of_variant(F.try_parse_json(column))
    wrong = F.lit(False)
    for name, kind in want:
        typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(column), f"$.{name}", "variant"))
        good = {"string": typed == "STRING", "boolean": typed == "BOOLEAN", "long": typed.isin("BIGINT", "INT", "SMALLINT", "TINYINT")}[kinds[kind]]
        wrong |= ~F.coalesce(good | (typed == "VOID"), F.lit(True))
    bad = raw.isNull() | ~raw.startswith("OBJECT") | wrong
    error = F.when(F.coalesce(bad, F.lit(True)), F.lit("not the types that were expected"))
    return rows.withColumn("error", error).withColumn("parsed", F.when(F.col("error").isNull() & as_text.isNotNull(), F.from_json(column, schema)))


RETRIED = (408, 425, 429, 500, 502, 503, 504)


@dataclass
class Fetcher:
    """SRC9: one call a second, three attempts with growing jittered pauses, and a breaker that
    opens when half of the last twenty calls failed."""

    fetch: Callable[[str], bytes] | None = None
    pause: float = 1.0
    attempts: int = 3
    window: int = 20
    least: int = 5
    open_for: float = 300.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    results: list[bool] = field(default_factory=list)
    last: float = -1e18
    opened: float = -1e18

    def _get(self, url: str) -> bytes:
        if self.fetch:
            return self.fetch(url)
        with urllib.request.urlopen(url, timeout=30) as r:
            return r.read()

    def __call__(self, url: str) -> bytes:
        for attempt in range(self.attempts):
            if self.clock() - self.opened < self.open_for:
                raise RuntimeError("the source failed too often; not asked for a while")
            wait = self.last + self.pause - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                body = self._get(url)
                self._note(True)
                return body
            except urllib.error.HTTPError as e:
                self._note(False)
                if e.code not in RETRIED or attempt == self.attempts - 1:
                    raise
                after = e.headers.get("Retry-After") if e.headers else None
                pause = min(60.0, float(after)) if after and after.isdigit() else self._backoff(attempt)
            except OSError:
                self._note(False)
                if attempt == self.attempts - 1:
                    raise
                pause = self._backoff(attempt)
            self.sleep(pause)
        raise AssertionError

    def _backoff(self, attempt: int) -> float:
        return self.pause * 2**attempt * random.uniform(0.5, 1.5)

    def _note(self, good: bool) -> None:
        self.results = [*self.results, good][-self.window :]
        if len(self.results) >= self.least and self.results.count(False) * 2 >= len(self.results):
            self.opened, self.results = self.clock(), []


def decode_page(body: bytes) -> dict:
    """JS2: strict envelope of a live page: wrong types are refused, not coerced."""
    page = json.loads(body.decode("utf-8"))
    if not isinstance(page, dict) or isinstance(page.get("recordsTotal"), bool) or not isinstance(page.get("recordsTotal"), int) or page["recordsTotal"] < 0:
        raise ValueError("recordsTotal is missing")
    if not isinstance(page.get("data"), list) or any(not isinstance(r, dict) or r.get("id") is None for r in page["data"]):
        raise ValueError("data is incomplete")
    return page
