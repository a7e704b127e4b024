from __future__ import annotations

import time
import urllib.error
from datetime import date

import pytest

from acopio.sources import portal
from acopio.streaming import imports, metrics


def test_window_limits():
    portal.Window("b", date(2024, 1, 1), date(2024, 4, 1))
    for bad in (("b", date(2024, 1, 1), date(2024, 4, 2)), (" ", date(2024, 1, 1), date(2024, 1, 2)), ("b", date(2024, 1, 2), date(2024, 1, 1))):
        with pytest.raises(ValueError):
            portal.Window(*bad)


def test_bodies_page():
    options = "".join(f"<option value='{n}'> Body {n} </option>" for n in range(60))
    page = f"<select id='organoA'><option value=''>-</option>{options}</select>"
    assert portal.bodies(page)[0] == ("0", "Body 0") and len(portal.bodies(page)) == 60
    with pytest.raises(ValueError):
        portal.bodies("<select id='organoA'></select>")


def page(body="", state="Adxudicado", obxecto="Obra  nova"):
    """A record as the portal prints it: the empty copy of a label first, outside the main block."""
    return f"""<html><div class='acordoMarco'><dl><dt>Obxecto</dt><dd></dd></dl></div>
        <p>Estado do procedemento: <em> {state} </em></p><div class="infoReferencia row"><dl><dt>Outra</dt><dd>x</dd><dt> Referencia </dt><dd> EXP 7/24 </dd></dl></div>
        <div class="col infoConcurso"><dl><dt>Obxecto</dt><dd> {obxecto} </dd><dt>Obxecto</dt><dd>outro</dd><dt>Nº
        lotes</dt><dt>Valor estimado</dt><dd>1.234,50 €</dd></dl></div>{body}</html>"""


def grid(where, heads, *rows):
    head = "".join(f"<th><a href='#'> {h} </a></th>" for h in heads)
    return f"<div id='{where}'><div><table><thead><tr>{head}</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</tbody></table></div></div>"


AWARD = ("Lote", "Part.", "Resolución", "Adxudicatario", "Importe", "Data difusión", "Prazo de execución")
UTE = "<ul class='list-unstyled'><li>{}</li><ul><li>A70319678 - PRACE SA</li><li>NON-SEI - OUTRA</li></ul></ul>"
WELL = "<ul><li><span>{}</span><ul><li>A70319678 - PRACE SA</li></ul></li></ul>"


def award(lot, part, who="ACME"):
    return (lot, part, "Adxudicado", who, "1,0", "01-02-2024", "1 mes")


def test_records(spark):
    bidders = grid("ventanaModalLicitadores", ("Nome", "Lote", "NIF", "NUT"), (UTE.format("MISTURAS-INGESAN"), "1", "-", ""), ("<ul><li>ACME</li></ul>", "01", "b12345678", "ES"), (WELL.format("UTE Y"), "-", "U1234567", ""))
    good = page(grid("consulta-resolucion", AWARD, award("01", "2"), award("_", "-")) + bidders + grid("ventanaModalLotes", ("Descrición", "Lote"), ("un", "1"), ("tres", "3")))
    cases = [good, page(grid("collapseCPV", ("código CPV", "Lote"), ("x", "1"))), page(grid("collapseNUT", ("NUT", "Lote", "Data difusión"), ("x", "1"))), "<p>nada</p>", None, page(state=""), page(grid("consulta-resolucion", AWARD, award("1", "5")) + bidders), page(obxecto="").replace("<dt>Obxecto</dt><dd> ", "<dt>Obxecto</dt><i></i><dd>", 1)]
    rows = portal.records(spark.createDataFrame(list(enumerate(cases)), "id int, html string"), "id", "html").orderBy("key").collect()
    r = rows[0]
    assert r.error is None and r.reference == "EXP 7/24" and r.state == "Adxudicado"
    assert r.labels == {"Obxecto": "Obra  nova", "Nº lotes": None, "Valor estimado": "1.234,50 €"}
    assert [a["Lote"] for a in r.tables["awards"]] == ["01", "_"] and r.tables["cpv"] == []
    assert [(p.lot, p.consortium, p.name, p.fiscal_id) for p in r.parties] == [("1", True, "MISTURAS-INGESAN", None), ("1", False, "ACME", "B12345678"), (None, True, "UTE Y", "U1234567")]
    assert [(m.name, m.fiscal_id) for m in r.parties[0].members] == [("PRACE SA", "A70319678"), ("NON-SEI - OUTRA", None)] and r.parties[1].members is None
    assert [(x.lot, x.printed, x.description) for x in r.lots] == [("1", "01", "un"), ("3", "3", "tres")]
    assert [bool(x.error) for x in rows] == [False, True, True, True, True, True, True, False]
    assert "Data difusión" in rows[1].error and "cells" in rows[2].error and rows[3].error == rows[4].error == "no main block" and "Estado" in rows[5].error and "5 participants" in rows[6].error


def test_carelessly_closed_pages():
    t = portal.tree("<table><thead><tr><th>a<th>b<tbody><tr><td>1<td>2<tr><td>3<td>4</table><ul><li>x<li>y</ul><p>one<div>two</div><br>three")
    assert [[c.said() for c in r.all("td")] for r in t.all("tr")] == [[], ["1", "2"], ["3", "4"]]
    assert [n.said() for n in t.all("li")] == ["x", "y"] and t.first("p").said() == "one"


def test_landed_files(spark, tmp_path):
    for k, body in enumerate(('{"recordsTotal": 2, "data": [{"id": "9", "estado": 1}, {"id": "4", "estado": 2}]}', '{"recordsTotal": 1, "data": [{"id": "5"}]}')):
        (tmp_path / f"{k}.json").write_text(body)
    assert [r.id for r in portal.read_listing(spark, str(tmp_path / "*.json")).collect()] == ["4", "9"]
    options = "".join(f"<option value='{n}'>Órgano {n}</option>" for n in range(60))
    (tmp_path / "b.html").write_bytes(f"<select id='organoA'>{options}</select>".encode("latin-1"))
    found = portal.body_rows(portal.read_html(spark, str(tmp_path / "b.html"))).collect()
    assert len(found) == 60 and found[3].name == "Órgano 3" and found[0].error is None
    assert portal.body_rows(spark.createDataFrame([("<p>x</p>",)], "html string")).first().error


def test_json_pages(spark):
    raw = spark.createDataFrame([('{"recordsTotal": 2, "data": [{"id": 1}, {"id": 2}]}',), ('{"recordsTotal": 1, "data": [{"id": null}]}',), ('{"data": []}',), ('{"recordsTotal": 0}',), ("x",)], "value string")
    checked = portal.pages(raw, portal.CONTRACT_PAGE)
    assert [r.error is None for r in checked.collect()] == [True, False, False, False, False]
    assert portal.entries(checked).count() == 2
    with pytest.raises(ValueError):
        portal.decode_page(b'{"recordsTotal": "2", "data": []}')


def test_fetcher_retries_and_opens():
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def fail(url):
        calls.append(url)
        raise urllib.error.HTTPError(url, 503, "busy", {}, None)

    f = portal.Fetcher(fetch=fail, clock=lambda: now[0], sleep=sleep)
    with pytest.raises(urllib.error.HTTPError):
        f("u")
    assert len(calls) == 3
    with pytest.raises((urllib.error.HTTPError, RuntimeError)):
        f("u")
    with pytest.raises(RuntimeError):
        f("u")


def test_backward_walk():
    data = {date(2024, 1, 1): 150, date(2023, 6, 1): 20}
    kept = []

    def fetch(a, z, offset):
        n = sum(v for d, v in data.items() if a <= d < z)
        return list(range(offset, min(n, offset + 100)))

    got = imports.backward_walk(fetch, kept.extend, lambda: len(kept), lambda: 170, date(2024, 2, 1), date(2023, 1, 1))
    assert got.complete and got.fetched == 170
    stopped = imports.backward_walk(fetch, kept.extend, lambda: 0, lambda: 170, date(2024, 2, 1), date(2023, 1, 1), guard=lambda: False)
    assert not stopped.complete and not stopped.clean and stopped.cursor == date(2024, 2, 1)


def test_settle_isolates():
    noted = {}

    def work(b):
        if b == "x":
            raise ValueError("bad  page")

    assert imports.settle(["a", "x"], work, lambda b, s, r: noted.update({b: r})) == {"a": "SUCCEEDED", "x": "FAILED"}
    assert noted == {"a": None, "x": "bad page"}


def test_stream(spark, tmp_path):
    stream = metrics.read_samples(spark, "/root/testdata/sf0.001", names="events.parquet")
    metrics.run_once(metrics.counters(stream), "counted", str(tmp_path / "c"))
    assert spark.table("counted").groupBy().sum("n").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_guard(spark, tmp_path):
    from acopio.streaming.guard import Guard

    now = [time.time()]
    one, two = (Guard(spark, str(tmp_path / "guard"), stale=60, clock=lambda: now[0]) for _ in range(2))
    assert one.acquire() and not two.acquire()
    now[0] += 50
    one.renew()
    now[0] += 50
    assert not two.acquire()
    one.release()
    assert two.acquire() and not one.acquire()
    now[0] += 200
    assert one.acquire()  # the other did not renew
