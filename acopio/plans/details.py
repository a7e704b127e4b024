"""Records, consortia and the smaller operators over the role map."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from acopio.functions import clean, formats
from acopio.operators import browse, hierarchy, runs, suppliers, tenders, upsert
from acopio.plans import roles
from acopio.plans.book import Book
from acopio.plans.roles import with_ctes
from acopio.sources import portal

Q = Book()
_NUMBER = "lpad(CAST(c_custkey AS VARCHAR), 8, '0')"


def _rows_html(rows):
    return F.concat(F.lit("<tbody>"), rows, F.lit("</tbody></table></div>"))


def _head(where: str, *heads: str) -> str:
    return f"<div id='{where}'><table><thead><tr>" + "".join(f"<th><a> {h} </a></th>" for h in heads) + "</tr></thead>"


def _records(spark, sf):
    """Record pages of the portal's shape, one a customer k: every fifth is the site's error page; k % 3 awards;
    even ones have a consortium, identified unless k % 4 = 0; every eleventh states a wrong number of participants."""
    k = F.col("c_custkey")
    text, number = k.cast("string"), F.lpad(k.cast("string"), 8, "0")
    award = lambda lot, part: F.concat(F.lit(f"<tr><td>{lot}</td><td>"), part, F.lit("</td><td>Adxudicado</td><td>ACME</td><td>1.200,50</td><td>01-02-2024</td><td>1 mes</td></tr>"))
    one, two = award("01", F.when(k % 11 == 0, "9").otherwise("-")), award("02", F.lit("-"))
    awards = F.concat(F.lit(_head("consulta-resolucion", "Lote", "Part.", "Resolución", "Adxudicatario", "Importe", "Data difusión", "Prazo de execución")), _rows_html(F.concat(F.when(k % 3 >= 1, one).otherwise(""), F.when(k % 3 == 2, two).otherwise(""))))
    union = F.concat(F.lit("<tr><td>1</td><td>"), F.when(k % 4 == 0, "-").otherwise(F.concat(F.lit("u"), number)), F.lit("</td><td><ul><li>UTE "), text, F.lit("</li><ul><li>A"), number, F.lit(" - SOCIA UNHA</li><li>SEN - NOME</li></ul></ul></td></tr>"))
    firm = F.concat(F.lit("<tr><td> 1</td><td> b"), number, F.lit(" </td><td><ul><li> Firm "), text, F.lit("</li></ul></td></tr>"))
    bidders = F.concat(F.lit(_head("ventanaModalLicitadores", "Lote", "NIF", "Nome")), _rows_html(F.concat(F.when(k % 2 == 0, union).otherwise(""), firm)))
    lots = F.when(k % 7 == 0, F.lit(_head("ventanaModalLotes", "Lote", "Descrición") + "<tbody><tr><td>1</td><td>un</td></tr><tr><td>3</td><td>tres</td></tr></tbody></table></div>")).otherwise("")
    main = F.concat(F.lit("<div class='acordoMarco'><dl><dt>Obxecto</dt><dd></dd></dl></div><p>Estado do procedemento: <em>Adxudicado</em></p><div class='infoReferencia'><dl><dt>Referencia</dt><dd> EXP "), text, F.lit("</dd></dl></div><div class='infoConcurso'><dl><dt>Obxecto</dt><dd>Obra  "), text, F.lit("</dd></dl></div>"))
    page = F.when(k % 5 != 0, F.concat(main, awards, bidders, lots)).otherwise(F.lit("<p>nada</p>"))
    return portal.records(roles.table(spark, sf, "customer").select(k, page.alias("html")), "c_custkey", "html")


_GOOD = "c_custkey % 5 <> 0 AND NOT (c_custkey % 11 = 0 AND c_custkey % 3 >= 1)"


@Q.query(f"SELECT c_custkey AS key, {_GOOD} AS ok, CASE WHEN {_GOOD} THEN 'Adxudicado' END AS state, CASE WHEN {_GOOD} THEN 'Obra  ' || c_custkey END AS object, CASE WHEN {_GOOD} THEN 'EXP ' || c_custkey END AS reference FROM customer")
def parse_records(spark, sf):
    """SRC7 HX1 HX2: the main block's label, not an empty copy before it; other pages become errors."""
    return _records(spark, sf).select("key", F.col("error").isNull().alias("ok"), "state", F.col("labels")["Obxecto"].alias("object"), "reference")


@Q.query(f"SELECT c_custkey AS key, g.n AS pos, '0' || (g.n + 1) AS lot, 1200.5 AS amount, '2024-02-01' AS day FROM customer, generate_series(0, 1) AS g(n) WHERE g.n < c_custkey % 3 AND {_GOOD}")
def record_awards(spark, sf):
    """HX3 HX4 MP1: cells by header, cleaned; a wrong number of participants loses the record (AG6)."""
    row = lambda c: F.col("row")[c]
    rows = portal.table(_records(spark, sf), "awards")
    return rows.select("key", F.col("pos").cast("long").alias("pos"), row("Lote").alias("lot"), clean.parse_amount(row("Importe")).cast("double").alias("amount"), clean.record_date(row("Data difusión")).cast("string").alias("day"))


@Q.query(f"""SELECT c_custkey AS key, '1' AS lot, true AS consortium, 'UTE ' || c_custkey AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'U' || {_NUMBER} END AS fiscal_id, 'A' || {_NUMBER} || ':SOCIA UNHA,:SEN - NOME' AS members FROM customer WHERE c_custkey % 2 = 0 AND {_GOOD}
    UNION ALL SELECT c_custkey, '1', false, 'Firm ' || c_custkey, 'B' || {_NUMBER}, NULL FROM customer WHERE {_GOOD}""")
def record_bidders(spark, sf):
    """HX4 HX6: a consortium is told by the list within its cell."""
    member = F.transform("members", lambda m: F.concat(F.coalesce(m["fiscal_id"], F.lit("")), F.lit(":"), m["name"]))
    return portal.parties(_records(spark, sf)).select("key", "lot", "consortium", "name", "fiscal_id", F.array_join(member, ",").alias("members"))


@Q.query(f"""SELECT c_custkey AS key, '1' AS lot, CASE WHEN c_custkey % 3 >= 1 THEN '01' ELSE '1' END AS printed, CASE WHEN c_custkey % 7 = 0 THEN 'un' END AS description FROM customer WHERE {_GOOD}
    UNION ALL SELECT c_custkey, '2', '02', NULL FROM customer WHERE c_custkey % 3 = 2 AND {_GOOD} UNION ALL SELECT c_custkey, '3', '3', 'tres' FROM customer WHERE c_custkey % 7 = 0 AND {_GOOD}""")
def record_lots(spark, sf):
    """HX5 SF12: the first spelling in the order of the tables, the lots table's description."""
    return _records(spark, sf).where("error is null").select("key", F.explode("lots").alias("x")).select("key", "x.lot", "x.printed", "x.description")


_PARTIES = """, p AS (SELECT tender, lot, part AS pos, CASE WHEN part % 13 <> 0 THEN 'ute' || CAST(part % 20 AS VARCHAR) END AS fold, CASE WHEN part % 5 = 0 THEN 'U' || lpad(CAST(part AS VARCHAR), 8, '0') END AS fiscal_id FROM awards WHERE part % 3 = 0),
f AS (SELECT tender, part AS pos, 'ute' || CAST(part % 20 AS VARCHAR) AS fold, 'F' || lpad(CAST(part AS VARCHAR), 8, '0') AS fiscal_id FROM awards WHERE part % 2 = 0 AND part % 7 <> 0),
b AS (SELECT tender, fold, arg_min(fiscal_id, pos) FILTER (WHERE fiscal_id IS NOT NULL) AS bid FROM p WHERE fold IS NOT NULL GROUP BY ALL), g AS (SELECT tender, fold, arg_min(fiscal_id, pos) AS form FROM f GROUP BY ALL),
i AS (SELECT b.tender, b.fold, coalesce(bid, form) AS fiscal_id, CASE WHEN bid IS NULL AND form IS NOT NULL THEN 'FORMALISATION' ELSE 'BIDDER' END AS path, coalesce(bid, form, sha256(b.tender || '|' || b.fold)) AS party FROM b LEFT JOIN g ON g.tender = b.tender AND g.fold = b.fold)"""


def _parties(spark, sf):
    a, n = roles.awards(spark, sf), F.col("part").cast("string")
    fold = F.concat(F.lit("ute"), (F.col("part") % 20).cast("string"))
    p = a.where("part % 3 = 0").select("tender", "lot", F.col("part").alias("pos"), F.when(F.col("part") % 13 != 0, fold).alias("fold"), F.lit("UTE").alias("name"), F.when(F.col("part") % 5 == 0, F.concat(F.lit("U"), F.lpad(n, 8, "0"))).alias("fiscal_id"))
    f = a.where("part % 2 = 0").select("tender", F.col("part").alias("pos"), fold.alias("fold"), F.when(F.col("part") % 7 != 0, F.concat(F.lit("F"), F.lpad(n, 8, "0"))).alias("fiscal_id"))
    return p, f


@Q.query(with_ctes("awards") + _PARTIES + " SELECT * FROM i")
def consortium_identity(spark, sf):
    """RES7: a bidder row's identifier, else a formalisation's of that name, else none."""
    return tenders.consortium_identity(*_parties(spark, sf)).drop("name")


@Q.query(with_ctes("awards") + _PARTIES + " SELECT tender, count(*) AS entries, count(DISTINCT party) AS parties FROM i WHERE fiscal_id IS NULL GROUP BY tender")
def unidentified_consortia(spark, sf):
    """RES6: one entry a tender and folded name."""
    return tenders.consortium_identity(*_parties(spark, sf)).where("fiscal_id is null").groupBy("tender").agg(F.count("*").alias("entries"), F.countDistinct("party").alias("parties"))


@Q.query(with_ctes("awards") + _PARTIES + " SELECT p.tender, p.lot, party, false AS won FROM p LEFT JOIN i ON i.tender = p.tender AND i.fold = p.fold", doubles=("lot",))
def consortium_bids(spark, sf):
    """RES8 RES12: rows of one name are one party; a row without a name is a bid by nobody."""
    p, f = _parties(spark, sf)
    return tenders.consortium_bids(p, tenders.consortium_identity(p, f))


@Q.query("SELECT s_suppkey AS consortium, 'A' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS member FROM supplier WHERE s_suppkey % 3 <> 0 UNION SELECT s_suppkey, 'C' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') FROM supplier")
def consortium_members(spark, sf):
    """RES9: unusable identifiers, repeats and the consortium itself are left out."""
    k = F.col("s_suppkey")
    number = F.lpad(k.cast("string"), 8, "0")
    own = F.concat(F.lit("U"), number)
    rows = roles.table(spark, sf, "supplier").select(k, own.alias("consortium"), F.array(F.when(k % 3 == 0, F.lit(" - ")).otherwise(F.concat(F.lit("a"), number)), F.concat(F.lit("C"), number), F.concat(F.lit("c"), number, F.lit(" ")), F.lower(own), F.lit("TEMP-1")).alias("members"))
    return tenders.consortium_members(rows).select(F.substring("consortium", 2, 8).cast("long").alias("consortium"), "member")


@Q.query("SELECT coalesce(s.c, i.c) AS consortium, coalesce(s.m, i.m) AS member, CASE WHEN i.c IS NOT NULL THEN false ELSE s.w END AS withdrawn FROM (SELECT s_suppkey AS c, s_suppkey * 10 + 1 AS m, s_suppkey % 4 < 2 AS w FROM supplier WHERE s_suppkey % 3 <> 0) s FULL JOIN (SELECT s_suppkey AS c, s_suppkey * 10 + 1 AS m FROM supplier WHERE s_suppkey % 2 = 0) i ON s.c = i.c AND s.m = i.m")
def membership_upsert(spark, sf):
    """UPS11: a pair named again is not withdrawn any more."""
    k = F.col("s_suppkey")
    rows = roles.table(spark, sf, "supplier").select(k.alias("consortium"), (k * 10 + 1).alias("member"), (k % 4 < 2).alias("withdrawn"))
    return upsert.upsert(rows.where("consortium % 3 <> 0"), rows.where("consortium % 2 = 0").withColumn("withdrawn", F.lit(False)), ["consortium", "member"])


@Q.query(f"SELECT 'B' || {_NUMBER} AS fiscal_id, c_name AS name, c_custkey % 4 = 0 OR c_custkey % 3 = 0 AS ute FROM customer UNION ALL SELECT 'N' || {_NUMBER}, 'UTE ' || c_custkey, true FROM customer WHERE c_custkey % 5 = 0")
def mark_consortia(spark, sf):
    """RES5 UPS15: inserted marked, or the incumbent marked with its name kept."""
    k, number = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    c = roles.table(spark, sf, "customer")
    known = c.select(F.concat(F.lit("B"), number).alias("fiscal_id"), F.col("c_name").alias("name"), (k % 4 == 0).alias("ute"))
    found = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("B"), number).alias("fiscal_id"), F.lit("other").alias("name")).unionByName(c.where("c_custkey % 5 = 0").select(F.concat(F.lit("N"), number).alias("fiscal_id"), F.concat(F.lit("UTE "), k.cast("string")).alias("name")))
    return suppliers.mark_consortia(known, found)


_SHOWN = """WITH c AS (SELECT c_custkey AS supplier, 'old' AS name, CASE WHEN c_custkey % 5 <> 0 THEN DATE '2024-01-02' END AS d, c_custkey % 7 AS i FROM customer),
n AS (SELECT c_custkey AS supplier, CASE WHEN c_custkey % 11 = 0 THEN 'old' ELSE 'new' END AS name, CASE c_custkey % 3 WHEN 1 THEN DATE '2024-01-02' WHEN 2 THEN DATE '2024-01-03' END AS d, c_custkey % 6 AS i FROM customer WHERE c_custkey % 2 = 0),
r AS (SELECT c_custkey AS supplier, 'new' AS name, DATE '2024-01-01' AS d, 1 AS i FROM customer WHERE c_custkey % 4 = 0),
x AS (SELECT c.supplier, c.name, c.d, c.i, n.name AS new, n.d AS nd, n.i AS ni, n.supplier IS NOT NULL AND (coalesce(n.d, DATE '0001-01-01'), n.i) > (coalesce(c.d, DATE '0001-01-01'), c.i) AS up FROM c LEFT JOIN n USING (supplier)),
s AS (SELECT supplier, CASE WHEN up THEN new ELSE name END AS name, CASE WHEN up THEN nd ELSE d END AS d, CASE WHEN up THEN ni ELSE i END AS i FROM x),
k AS (SELECT * FROM r UNION ALL SELECT supplier, name, d, i FROM x WHERE up AND name <> new UNION ALL SELECT supplier, new, nd, ni FROM x WHERE NOT up AND new <> name)"""


@Q.query(_SHOWN + """ SELECT supplier, name, CAST(d AS VARCHAR) AS day, CAST(i AS BIGINT) AS id, 'shown' AS kind FROM s UNION ALL
    SELECT supplier, name, CAST(arg_max(d, (coalesce(d, DATE '0001-01-01'), i)) AS VARCHAR), CAST(arg_max(i, (coalesce(d, DATE '0001-01-01'), i)) AS BIGINT), 'retained' FROM k WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.supplier = k.supplier AND s.name = k.name) GROUP BY supplier, name""")
def promote_names(spark, sf):
    """UPS14 RES2 RES3: a reading that outranks is shown and its retained copy goes; the displaced name is retained."""
    k, day = F.col("c_custkey"), lambda x: F.lit(x).cast("date")
    c = roles.table(spark, sf, "customer")
    shown = c.select(k.alias("supplier"), F.lit("old").alias("name"), F.when(k % 5 != 0, day("2024-01-02")).alias("rank_date"), (k % 7).alias("rank_id"))
    new = c.where(k % 2 == 0).select(k.alias("supplier"), F.when(k % 11 == 0, "old").otherwise("new").alias("name"), F.when(k % 3 == 1, day("2024-01-02")).when(k % 3 == 2, day("2024-01-03")).alias("date"), (k % 6).alias("source_id"))
    kept = c.where(k % 4 == 0).select(k.alias("supplier"), F.lit("new").alias("name"), day("2024-01-01").alias("last_date"), F.lit(1).cast("long").alias("last_id"))
    a, b = suppliers.promote_names(shown, kept, new)
    return a.toDF("supplier", "name", "day", "id").withColumn("kind", F.lit("shown")).unionByName(b.toDF("supplier", "name", "day", "id").withColumn("kind", F.lit("retained"))).withColumn("day", F.col("day").cast("string"))


@Q.query(with_ctes("awards") + "SELECT tender, lot, CASE WHEN lot % 3 <> 0 THEN tender * 10 + lot END AS lot_id, lot IS NULL OR lot % 3 <> 0 AS stored FROM awards", doubles=("lot", "lot_id"))
def lot_lookup(spark, sf):
    """JN12: the stored lot of each row; what isn't stored is told (by default it is an error)."""
    a = roles.awards(spark, sf).select("tender", "lot")
    return tenders.at_lots(a, a.where("lot % 3 <> 0").withColumn("lot_id", F.col("tender") * 10 + F.col("lot")), strict=False)


@Q.query(with_ctes("tenders", "awards") + "SELECT supplier_id, CAST(arg_max(publication_date, (publication_date, tender)) AS VARCHAR) AS day, max_by(tender, (publication_date, tender)) AS publication FROM tenders JOIN awards USING (tender) WHERE supplier_id IS NOT NULL AND tender % 10 <> 0 GROUP BY supplier_id")
def awardee_ranks(spark, sf):
    """RES13: by the tender's date and numeric publication id; other ids rank nothing."""
    t = roles.tenders(spark, sf).select("tender", tenders.awardee_rank(F.col("publication_date"), F.concat(F.when(F.col("tender") % 10 == 0, "x").otherwise(""), F.col("tender").cast("string"))).alias("rank"))
    top = t.where("rank is not null").join(roles.awards(spark, sf).where("supplier_id is not null").select("tender", "supplier_id"), "tender").groupBy("supplier_id").agg(F.max("rank").alias("r"))
    return top.select("supplier_id", F.col("r.date").cast("string").alias("day"), F.col("r.source_id").alias("publication"))


_UPSERT = "SELECT {keys}, CAST(CASE WHEN i.k IS NOT NULL THEN i.v ELSE s.v END AS DOUBLE) AS v FROM (SELECT {own}, amount AS v, 1 AS k FROM awards WHERE tender % 3 <> 0 {more}) s FULL JOIN (SELECT {own}, amount + 1 AS v, 1 AS k FROM awards WHERE tender % 2 = 0 {more}) i ON {on}"


def _upsert_sql(own: dict[str, str], more: str = "") -> str:
    return with_ctes("awards") + _UPSERT.format(keys=", ".join(f"CASE WHEN s.k IS NOT NULL THEN s.{c} ELSE i.{c} END AS {c}" for c in own), own=", ".join(f"{x} AS {c}" for c, x in own.items()), on=" AND ".join(f"s.{c} IS NOT DISTINCT FROM i.{c}" for c in own), more=more)


def _upserted(spark, sf, own: dict[str, str]):
    a = roles.awards(spark, sf).selectExpr("tender AS t0", *[f"{x} AS {c}" for c, x in own.items()], "amount AS v")
    new = a.where("t0 % 2 = 0").drop("t0").withColumn("v", (F.col("v") + 1).cast("decimal(18,2)"))
    return upsert.upsert(a.where("t0 % 3 <> 0").drop("t0"), new, list(own)).withColumn("v", F.col("v").cast("double"))


_FORM = {"tender": "tender", "lot": "lot"}
_CLASS = {"tender": "tender", "lot": "lot", "code": "part % 100"}
_BID = {"tender": "tender", "lot": "lot", "supplier_id": "supplier_id"}


@Q.query(_upsert_sql(_FORM), doubles=("lot",))
def formalisation_upsert(spark, sf):
    """UPS7: on tender and lot, null for the whole."""
    return _upserted(spark, sf, _FORM)


@Q.query(_upsert_sql(_CLASS), doubles=("lot",))
def classification_upsert(spark, sf):
    """UPS8: on tender, lot and code."""
    return _upserted(spark, sf, _CLASS)


@Q.query(_upsert_sql(_BID), doubles=("lot", "supplier_id"))
def participation_upsert(spark, sf):
    """UPS10: on tender, lot and supplier, each of which but the first may be null."""
    return _upserted(spark, sf, _BID)


@Q.query(with_ctes("tenders") + "SELECT tender, 'F' AS code FROM tenders WHERE state = 'F'")
def tender_states(spark, sf):
    """FIL5: by code; an unknown one matches nothing."""
    t = roles.tenders(spark, sf)
    one = lambda c: tenders.with_state(t, c).select("tender", F.lit(c).alias("code"))
    return one("F").unionByName(one("?"))


@Q.query(with_ctes("tenders", "classes") + "SELECT DISTINCT cpv, CASE WHEN length(cpv) % 2 = 0 THEN 'label ' || cpv END AS label FROM classes WHERE NOT withdrawn AND tender IN (SELECT tender FROM tenders WHERE body = '3-MEDIUM' AND publication_year = 1998)")
def cpv_labels(spark, sf):
    """SET4: a code that the vocabulary lacks keeps its place, with a null label."""
    words = roles.table(spark, sf, "part").where("length(p_type) % 2 = 0").select(F.col("p_type").alias("cpv"), F.concat(F.lit("label "), "p_type").alias("label")).distinct()
    return tenders.cpv_facets(roles.tenders(spark, sf).where("body = '3-MEDIUM' and publication_year = 1998"), roles.classes(spark, sf), words)


@Q.query(with_ctes("tenders") + "SELECT tender FROM tenders WHERE body = '2-HIGH' AND publication_year = 1996 AND tender % 19 <> 0")
def visible_tenders(spark, sf):
    """FIL4."""
    t = roles.tenders(spark, sf).withColumn("withdrawn", F.col("tender") % 19 == 0)
    return t.where(browse.visible_tender("2-HIGH", 1996)).select("tender")


@Q.query("SELECT c_custkey AS run, unnest([1, 2, 3]) AS body, unnest(['CONTRACTS', 'TENDERS', 'CONTRACTS']) AS family, 'PENDING' AS state, CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS refreshed FROM customer")
def run_coverage(spark, sf):
    """UPS19 AR1: coverage from two parallel arrays."""
    both = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("bodies"), F.array(F.lit("CONTRACTS"), F.lit("TENDERS"), F.lit("CONTRACTS")).alias("families"))
    return runs.enumerated(both)


@Q.query("""WITH c AS (SELECT DISTINCT user_id AS run, event_id % 3 AS body, 'CONTRACTS' AS family FROM events), l AS (SELECT user_id AS run, event_id % 3 AS body, sum(event_id % 5) AS a, sum(event_id % 2) AS r,
    arg_min(CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END, event_id) FILTER (WHERE event_id % 4 = 0) AS s FROM events WHERE event_id % 6 <> 0 GROUP BY ALL)
    SELECT c.run, c.body, c.family, CASE WHEN c.run % 7 = 0 THEN 'STOPPED' ELSE coalesce(l.s, 'PENDING') END AS state, CAST(coalesce(a, 0) AS BIGINT) AS added, CAST(coalesce(r, 0) AS BIGINT) AS refreshed FROM c LEFT JOIN l ON l.run = c.run AND l.body = c.body""")
def run_settled(spark, sf):
    """UPS19 AG7: counters add up; a settled row's state stays."""
    e = roles.table(spark, sf, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 3).alias("body"), F.lit("CONTRACTS").alias("family"), F.col("event_id").alias("pos"), "event_type")
    rows = e.select("run", "body", "family").distinct().select("*", F.when(F.col("run") % 7 == 0, "STOPPED").otherwise("PENDING").alias("state"), F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("refreshed"))
    state = F.when(F.col("pos") % 4 == 0, F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED")).otherwise("IN_PROGRESS")
    log = e.where("pos % 6 <> 0").select("run", "body", "family", "pos", (F.col("pos") % 5).alias("added"), (F.col("pos") % 2).alias("refreshed"), state.alias("state"))
    return runs.settled(rows, log)


@Q.query("SELECT c_custkey AS body, CAST(coalesce(n, 0) AS BIGINT) AS outstanding, n IS NOT NULL AS has_outstanding FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) ON k = c_custkey")
def outstanding_bodies(spark, sf):
    """UPS12 AG3: bodies with records to read again."""
    return upsert.outstanding_by(roles.table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("body")), roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("body")))


@Q.query("SELECT user_id, CAST(sum(coalesce(floor(gap / 15), 0)) AS BIGINT) AS beats FROM (SELECT user_id, epoch_us(ts) / 1000000.0 - lag(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id")
def stream_heartbeats(spark, sf):
    """ST1: a beat for every fifteen seconds without a sample."""
    from acopio.streaming import metrics

    return metrics.heartbeats(roles.table(spark, sf, "events"), "user_id")


@Q.query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE value IS NOT NULL AND value >= 0 GROUP BY user_id")
def stream_latest(spark, sf):
    """ST1: failing samples are skipped, of the others the newest is shown."""
    from acopio.streaming import metrics

    return metrics.latest(metrics.readable(roles.table(spark, sf, "events")), "user_id").select("user_id", "event_id")


@Q.query(with_ctes("runs", "coverage") + "SELECT run FROM runs WHERE trigger = 'MANUAL' AND state = 'SUCCEEDED' AND started_at < TIMESTAMP '2024-01-20' AND run IN (SELECT run FROM coverage WHERE mode = 'RESUMED') AND run IN (SELECT run FROM coverage WHERE body = 2)")
def run_list_narrowed(spark, sf):
    """FIL14: mode and body match if any covered row does, each on its own."""
    return runs.run_list(roles.runs(spark, sf), roles.coverage(spark, sf), body=2, state="SUCCEEDED", until=datetime(2024, 1, 20), trigger="MANUAL", mode="RESUMED").select("run")


@Q.query(with_ctes("coverage") + "SELECT run, body, family, state, count(*) AS n FROM coverage WHERE state IN ('SKIPPED', 'FAILED') AND family = 'TENDERS' GROUP BY ALL")
def unsettled_rows(spark, sf):
    """FIL9 FIL10: a set of states, one family."""
    return runs.unsettled(roles.coverage(spark, sf), ("SKIPPED", "FAILED"), "TENDERS").groupBy("run", "body", "family", "state").agg(F.count("*").alias("n"))


@Q.query(with_ctes("coverage") + "SELECT DISTINCT run, body, family, dense_rank() OVER (PARTITION BY run ORDER BY body, family) AS nth FROM coverage")
def coverage_pairs(spark, sf):
    """SET5 SO8: each pair once; their order within a run as a rank."""
    from pyspark.sql import Window

    return runs.coverage_pairs(roles.coverage(spark, sf)).withColumn("nth", F.dense_rank().over(Window.partitionBy("run").orderBy("body", "family")))


@Q.query("SELECT (TIMESTAMP '2024-01-01 00:00:00' <= max(ts) AND max(ts) FILTER (WHERE event_id // 40 % 4 = 1) >= TIMESTAMP '2024-01-19 23:45:00') AS held FROM events")
def guard_held(spark, sf):
    """ST8: a run in progress that advanced within the bound."""
    return runs.held(roles.runs(spark, sf), F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz"))


@Q.query("SELECT event_id AS k, strftime(CASE WHEN ts + INTERVAL 1 HOUR < date_trunc('day', ts + INTERVAL 1 HOUR) + INTERVAL 3 HOUR THEN date_trunc('day', ts + INTERVAL 1 HOUR) + INTERVAL 2 HOUR ELSE date_trunc('day', ts + INTERVAL 1 HOUR) + INTERVAL 26 HOUR END, '%Y-%m-%d %H:%M') AS next FROM events")
def next_trigger(spark, sf):
    """ST9: three o'clock in Madrid, after each instant (in January an hour ahead)."""
    return roles.table(spark, sf, "events").select(F.col("event_id").alias("k"), F.date_format(runs.next_trigger(F.col("ts").cast("timestamp"), 3), "yyyy-MM-dd HH:mm").alias("next"))


@Q.query("SELECT event_id % 97 AS id, CAST(sum(event_id % 5) AS BIGINT) AS total FROM events GROUP BY 1")
def guarded_counts(spark, sf):
    """NU5: a negative sample is an error, not a number."""
    return roles.table(spark, sf, "events").groupBy((F.col("event_id") % 97).alias("id")).agg(F.sum(runs.non_negative(F.col("event_id") % 5, "requests")).alias("total"))


@Q.query(with_ctes("terms") + "SELECT id, id IN (SELECT parent FROM terms WHERE parent IN (SELECT id FROM terms)) AS has_children FROM terms")
def term_children(spark, sf):
    """AG3."""
    t = roles.terms(spark, sf)
    return hierarchy.with_children(t).select("id", "has_children")


_PICK = """, m AS (SELECT id, parent FROM terms WHERE id % 211 = 12), up AS (SELECT id, parent FROM m UNION SELECT id, parent FROM terms WHERE id = 77 UNION SELECT t.id, t.parent FROM terms t JOIN up ON t.id = up.parent),
d AS (SELECT id FROM m UNION SELECT t.id FROM terms t JOIN d ON t.parent = d.id), k AS (SELECT id FROM up UNION SELECT id FROM d),
w AS (SELECT id, 0 AS depth FROM terms WHERE parent IS NULL UNION ALL SELECT t.id, w.depth + 1 FROM terms t JOIN w ON t.parent = w.id) SELECT k.id, name, depth FROM k JOIN w USING (id) JOIN terms USING (id)"""


@Q.query(with_ctes("terms", recursive=True) + _PICK)
def tree_picker(spark, sf):
    """HI5: matches, what is beneath and above, and a pinned path, with depths."""
    return hierarchy.picker(roles.terms(spark, sf), F.col("id") % 211 == 12, pinned=77).select("id", "name", F.col("depth").cast("int").alias("depth"))


@Q.query("SELECT count(*) AS users, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS admins, count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0) AS enabled_admins, count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0) > 1 AS may_disable FROM customer")
def admin_counters(spark, sf):
    """FIL15 AG21: the last enabled administrator stays."""
    return browse.may_disable(roles.table(spark, sf, "customer").select((F.col("c_mktsegment") == "BUILDING").alias("admin"), (F.col("c_acctbal") > 0).alias("enabled")))


@Q.query("SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'renamed' ELSE c_name END AS name, CASE WHEN c_custkey = 7 THEN NULL ELSE c_custkey % 9 END AS term FROM customer", doubles=("term",))
def single_row_update(spark, sf):
    """UPS17."""
    c = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 9).alias("term"))
    return browse.updated(c, "id", 7, {"name": F.lit("renamed"), "term": F.lit(None).cast("long")})


@Q.query(with_ctes("terms") + "SELECT id, parent FROM terms WHERE id <> (SELECT max(p_partkey) FROM part)", doubles=("parent",))
def term_deleted(spark, sf):
    """UPS18: a leaf goes; a term with others beneath is refused."""
    t = roles.terms(spark, sf)
    leaf = t.agg(F.max("id")).first()[0]
    return hierarchy.deleted(t, leaf).select("id", "parent")


@Q.query(with_ctes("suppliers") + "SELECT supplier_id, name FROM suppliers WHERE supplier_id IN (3, 5, 8, 13)")
def by_keys(spark, sf):
    """SRC8: a few keys reach the scan as a filter."""
    return browse.by_keys(roles.suppliers(spark, sf), "supplier_id", [3, 5, 8, 13]).select("supplier_id", "name")


@Q.query(with_ctes("contracts") + "SELECT DISTINCT body FROM contracts WHERE body IN ('1-URGENT', '?') AND amount IS NOT NULL AND supplier_id IS NOT NULL AND publication_date IS NOT NULL")
def candidates_visible(spark, sf):
    """SET6 JN2: among a few bodies; none asked, nothing read."""
    c = roles.contracts(spark, sf)
    return browse.visible_among(c, ["1-URGENT", "?"]).unionByName(browse.visible_among(c, []))


@Q.query("SELECT c_custkey AS body, row_number() OVER (ORDER BY strip_accents(lower(c_name)), c_custkey) AS nth FROM customer QUALIFY nth <= 100")
def body_order(spark, sf):
    """SO6 JN3: the first hundred in catalogue order, numbered."""
    c = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("body"), F.col("c_name").alias("name"))
    return numbered(browse.bodies_with_visible(c, c.select("body")).limit(100), *browse.catalogue_order(F.col("name"))).select("body", "nth")


def numbered(page, *order):
    """A page of bounded size with ``nth``, each row's place in it: order that a comparison of rows can see."""
    from pyspark.sql import Window

    return page.withColumn("nth", F.row_number().over(Window.orderBy(*order)))


_OLD = "SELECT supplier, name, CAST(max(date) AS VARCHAR) AS day FROM readings WHERE name IS NOT NULL AND source_id IS NOT NULL GROUP BY supplier, name"


@Q.query(with_ctes("readings") + f"SELECT r.supplier, r.name, 'B' || r.supplier AS fiscal_id FROM ({_OLD}) r WHERE r.supplier % 3 <> 0")
def identified_names(spark, sf):
    """JN5: names of suppliers with an identifier."""
    names = roles.readings(spark, sf).where("name is not null and source_id is not null").select("supplier", "name").distinct()
    known = names.select("supplier").distinct().withColumn("fiscal_id", F.when(F.col("supplier") % 3 != 0, F.concat(F.lit("B"), F.col("supplier").cast("string"))))
    return suppliers.identified_names(names, known)


@Q.query(with_ctes("readings") + f", n AS ({_OLD}) SELECT c_custkey AS supplier, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM n WHERE n.supplier = c_custkey), '') AS names FROM customer")
def supplier_names(spark, sf):
    """JN4: suppliers with their names; those without stay."""
    names = roles.readings(spark, sf).where("name is not null and source_id is not null").select("supplier", "name").distinct()
    return suppliers.with_names(roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("supplier")), names).select("supplier", F.array_join("names", ",").alias("names"))


@Q.query(with_ctes("contracts") + "SELECT source_id, CAST(amount AS DOUBLE) AS amount, row_number() OVER (ORDER BY amount DESC, source_id DESC) AS nth FROM contracts WHERE supplier_id = (SELECT min(supplier_id) FROM contracts) AND amount IS NOT NULL AND publication_date IS NOT NULL QUALIFY nth BETWEEN 4 AND 6")
def history_page(spark, sf):
    """SP2: a supplier's second page of three by amount, all years."""
    c = roles.contracts(spark, sf)
    first = c.agg(F.min("supplier_id")).first()[0]
    order = browse.Sort("amount").columns()
    page = suppliers.history(c.where(browse.visible()), first, order, 2, 3)
    return numbered(page, *order).select("source_id", F.col("amount").cast("double").alias("amount"), (F.col("nth") + 3).alias("nth"))


@Q.query(with_ctes("contracts") + "SELECT publication_year, count(*) AS n FROM contracts WHERE supplier_id = (SELECT min(supplier_id) FROM contracts) AND amount IS NOT NULL AND publication_date IS NOT NULL AND publication_year = 1996 GROUP BY 1")
def history_year(spark, sf):
    """SP2: the same section, of one year."""
    c = roles.contracts(spark, sf)
    first = c.agg(F.min("supplier_id")).first()[0]
    return suppliers.history(c.where(browse.visible()), first, browse.Sort().columns(), 1, 100, 1996).groupBy("publication_year").agg(F.count("*").alias("n"))


@Q.query(with_ctes("tenders", "awards", "classes") + """, bi AS (SELECT tender, lot, 1 + part % 20 AS supplier_id FROM awards), j AS (SELECT bi.*, EXISTS (SELECT 1 FROM awards a WHERE a.tender = bi.tender AND a.lot IS NOT DISTINCT FROM bi.lot AND a.supplier_id = bi.supplier_id) AS winner FROM bi)
    SELECT t.tender, coalesce((SELECT string_agg(coalesce(CAST(lot AS VARCHAR), '-') || ':' || coalesce(CAST(supplier_id AS VARCHAR), '-'), ',' ORDER BY lot NULLS FIRST) FROM awards a WHERE a.tender = t.tender), '') AS awards,
    coalesce((SELECT string_agg(supplier_id || CASE WHEN winner THEN '*' ELSE '' END, ',' ORDER BY lot NULLS FIRST) FROM j WHERE j.tender = t.tender), '') AS bidders,
    (SELECT count(*) FROM classes c WHERE c.tender = t.tender) AS n_classes, (SELECT count(*) FROM awards a WHERE a.tender = t.tender AND lot IS NOT NULL) AS n_lots, 0 AS n_formalisations FROM tenders t""")
def tender_page(spark, sf):
    """SP5 AR2: lots, awards, formalisations, classes and bidders of a tender, the winners marked."""
    a = roles.awards(spark, sf)
    bidders = a.select("tender", "lot", (F.col("part") % 20 + 1).alias("supplier_id"))
    made = tenders.detail(roles.tenders(spark, sf).select("tender"), a.where("lot is not null").select("tender", "lot"), a.select("tender", "lot", "supplier_id"), a.where("1 = 0").select("tender", "lot"), roles.classes(spark, sf), bidders)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    won = F.transform("awards", lambda x: F.concat(text(x["lot"]), F.lit(":"), text(x["supplier_id"])))
    bid = F.transform("bidders", lambda x: F.concat(x["supplier_id"].cast("string"), F.when(x["winner"], "*").otherwise("")))
    return made.select("tender", F.array_join(won, ",").alias("awards"), F.array_join(bid, ",").alias("bidders"), F.size("classes").cast("long").alias("n_classes"), F.size("lots").cast("long").alias("n_lots"), F.size("formalisations").alias("n_formalisations"))


@Q.query(with_ctes("tenders") + "SELECT body, count(DISTINCT publication_year) AS n_years, CASE WHEN body LIKE '1%' THEN 'COMPLETE' ELSE 'NEVER_STARTED' END AS import_status, body NOT LIKE '1%' AS partial, body NOT LIKE '5%' AS updating FROM tenders GROUP BY body")
def tender_section(spark, sf):
    """SP10: shown where a visible tender exists; says whether it is partial and updated."""
    t = roles.tenders(spark, sf)
    names = t.select("body").distinct()
    bodies = names.select("body", (~F.col("body").startswith("5")).alias("active"), F.lit(True).alias("importable"))
    return browse.section_state(t.withColumns({"amount": F.lit(1), "supplier_id": F.lit(1)}), bodies, names.where(F.col("body").startswith("1")).withColumn("state", F.lit("COMPLETE")))


@Q.query("SELECT n AS k, n % 4 = 0 OR n % 4 = 3 AS ok FROM (SELECT o_orderkey AS k, o_orderkey AS n FROM orders)")
def window_limits(spark, sf):
    """SRC3: three months at most, and nothing before its start."""
    k = F.col("o_orderkey")
    days = F.when(k % 4 == 0, 89).when(k % 4 == 1, 95).when(k % 4 == 2, -1).otherwise(0)
    start = F.lit("2024-01-10").cast("date")
    return roles.table(spark, sf, "orders").select(k.alias("k"), portal.within_limits(F.lit("b"), start, F.date_add(start, days.cast("int")), F.lit(0), F.lit(100)).alias("ok"))


@Q.query("SELECT c_custkey AS k, CAST(c_custkey % 10 AS BIGINT) AS estado, c_custkey * 2 AS id FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0")
def listing_pages(spark, sf):
    """SRC5 SRC6: a listing page fails whole without an id or a state; a bad date doesn't fail it."""
    k = F.col("c_custkey")
    row = F.struct(F.when(k % 7 != 0, (k * 2).cast("string")).alias("id"), F.lit("99-99-2024").alias("publicado"), F.when(k % 5 != 0, (k % 10).cast("int")).alias("estado"))
    raw = roles.table(spark, sf, "customer").select(k.alias("k"), F.to_json(F.struct(F.lit(1).alias("recordsTotal"), F.array(row).alias("data"))).alias("value"))
    return portal.entries(portal.pages(raw, portal.TENDER_PAGE, required=("id", "estado"))).select("k", F.col("estado").cast("long").alias("estado"), F.col("id").cast("long").alias("id"))


@Q.query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'x' WHEN 3 THEN NULL END AS name, c_custkey % 4 IN (0, 3) AS ok FROM customer")
def strict_bodies(spark, sf):
    """JS2: a number for a text, a text for a number or a list is refused, never turned into the other."""
    k = F.col("c_custkey")
    body = F.when(k % 4 == 0, '{"name": "x", "size": 3, "on": true}').when(k % 4 == 1, '{"name": 5, "size": 3, "on": true}').when(k % 4 == 2, '{"name": "x", "size": "3", "on": true}').otherwise('{"name": null, "size": 3}')
    made = portal.check_types(roles.table(spark, sf, "customer").select(k.alias("k"), body.alias("body")), "body", "name string, size bigint, on boolean")
    return made.select("k", F.col("parsed.name").alias("name"), F.col("error").isNull().alias("ok"))


@Q.query("SELECT p_partkey AS k, repeat('d', CASE WHEN p_partkey % 3 = 0 THEN 64 ELSE 10 END) AS duration, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE ' ' || p_name END AS kept, 'k' || p_partkey AS published, left('a b' || p_name || p_name || p_name || p_name, 40) AS echo FROM part")
def short_texts(spark, sf):
    """SF4 SF13 SF14 SF17."""
    k = F.col("p_partkey")
    many = F.concat(F.lit("a\nb"), "p_name", "p_name", "p_name", "p_name")
    return roles.table(spark, sf, "part").select(
        k.alias("k"), clean.duration(F.repeat(F.lit("d"), F.when(k % 3 == 0, 80).otherwise(10))).alias("duration"), clean.null_if_blank(F.when(k % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), "p_name"))).alias("kept"),
        clean.published_key(F.concat(F.lit(" k"), k.cast("string"), F.lit(" "))).alias("published"), clean.echo(many).alias("echo"),
    )


@Q.query("""SELECT o_orderkey AS k, replace(format('{:,}', CAST(o_orderkey * 1234 AS BIGINT)), ',', '.') AS n, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', '.') || ' €' AS euros,
    replace(format('{:.1f}', (o_orderkey % 1000) / 10.0), '.', ',') || ' %' AS part, day(o_orderdate) || ' ' || ['xan', 'feb', 'mar', 'abr', 'mai', 'xuñ', 'xul', 'ago', 'set', 'out', 'nov', 'dec'][month(o_orderdate)] || ' ' || year(o_orderdate) AS day FROM orders""")
def display_formats(spark, sf):
    """FM1: counts, money, shares and dates as they are shown."""
    k = F.col("o_orderkey")
    return roles.table(spark, sf, "orders").select(k.alias("k"), formats.count(k * 1234).alias("n"), formats.euros(F.col("o_totalprice").cast("decimal(18,2)")).alias("euros"), formats.share((k % 1000).cast("decimal(9,1)") / 1000).alias("part"), formats.day(F.to_date("o_orderdate")).alias("day"))
