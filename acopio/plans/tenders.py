"""Tender rows, facets, lots and award routes over the role map."""

from __future__ import annotations

from pyspark.sql import functions as F

from acopio.functions.fold import name_fold
from acopio.operators import browse, tenders
from acopio.plans import roles
from acopio.plans.book import Book
from acopio.plans.roles import with_ctes

Q = Book()
_ROWS = """, a AS (
    SELECT tender, sum(amount) AS awarded, count(DISTINCT CASE WHEN amount IS NOT NULL THEN lot END) AS awarded_lots,
           count(DISTINCT supplier_id) AS n_awardees, max(supplier_id) AS one
    FROM awards WHERE NOT withdrawn GROUP BY tender
), l AS (SELECT tender, count(DISTINCT lot) AS stored_lots FROM awards WHERE NOT withdrawn GROUP BY tender),
r AS (SELECT t.tender, t.body, t.publication_date, t.publication_year, t.state, coalesce(awarded, base_budget) AS amount,
           CASE WHEN awarded IS NOT NULL THEN 'AWARDED' WHEN base_budget IS NOT NULL THEN 'BUDGET' ELSE 'UNSTATED' END AS basis,
           awarded IS NOT NULL AND coalesce(awarded_lots, 0) < greatest(coalesce(stored_lots, 0), lote_count) AS partial,
           coalesce(n_awardees, 0) AS n_awardees, CASE WHEN n_awardees = 1 THEN one END AS awardee_id
      FROM tenders t LEFT JOIN a USING (tender) LEFT JOIN l USING (tender))"""


def _rows(spark, sf):
    a = roles.awards(spark, sf)
    return tenders.tender_rows(roles.tenders(spark, sf), a, a.select("tender", "lot", "withdrawn"))


@Q.query(with_ctes("tenders", "awards") + _ROWS + " SELECT tender, CAST(amount AS DOUBLE) AS amount, basis, partial, n_awardees, awardee_id FROM r", doubles=('awardee_id',))
def tender_rows(spark, sf):
    """AG12 AG13 AG14 JN13 FIL4."""
    return _rows(spark, sf).select("tender", F.col("amount").cast("double").alias("amount"), "basis", "partial", "n_awardees", "awardee_id")


def _amount_order(spark, sf, descending: bool):
    order = browse.Sort("amount", descending).columns("id_text", nulls_last=True)
    rows = _rows(spark, sf).where((F.col("body") == "2-HIGH") & (F.col("publication_year") == 1996)).withColumn("id_text", F.col("tender").cast("string"))
    return browse.page(rows, order, 2, 30).select("tender", F.col("amount").cast("double").alias("amount"), "basis")


@Q.query(with_ctes("tenders", "awards") + _ROWS + " SELECT tender, CAST(amount AS DOUBLE) AS amount, basis FROM r WHERE body = '2-HIGH' AND publication_year = 1996 ORDER BY r.amount DESC NULLS LAST, CAST(tender AS VARCHAR) DESC LIMIT 30 OFFSET 30")
def tender_amount_order(spark, sf):
    """SO10: nulls last whichever way, ties by the identifier as text."""
    return _amount_order(spark, sf, True)


@Q.query(with_ctes("tenders", "awards") + _ROWS + " SELECT tender, CAST(amount AS DOUBLE) AS amount, basis FROM r WHERE body = '2-HIGH' AND publication_year = 1996 ORDER BY r.amount ASC NULLS LAST, CAST(tender AS VARCHAR) LIMIT 30 OFFSET 30")
def tender_amount_order_asc(spark, sf):
    return _amount_order(spark, sf, False)


@Q.query(with_ctes("tenders", "awards") + _ROWS + " SELECT body, publication_year, count(*) AS n, CAST(sum(CASE WHEN basis = 'AWARDED' THEN amount END) AS DOUBLE) AS awarded FROM r GROUP BY body, publication_year")
def tender_year_totals(spark, sf):
    """SP6: totals count awards only."""
    return _rows(spark, sf).groupBy("body", "publication_year").agg(F.count("*").alias("n"), F.sum(F.when(F.col("basis") == "AWARDED", F.col("amount"))).cast("double").alias("awarded"))


@Q.query(with_ctes("tenders", "classes") + "SELECT DISTINCT cpv FROM classes WHERE NOT withdrawn AND tender IN (SELECT tender FROM tenders WHERE body = '3-MEDIUM' AND publication_year = 1998)")
def cpv_facets(spark, sf):
    """SET4."""
    t = roles.tenders(spark, sf).where("body = '3-MEDIUM' and publication_year = 1998")
    return tenders.cpv_facets(t, roles.classes(spark, sf))


@Q.query(with_ctes("tenders") + "SELECT DISTINCT state, CASE state WHEN 'F' THEN 'Adxudicado' ELSE 'En curso' END AS label FROM tenders WHERE body = '3-MEDIUM'")
def state_facets(spark, sf):
    """SET4: states O and P share a label and stay two."""
    t = roles.tenders(spark, sf).where("body = '3-MEDIUM'")
    states = roles.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("state")).distinct().withColumn("label", F.when(F.col("state") == "F", "Adxudicado").otherwise("En curso"))
    return tenders.state_facets(t, states)


@Q.query(with_ctes("tenders", "classes") + "SELECT tender FROM tenders t WHERE body = '3-MEDIUM' AND EXISTS (SELECT 1 FROM classes c WHERE c.tender = t.tender AND NOT c.withdrawn AND c.cpv = (SELECT min(p_type) FROM part))")
def cpv_filter(spark, sf):
    """FIL5 JN14."""
    code = roles.table(spark, sf, "part").agg(F.min("p_type")).first()[0]
    return tenders.with_cpv(roles.tenders(spark, sf).where("body = '3-MEDIUM'"), roles.classes(spark, sf), code).select("tender")


@Q.query("""SELECT tender, lot, arg_min(printed, pos) AS printed, arg_min(CASE WHEN line % 2 = 0 THEN 'lot ' || p END, pos) FILTER (WHERE line % 2 = 0) AS description FROM (
    SELECT l_orderkey AS tender, CAST(l_linenumber AS VARCHAR) AS lot, '0' || CAST(l_linenumber AS VARCHAR) AS printed, l_linenumber AS line, min(l_partkey) AS pos, CAST(min(l_partkey) AS VARCHAR) AS p
    FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY tender, lot""")
def lot_synthesis(spark, sf):
    """HX5 SF12 WN3."""
    from acopio.functions.clean import lot_key

    x = roles.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tender"), "l_linenumber").agg(F.min("l_partkey").alias("pos"))
    x = x.withColumn("printed", F.concat(F.lit("0"), F.col("l_linenumber").cast("string"))).withColumn("lot", lot_key(F.col("printed")))
    table = x.where("l_linenumber % 2 = 0").select("tender", "lot", "printed", F.concat(F.lit("lot "), F.col("pos").cast("string")).alias("description"), "pos")
    return tenders.lots_of(x.where("l_linenumber % 3 <> 0").select("tender", "lot", "printed", F.lit(0).alias("source"), "pos").unionByName(x.where("l_linenumber % 3 = 0").select("tender", "lot", "printed", F.lit(1).alias("source"), "pos")), table)


@Q.query(with_ctes("awards") + "SELECT tender, lot, stated, parsed FROM (SELECT tender, lot, max(CASE WHEN part % 3 = 0 THEN NULL ELSE 1 + part % 2 END) AS stated FROM awards GROUP BY tender, lot) s JOIN (SELECT tender, lot, count(*) AS parsed FROM awards GROUP BY tender, lot) c USING (tender) WHERE s.lot IS NOT DISTINCT FROM c.lot AND stated <> parsed".replace("SELECT tender, lot, stated, parsed FROM (", "SELECT s.tender, s.lot, stated, parsed FROM (", 1), doubles=('lot',))
def participants_differ(spark, sf):
    """AG5 AG6."""
    a = roles.awards(spark, sf)
    return tenders.participants_differ(a.select("tender", "lot", F.when(F.col("part") % 3 != 0, 1 + F.col("part") % 2).alias("stated")), a.select("tender", "lot"))


_CASCADE = """, x AS (SELECT tender, lot, supplier_id, part, 'name ' || CAST(part % 50 AS VARCHAR) AS name FROM awards),
aw AS (SELECT tender, lot, 'name' || CAST(part % 50 AS VARCHAR) AS fold FROM x WHERE part % 2 = 0),
fo AS (SELECT tender, lot, 'name' || CAST(CASE WHEN part % 9 = 0 THEN 99 ELSE part % 50 END AS VARCHAR) AS fold, supplier_id FROM x WHERE part % 3 = 0),
bi AS (SELECT tender, 'name' || CAST(part % 50 AS VARCHAR) AS fold, CASE WHEN part % 10 = 4 THEN NULL ELSE 1000 + part % 7 END AS supplier_id FROM x WHERE part % 4 = 0),
ca AS (SELECT DISTINCT 'name' || CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey % 60 END AS VARCHAR) AS fold, c_custkey AS supplier_id FROM customer),
co AS (SELECT tender, 'name' || CAST(part % 50 AS VARCHAR) AS fold, CASE WHEN tender % 2 = 0 THEN 5000 + part % 50 END AS supplier_id FROM x WHERE part % 11 = 0),
g AS (SELECT tender, fold, min(supplier_id) AS consortium FROM co GROUP BY ALL), f AS (SELECT tender, lot, min(fold) AS ff, min(supplier_id) AS fs FROM fo GROUP BY ALL),
b AS (SELECT tender, fold, count(DISTINCT supplier_id) AS ids, count(*) FILTER (WHERE supplier_id IS NULL) AS missing, min(supplier_id) AS bidder FROM bi GROUP BY ALL),
c AS (SELECT fold, count(DISTINCT supplier_id) AS matches, min(supplier_id) AS named FROM ca GROUP BY ALL),
r AS (SELECT aw.*, g.consortium, fs, bidder, named, CASE WHEN g.consortium IS NOT NULL THEN 'BIDDER' WHEN g.fold IS NOT NULL THEN 'UNRESOLVED'
        WHEN fs IS NOT NULL AND ff = aw.fold THEN 'FORMALISATION' WHEN ids = 1 AND missing = 0 THEN 'BIDDER' WHEN matches = 1 THEN 'NAME_DERIVED' ELSE 'UNRESOLVED' END AS path
      FROM aw LEFT JOIN g ON g.tender = aw.tender AND g.fold = aw.fold LEFT JOIN f ON f.tender = aw.tender AND f.lot IS NOT DISTINCT FROM aw.lot
      LEFT JOIN b ON b.tender = aw.tender AND b.fold = aw.fold LEFT JOIN c ON c.fold = aw.fold)
SELECT tender, lot, fold, path, CASE WHEN consortium IS NOT NULL THEN consortium WHEN path = 'FORMALISATION' THEN fs WHEN path = 'BIDDER' THEN bidder WHEN path = 'NAME_DERIVED' THEN named END AS awardee_id FROM r"""


@Q.query(with_ctes("awards") + _CASCADE, doubles=('lot', 'awardee_id'))
def award_cascade(spark, sf):
    """RES10 RES11 JN6 JN10 JN11."""
    x = roles.awards(spark, sf).withColumn("n", F.col("part") % 50)
    fold = name_fold(F.concat(F.lit("Náme "), F.col("n").cast("string")))
    other = name_fold(F.concat(F.lit("name "), F.when(F.col("part") % 9 == 0, F.lit(99)).otherwise(F.col("n")).cast("string")))
    aw = x.where("part % 2 = 0").select("tender", "lot", fold.alias("fold"))
    fo = x.where("part % 3 = 0").select("tender", "lot", other.alias("fold"), "supplier_id", F.lit(0).alias("pos"))
    bi = x.where("part % 4 = 0").select("tender", fold.alias("fold"), F.when(F.col("part") % 10 != 4, 1000 + F.col("part") % 7).alias("supplier_id"))
    # every third customer has a name of its own, the others share one of forty
    number = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") % 60)
    ca = roles.table(spark, sf, "customer").select(F.concat(F.lit("name"), number.cast("string")).alias("fold"), F.col("c_custkey").alias("supplier_id")).distinct()
    co = x.where("part % 11 = 0").select("tender", fold.alias("fold"), F.when(F.col("tender") % 2 == 0, 5000 + F.col("n")).alias("supplier_id"))
    return tenders.award_cascade(aw, fo, bi, ca, co)


@Q.query(with_ctes("awards") + "SELECT m AS supplier_id, tender, lot, CAST(amount AS DOUBLE) AS amount, false AS counts FROM awards JOIN (SELECT s_suppkey AS c, unnest([s_suppkey * 10 + 1, s_suppkey * 10 + 2]) AS m, s_suppkey % 3 = 0 AS w FROM supplier) ON c = supplier_id WHERE NOT w", doubles=('lot',))
def won_through_consortium(spark, sf):
    """SP4 JN15 FIL8."""
    s = roles.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("consortium"), F.explode(F.array(F.col("s_suppkey") * 10 + 1, F.col("s_suppkey") * 10 + 2)).alias("member"), (F.col("s_suppkey") % 3 == 0).alias("withdrawn"))
    return tenders.won_through(s, roles.awards(spark, sf).drop("withdrawn")).withColumn("amount", F.col("amount").cast("double"))


@Q.query(with_ctes("tenders", "awards", "classes") + """SELECT t.tender, coalesce(a.n, 0) AS n_awards, a.suppliers, coalesce(c.n, 0) AS n_cpv FROM tenders t
    LEFT JOIN (SELECT tender, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(supplier_id AS VARCHAR)) FILTER (WHERE supplier_id IS NOT NULL)), ',') AS suppliers FROM awards GROUP BY tender) a USING (tender)
    LEFT JOIN (SELECT tender, count(DISTINCT cpv) AS n FROM classes GROUP BY tender) c USING (tender)""")
def tender_detail(spark, sf):
    """SP5 AR2: children are gathered by tender before they are joined."""
    a = roles.awards(spark, sf).groupBy("tender").agg(F.count("*").alias("n_awards"), F.array_join(F.array_sort(F.collect_set(F.col("supplier_id").cast("string"))), ",").alias("s"))
    a = a.withColumn("suppliers", F.nullif("s", F.lit(""))).drop("s")
    c = roles.classes(spark, sf).groupBy("tender").agg(F.countDistinct("cpv").alias("n_cpv"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return roles.tenders(spark, sf).select("tender").join(a, "tender", "left").join(c, "tender", "left").select("tender", zero("n_awards"), "suppliers", zero("n_cpv"))


@Q.query(with_ctes("tenders") + "SELECT tender FROM tenders WHERE publication_date >= DATE '1998-06-01'")
def changed_since(spark, sf):
    """SP7: inclusive, so re-reading is harmless."""
    return roles.tenders(spark, sf).where("publication_date >= date'1998-06-01'").select("tender")
