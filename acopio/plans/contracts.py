"""Contract reads and imports over the role map."""

from __future__ import annotations

from pyspark.sql import functions as F

from acopio.operators import browse, upsert
from acopio.plans import roles
from acopio.plans.book import Book
from acopio.plans.roles import with_ctes

Q = Book()
BODY, YEAR = "1-URGENT", 1997
VISIBLE = "amount IS NOT NULL AND supplier_id IS NOT NULL AND publication_date IS NOT NULL"
_PAGE = "SELECT row_number() OVER (ORDER BY {order}) AS nth, source_id, CAST(publication_date AS VARCHAR) AS publication_date, CAST(amount AS DOUBLE) AS amount, name AS awardee_name, fiscal_id AS awardee_fiscal_id FROM contracts JOIN suppliers USING (supplier_id) WHERE body = '1-URGENT' AND publication_year = 1997 AND " + VISIBLE


def _ordered(order: str) -> str:
    return _PAGE.format(order=order) + f" ORDER BY {order}"


def _page(spark, sf, sort: browse.Sort, number: int):
    rows = browse.contract_page(roles.stored_contracts(spark, sf), roles.suppliers(spark, sf), BODY, YEAR, sort, number, 20)
    return _numbered(rows, number)


def _numbered(rows, number: int):
    """``nth`` numbers the page's rows (20 at most) as they come, so that a comparison sees their order."""
    rows = rows.coalesce(1).withColumn("nth", F.monotonically_increasing_id() + 1 + (number - 1) * 20)
    return rows.select("nth", "source_id", F.col("publication_date").cast("string").alias("publication_date"), F.col("amount").cast("double").alias("amount"), "awardee_name", "awardee_fiscal_id")


@Q.query(with_ctes("contracts", "suppliers") + _ordered("contracts.publication_date DESC, source_id DESC") + " LIMIT 20 OFFSET 40")
def browse_page_date_desc(spark, sf):
    """FIL1 JN1 SO1 SO3 PRJ1."""
    return _page(spark, sf, browse.Sort(), 3)


@Q.query(with_ctes("contracts", "suppliers") + _ordered("contracts.publication_date, source_id") + " LIMIT 20")
def browse_page_date_asc(spark, sf):
    return _page(spark, sf, browse.Sort(descending=False), 1)


@Q.query(with_ctes("contracts", "suppliers") + _ordered("contracts.amount DESC, source_id DESC") + " LIMIT 20 OFFSET 20")
def browse_page_amount_desc(spark, sf):
    return _page(spark, sf, browse.parse_sort("amount,desc"), 2)


@Q.query(with_ctes("contracts", "suppliers") + _ordered("contracts.amount, source_id") + " LIMIT 20")
def browse_page_amount_asc(spark, sf):
    return _page(spark, sf, browse.parse_sort("amount,asc"), 1)


@Q.query(with_ctes("contracts", "suppliers") + _ordered("contracts.amount DESC, source_id DESC") + " LIMIT 20 OFFSET 20")
def browse_page_after(spark, sf):
    """SO3 for deep pages: what follows the last row of the first page, by a filter instead of an offset."""
    rows, sort = roles.stored_contracts(spark, sf).where(browse.visible(YEAR, BODY)), browse.Sort("amount")
    last = rows.orderBy(*sort.columns()).limit(20).agg(F.min(F.struct("amount", "source_id")).alias("x")).first().x
    page = browse.page_after(rows, sort, last, 20)
    return _numbered(browse.with_awardees(page, roles.suppliers(spark, sf), sort), 2)


@Q.query(with_ctes("contracts") + f"SELECT 3 AS page, 20 AS size, count(*) AS total_items, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM contracts WHERE body = '1-URGENT' AND publication_year = 1997 AND {VISIBLE}")
def browse_count(spark, sf):
    """AG1 PRJ3: joins nothing."""
    return browse.envelope(roles.stored_contracts(spark, sf).where(browse.visible(YEAR, BODY)), 3, 20)


@Q.query(with_ctes("contracts") + f"SELECT DISTINCT publication_year FROM contracts WHERE body = '1-URGENT' AND {VISIBLE}")
def year_facets(spark, sf):
    """SET3 DT3: of the stored table, whose folders are the years."""
    return browse.years(roles.stored_contracts(spark, sf), BODY)


@Q.query(with_ctes("contracts", "suppliers") + f"SELECT supplier_id AS body FROM suppliers s WHERE EXISTS (SELECT 1 FROM contracts c WHERE c.supplier_id = s.supplier_id AND body = '1-URGENT' AND publication_year = 1997 AND {VISIBLE})")
def visible_bodies(spark, sf):
    """JN2."""
    some = roles.contracts(spark, sf).where(browse.visible(YEAR, BODY)).select("supplier_id")
    return browse.bodies_with_visible(roles.suppliers(spark, sf).select(F.col("supplier_id").alias("body")), some)


@Q.query(with_ctes("contracts", "suppliers", "awards") + f"SELECT supplier_id AS body FROM suppliers WHERE supplier_id IN (SELECT supplier_id FROM contracts WHERE publication_year = 1997 AND body = '1-URGENT' AND {VISIBLE} UNION SELECT supplier_id FROM awards WHERE NOT withdrawn)")
def visible_bodies_union(spark, sf):
    """JN3 SET2."""
    a = roles.contracts(spark, sf).where(browse.visible(YEAR, BODY)).select("supplier_id")
    b = roles.awards(spark, sf).where("not withdrawn").select("supplier_id")
    return browse.bodies_with_visible(roles.suppliers(spark, sf).select(F.col("supplier_id").alias("body")), a, b)


@Q.query(with_ctes("contracts") + f"SELECT publication_date IS NULL AS no_date, amount IS NULL AS no_amount, supplier_id IS NULL AS no_supplier, count(*) AS n FROM contracts WHERE NOT ({VISIBLE}) GROUP BY 1, 2, 3")
def anomalies_by_cause(spark, sf):
    """FIL2 FIL3."""
    return browse.anomalies(roles.contracts(spark, sf))


@Q.query(with_ctes("contracts") + "SELECT body, count(*) AS n FROM contracts GROUP BY body")
def completion_count(spark, sf):
    """AG2: anomalies included."""
    return roles.contracts(spark, sf).groupBy("body").agg(F.count("*").alias("n"))


_STATE = "state AS (SELECT DISTINCT o_orderpriority AS body, 'COMPLETE' AS state FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT DISTINCT o_orderpriority, 'INCOMPLETE' FROM orders WHERE o_orderpriority LIKE '2%')"


@Q.query(with_ctes("contracts") + f", {_STATE}, bodies AS (SELECT DISTINCT o_orderpriority AS body, o_orderpriority NOT LIKE '5%' AS active, o_orderpriority NOT LIKE '4%' AS importable FROM orders) SELECT b.body, count(DISTINCT publication_year) AS n_years, coalesce(max(s.state), 'NEVER_STARTED') AS import_status, coalesce(max(s.state), 'NEVER_STARTED') <> 'COMPLETE' AS partial, bool_and(active AND importable) AS updating, CASE coalesce(max(s.state), 'NEVER_STARTED') WHEN 'COMPLETE' THEN 'INCREMENTAL' WHEN 'INCOMPLETE' THEN 'RESUMED' ELSE 'INITIAL' END AS mode FROM contracts c JOIN bodies b USING (body) LEFT JOIN state s USING (body) WHERE {VISIBLE} GROUP BY b.body")
def section_state(spark, sf):
    """ST10 PRJ5 PRJ6 FIL6 JN4."""
    names = roles.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("body")).distinct()
    bodies = names.select("body", (~F.col("body").startswith("5")).alias("active"), (~F.col("body").startswith("4")).alias("importable"))
    state = names.select("body", F.when(F.col("body").startswith("1"), "COMPLETE").when(F.col("body").startswith("2"), "INCOMPLETE").alias("state")).where("state is not null")
    return browse.section_state(roles.contracts(spark, sf), bodies, state).withColumn("mode", browse.import_mode(F.col("import_status")))


_DUP = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY "


def _lines(spark, sf):
    return roles.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("l_quantity"))


@Q.query(_DUP + "l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1")
def dedup_last_wins(spark, sf):
    """UPS2 WN2, with a total order in place of arrival positions."""
    return upsert.distinct_by(_lines(spark, sf), ["l_orderkey", "l_linenumber"], [F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_quantity")])


@Q.query(_DUP + "l_partkey, l_suppkey, l_quantity) = 1")
def dedup_first_wins(spark, sf):
    """WN3."""
    return upsert.distinct_by(_lines(spark, sf), ["l_orderkey", "l_linenumber"], [F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_quantity")])


@Q.query(with_ctes("stored", "incoming") + "SELECT coalesce(s.source_id, i.source_id) AS source_id, CASE WHEN i.source_id IS NOT NULL THEN i.body ELSE s.body END AS body, CAST(CASE WHEN i.source_id IS NOT NULL THEN i.amount ELSE s.amount END AS DOUBLE) AS amount, CASE WHEN i.source_id IS NOT NULL THEN i.supplier_id ELSE s.supplier_id END AS supplier_id FROM stored s FULL JOIN incoming i ON s.source_id = i.source_id")
def upsert_rows(spark, sf):
    """UPS1: whole rows, nulls included."""
    return upsert.upsert(roles.stored(spark, sf), roles.incoming(spark, sf), ["source_id"]).withColumn("amount", F.col("amount").cast("double"))


@Q.query(with_ctes("stored", "incoming") + "SELECT count(*) FILTER (WHERE s.source_id IS NULL) AS added, count(*) FILTER (WHERE s.source_id IS NOT NULL) AS refreshed FROM incoming i LEFT JOIN stored s ON s.source_id = i.source_id")
def upsert_counts(spark, sf):
    """UPS3."""
    return upsert.upsert_counts(roles.stored(spark, sf), roles.incoming(spark, sf), ["source_id"])


@Q.query(with_ctes("stored", "incoming") + "SELECT coalesce(s.source_id, i.source_id) AS source_id, CASE WHEN s.source_id IS NOT NULL THEN s.body END AS body, coalesce(s.supplier_id, i.supplier_id) AS supplier_id, CAST(CASE WHEN i.source_id IS NOT NULL THEN i.amount ELSE s.amount END AS DOUBLE) AS amount FROM stored s FULL JOIN incoming i ON s.source_id = i.source_id")
def upsert_protected(spark, sf):
    """UPS4 UPS5: a protected column, and one whose first spelling stays."""
    return upsert.upsert(roles.stored(spark, sf), roles.incoming(spark, sf), ["source_id"], protected=["body"], first_spelling=["supplier_id"]).withColumn("amount", F.col("amount").cast("double"))


@Q.query(with_ctes("awards") + ", s AS (SELECT * FROM awards WHERE tender % 3 <> 0), i AS (SELECT tender, lot, amount + 1 AS amount FROM awards WHERE tender % 2 = 0) SELECT coalesce(s.tender, i.tender) AS tender, CASE WHEN s.tender IS NOT NULL THEN s.lot ELSE i.lot END AS lot, CAST(CASE WHEN i.tender IS NOT NULL THEN i.amount ELSE s.amount END AS DOUBLE) AS amount FROM s FULL JOIN i ON s.tender = i.tender AND coalesce(s.lot, -1) = coalesce(i.lot, -1)", doubles=('lot',))
def upsert_null_safe(spark, sf):
    """UPS6: a null lot is a key value."""
    a = roles.awards(spark, sf).select("tender", "lot", "amount")
    return upsert.upsert(a.where("tender % 3 <> 0"), a.where("tender % 2 = 0").withColumn("amount", (F.col("amount") + 1).cast("decimal(18,2)")), ["tender", "lot"]).withColumn("amount", F.col("amount").cast("double"))


@Q.query("SELECT coalesce(s.k, f.k) AS body, coalesce(f.name, s.name) AS name, f.k IS NOT NULL AS active, coalesce(s.importable, false) AS importable, CASE WHEN f.k IS NOT NULL AND s.k IS NULL THEN 'ADDED' WHEN f.k IS NOT NULL AND (NOT s.active OR s.name IS DISTINCT FROM f.name) THEN 'REFRESHED' WHEN f.k IS NULL AND s.active THEN 'DEACTIVATED' END AS change FROM (SELECT c_custkey AS k, c_name AS name, c_custkey % 4 <> 0 AS active, c_custkey % 2 = 0 AS importable FROM customer WHERE c_custkey % 5 <> 0) s FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN c_name || ' new' ELSE c_name END AS name FROM customer WHERE c_custkey % 3 <> 0) f ON s.k = f.k")
def reconcile_bodies(spark, sf):
    """UPS16 JN8 JN9."""
    c = roles.table(spark, sf, "customer").withColumn("body", F.col("c_custkey"))
    s = c.where("body % 5 <> 0").select("body", F.col("c_name").alias("name"), (F.col("body") % 4 != 0).alias("active"), (F.col("body") % 2 == 0).alias("importable"))
    f = c.where("body % 3 <> 0").select("body", F.when(F.col("body") % 6 == 0, F.concat("c_name", F.lit(" new"))).otherwise(F.col("c_name")).alias("name"))
    return upsert.reconcile_bodies(s, f)


@Q.query("SELECT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 29 <> 0)")
def orphan_rows(spark, sf):
    """UPS20."""
    parents = roles.table(spark, sf, "orders").where("o_orderkey % 29 <> 0").select(F.col("o_orderkey").alias("k"))
    return upsert.orphans(roles.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), parents, "k")


@Q.query("SELECT p_type AS code, min(p_name) AS label FROM part GROUP BY p_type")
def vocabulary_first_wins(spark, sf):
    """UPS9: descriptions are never overwritten."""
    rows = roles.table(spark, sf, "part").select(F.col("p_type").alias("code"), F.col("p_name").alias("label"))
    stored = rows.where("1 = 0")
    return upsert.vocabulary(stored, rows.withColumn("pos", F.col("label")), "code", "first")


@Q.query("SELECT o_orderkey AS k FROM orders WHERE (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AND o_orderkey % 15 <> 0")
def outstanding_ledger(spark, sf):
    """UPS12."""
    o = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return upsert.ledger(o.where("k % 3 = 0"), o.where("k % 5 = 0"), o.where("k % 15 = 0"), ["k"])


@Q.query(with_ctes("awards") + "SELECT tender, lot, CASE WHEN tender % 2 = 0 THEN coalesce(lot, 0) % 3 = 0 OR tender % 10 = 0 ELSE withdrawn END AS withdrawn FROM awards", doubles=('lot',))
def restated_children(spark, sf):
    """SP8: absent children of a re-read record are withdrawn, removals stay."""
    a = roles.awards(spark, sf)
    old = a.select("tender", "lot", "withdrawn", (F.col("tender") % 10 == 0).alias("removed"))
    again = a.where("tender % 2 = 0").withColumn("keep", F.coalesce("lot", F.lit(0)) % 3 != 0)
    marker = again.select("tender").distinct().select("tender", F.lit(-1).cast("int").alias("lot"))
    return upsert.withdraw_absent(old, again.where("keep").select("tender", "lot").unionByName(marker), "tender", ["lot"]).select("tender", "lot", "withdrawn")
