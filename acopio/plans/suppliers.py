"""Supplier names, matches, history and lists over the role map."""

from __future__ import annotations

from pyspark.sql import functions as F

from acopio.functions.fold import contains_folded, name_fold
from acopio.operators import browse, suppliers
from acopio.plans import roles
from acopio.plans.book import Book
from acopio.plans.contracts import VISIBLE
from acopio.plans.roles import with_ctes

Q = Book()
_CANDIDATES = """, opening AS (
    SELECT supplier, coalesce(name, '') AS name, date, coalesce(source_id, -9223372036854775807 - 1) AS source_id, pos
    FROM readings QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY pos) = 1
), shown AS (
    SELECT supplier, name, date, source_id FROM (
        SELECT supplier, name, date, source_id, pos FROM readings WHERE source_id IS NOT NULL AND name IS NOT NULL UNION ALL SELECT * FROM opening)
    QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY date DESC NULLS LAST, source_id DESC, pos) = 1
)"""


@Q.query(with_ctes("readings") + _CANDIDATES + " SELECT supplier, name, CAST(date AS VARCHAR) AS rank_date, source_id AS rank_id FROM shown")
def displayed_name(spark, sf):
    """RES1-RES4 WN1."""
    return suppliers.displayed_name(roles.readings(spark, sf)).withColumn("rank_date", F.col("rank_date").cast("string"))


@Q.query(with_ctes("readings") + _CANDIDATES + """ SELECT r.supplier, r.name, CAST(r.date AS VARCHAR) AS last_date, r.source_id AS last_id FROM (
    SELECT * FROM readings WHERE source_id IS NOT NULL AND name IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY supplier, name ORDER BY date DESC NULLS LAST, source_id DESC, pos) = 1) r
    WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.supplier = r.supplier AND s.name = r.name)""")
def retain_names(spark, sf):
    """RES4 UPS13 JN7."""
    return suppliers.retained_names(roles.readings(spark, sf)).withColumn("last_date", F.col("last_date").cast("string"))


@Q.query("SELECT fold, min(p_partkey) AS supplier FROM (SELECT p_partkey, nullif(regexp_replace(strip_accents(lower(p_name || ' ' || p_brand)), '[^a-z0-9]', '', 'g'), '') AS fold FROM part) WHERE fold IS NOT NULL GROUP BY fold HAVING count(DISTINCT p_partkey) = 1")
def unique_name_match(spark, sf):
    """AG11 SET1 SF9."""
    names = roles.table(spark, sf, "part").select(F.col("p_partkey").alias("supplier"), name_fold(F.concat_ws(" ", "p_name", "p_brand")).alias("fold"))
    return suppliers.unique_match(names)


_SECTIONS = f"""SELECT supplier_id, 'contracts' AS section, count(*) AS n, sum(amount) AS total, count(*) FILTER (WHERE amount IS NULL) AS unsummed FROM contracts WHERE publication_date IS NOT NULL AND supplier_id IS NOT NULL GROUP BY supplier_id
    UNION ALL SELECT supplier_id, 'awards', count(*), sum(amount), count(*) FILTER (WHERE amount IS NULL) FROM awards WHERE NOT withdrawn AND supplier_id IS NOT NULL GROUP BY supplier_id"""


def _sections(spark, sf):
    c = roles.contracts(spark, sf).where("publication_date is not null and supplier_id is not null").select("supplier_id", "amount")
    a = roles.awards(spark, sf).where("not withdrawn and supplier_id is not null").select("supplier_id", "amount")
    return suppliers.sections(c, a)


@Q.query(with_ctes("contracts", "awards") + f"SELECT supplier_id, section, n, CAST(total AS DOUBLE) AS total, unsummed FROM ({_SECTIONS})")
def history_totals(spark, sf):
    """AG15 AG17."""
    return _sections(spark, sf).select("supplier_id", "section", "n", F.col("total").cast("double").alias("total"), "unsummed")


@Q.query(with_ctes("contracts", "awards") + f"SELECT supplier_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS DOUBLE) AS total, CAST(sum(unsummed) AS BIGINT) AS unsummed FROM ({_SECTIONS}) GROUP BY supplier_id")
def history_combined(spark, sf):
    """AG16."""
    return suppliers.combined(_sections(spark, sf)).withColumn("total", F.col("total").cast("double"))


@Q.query(with_ctes("contracts") + f"SELECT DISTINCT supplier_id, publication_year FROM contracts WHERE {VISIBLE}")
def history_years(spark, sf):
    """SP2: years present for a supplier."""
    return roles.contracts(spark, sf).where(browse.visible()).select("supplier_id", "publication_year").distinct()


@Q.query(with_ctes("suppliers") + "SELECT supplier_id, name FROM suppliers ORDER BY strip_accents(lower(name)), fiscal_id, supplier_id LIMIT 50 OFFSET 100")
def supplier_list(spark, sf):
    """SO11 SO6 SO3."""
    return browse.page(roles.suppliers(spark, sf), suppliers.list_order(F.col("name")), 3, 50).select("supplier_id", "name")


@Q.query(with_ctes("suppliers") + "SELECT supplier_id, name FROM suppliers WHERE contains(strip_accents(lower(name)), strip_accents(lower('ER#00000012'))) OR fiscal_id = 'B00000007'")
def supplier_search(spark, sf):
    """FIL12 FIL13 SF15: a name by part, an identifier only whole."""
    return roles.suppliers(spark, sf).where(contains_folded(F.col("name"), "ÉR#00000012") | (F.col("fiscal_id") == "B00000007")).select("supplier_id", "name")


@Q.query(with_ctes("contracts", "suppliers", "awards") + f"SELECT supplier_id FROM suppliers WHERE supplier_id IN (SELECT supplier_id FROM contracts WHERE {VISIBLE} AND publication_year = 1996 UNION SELECT supplier_id FROM awards WHERE NOT withdrawn)")
def suppliers_reachable(spark, sf):
    """SP1."""
    c = roles.contracts(spark, sf).where(browse.visible(1996)).select("supplier_id")
    a = roles.awards(spark, sf).where("not withdrawn").select("supplier_id")
    return suppliers.reachable(roles.suppliers(spark, sf), c, a).select("supplier_id")


@Q.query(with_ctes("awards") + ", bids AS (SELECT tender, lot, 1 + part % 100 AS supplier_id FROM awards) SELECT * FROM bids b WHERE NOT EXISTS (SELECT 1 FROM awards a WHERE a.tender = b.tender AND a.lot IS NOT DISTINCT FROM b.lot AND a.supplier_id = b.supplier_id)", doubles=('lot',))
def bids_not_won(spark, sf):
    """SP3."""
    a = roles.awards(spark, sf)
    return suppliers.not_won(a.select("tender", "lot", (F.col("part") % 100 + 1).alias("supplier_id")), roles.awards(spark, sf))
