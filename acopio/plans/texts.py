"""Cleaning rules and parsers over the role map and over built cases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from acopio.functions import clean
from acopio.functions.fold import name_fold
from acopio.plans import roles
from acopio.plans.book import Book
from acopio.sources import portal

Q = Book()


@Q.query("SELECT doc_id, md5(coalesce(nullif(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g'), ''), '')) AS fold FROM documents")
def name_fold_texts(spark, sf):
    """SF9 over accented text."""
    return roles.table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce(name_fold("text"), F.lit("")).cast("binary")).alias("fold"))


@Q.query("SELECT p_partkey AS k, nullif(regexp_replace(strip_accents(lower(p_name || ' É-' || p_brand)), '[^a-z0-9]', '', 'g'), '') AS fold FROM part")
def name_fold_codegen(spark, sf):
    """SF9 over composed letters."""
    return roles.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), name_fold(F.concat("p_name", F.lit(" É-"), "p_brand")).alias("fold"))


@Q.query(r"""SELECT p_partkey AS k, nullif(trim(p_name), '') AS text, lower(p_name) || ' ' || p_brand AS collapsed, upper(p_brand || ' x') AS fiscal,
    CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'B' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') ELSE 'A-' || p_partkey END AS usable,
    CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN NULL ELSE '0' END AS lot FROM part""")
def clean_strings(spark, sf):
    """SF1-SF3 SF6 SF7 SF12."""
    wide = F.lit(" \u0085 ")
    k = F.col("p_partkey")
    ident = F.when(k % 5 == 0, "  - ").when(k % 5 == 1, "TEMP–001").when(k % 5 == 2, " ").when(k % 5 == 3, F.concat(F.lit(" b"), F.lpad(k.cast("string"), 8, "0"), wide)).otherwise(F.concat(F.lit("a-"), k.cast("string")))
    lot = F.when(k % 4 == 0, " _ ").when(k % 4 == 1, F.concat(F.lit(" 00"), k.cast("string"))).when(k % 4 == 2, "-").otherwise("000")
    return roles.table(spark, sf, "part").select(
        k.alias("k"), clean.text(F.concat(wide, F.col("p_name"), wide)).alias("text"), clean.label(F.concat(F.lower("p_name"), F.lit("\t  "), "p_brand", wide)).alias("collapsed"),
        clean.fiscal_id(F.concat(wide, F.lower("p_brand"), F.lit(" x"))).alias("fiscal"), clean.usable_fiscal_id(ident).alias("usable"), clean.lot_key(lot).alias("lot"),
    )


@Q.query("""SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'B' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS id,
    CASE WHEN c_custkey % 2 = 0 THEN 'A' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS member, 'C' || c_custkey AS code, 'some words' AS description FROM customer""")
def split_cells(spark, sf):
    """SF5 SF8 SF10 SF11."""
    k = F.col("c_custkey")
    number = F.lpad(k.cast("string"), 8, "0")
    cell = F.when(k % 3 == 0, F.concat("c_name", F.lit(" B"), number)).otherwise(F.col("c_name"))
    member = F.when(k % 2 == 0, F.concat(F.lit("A"), number, F.lit(" - "), "c_name")).otherwise(F.col("c_name"))
    coded = F.concat(F.lit(" C"), k.cast("string"), F.lit(" some \n words "))
    return roles.table(spark, sf, "customer").select(k.alias("k"), clean.contractor_name(cell).alias("name"), clean.contractor_id(cell).alias("id"), clean.member_id(member).alias("member"), clean.code_of(coded).alias("code"), clean.description_of(coded).alias("description"))


@Q.query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) + 0.5 AS DOUBLE) END AS amount,
    CASE o_orderkey % 4 WHEN 0 THEN 'INCLUSIVE' WHEN 1 THEN 'EXCLUSIVE' END AS vat, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END AS n FROM orders""", doubles=('n',))
def parse_amount(spark, sf):
    """NU1 NU2 NU3 NU4."""
    k = F.col("o_orderkey")
    whole = F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", ".")
    cell = F.concat(F.when(k % 4 == 3, F.lit("-")).otherwise(F.lit(" ")), whole, F.lit(",50"), F.when(k % 4 == 0, F.lit(" € (con IVE)")).when(k % 4 == 1, F.lit(" € sen IVE")).otherwise(F.lit("")))
    count = F.when(k % 2 == 0, F.concat(F.lit(" "), (k % 50).cast("string"))).otherwise(F.lit("-3"))
    return roles.table(spark, sf, "orders").select(k.alias("k"), clean.parse_amount(cell).cast("double").alias("amount"), clean.vat_basis(cell).alias("vat"), clean.parse_count(count).cast("long").alias("n"))


@Q.query("""SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS listed, CASE WHEN o_orderkey % 3 <> 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS recorded FROM orders""")
def strict_date(spark, sf):
    """DT1 DT2: impossible dates are null, no roll-over."""
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "dd-MM-yyyy")
    cell = F.when(k % 3 == 0, d).when(k % 3 == 1, F.concat(d, F.lit("  23:59"))).otherwise(F.lit("31-02-2024"))
    return roles.table(spark, sf, "orders").select(k.alias("k"), clean.listing_date(cell).cast("string").alias("listed"), clean.record_date(cell).cast("string").alias("recorded"))


@Q.query("SELECT event_id AS k, CAST(CAST(ts + INTERVAL 1 HOUR AS DATE) AS VARCHAR) AS day FROM events")
def madrid_dates(spark, sf):
    """DT4: January is one hour ahead of UTC."""
    return roles.table(spark, sf, "events").select(F.col("event_id").alias("k"), clean.madrid_date(F.col("ts").cast("timestamp")).cast("string").alias("day"))


@Q.query("SELECT page_id, 'https://portal.example/licitacion?N=' || page_id AS url, CASE WHEN length(html) > 500 THEN 500 ELSE length(html) END AS n FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '[^a-zA-Z<>/ ]', 'x', 'g'), ' +', ' ', 'g')) AS html FROM pages)")
def publication_links(spark, sf):
    """PRJ2 PRJ4 SF17."""
    plain = F.regexp_replace("html", "[^a-zA-Z<>/ ]", "x")
    return roles.table(spark, sf, "pages").select("page_id", clean.publication_url("https://portal.example//", F.col("page_id")).alias("url"), F.char_length(clean.failure_reason(plain)).alias("n"))


@Q.query("SELECT page_id, len(regexp_extract_all(html, '<li[^>]*>')) AS n_items FROM pages")
def parse_pages(spark, sf):
    """List items of real pages, parsed where the pages are."""
    @F.pandas_udf("long")
    def items(html: pd.Series) -> pd.Series:
        return html.map(lambda x: sum(1 for _ in portal.tree(x or "").all("li")))

    return roles.table(spark, sf, "pages").select("page_id", items("html").alias("n_items"))


@Q.query("SELECT c_custkey AS k, CAST(n AS BIGINT) AS n, c_custkey * 10 + n AS id, 'Obxecto ' || n AS objeto FROM customer, generate_series(1, 3) AS g(n) WHERE c_custkey % 7 <> 0")
def json_pages(spark, sf):
    """SRC2 SRC4 JS1 AR2: pages with a null identifier fail whole."""
    k = F.col("c_custkey")
    row = lambda n: F.struct(F.when((k % 7 != 0) | F.lit(n != 2), k * 10 + n).alias("id"), F.concat(F.lit("Obxecto "), F.lit(n).cast("string")).alias("objeto"))
    raw = roles.table(spark, sf, "customer").select(k.alias("k"), F.to_json(F.struct(F.lit(3).alias("recordsTotal"), F.array(row(1), row(2), row(3)).alias("data"))).alias("value"))
    rows = portal.entries(portal.pages(raw, portal.CONTRACT_PAGE))
    return rows.select("k", (F.col("pos") + 1).cast("long").alias("n"), "id", "objeto")
