"""The driver's tables in the roles of procurement data, in Spark and as SQL.

Nulls are made by the same rules on both sides.  ``CTES`` are the common table expressions
of the same names for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acopio.sources import store

CTES = {
    "contracts": """contracts AS (
        SELECT o_orderkey AS source_id, o_orderpriority AS body,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS publication_date,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS supplier_id,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE year(o_orderdate) END AS publication_year
        FROM orders)""",
    "suppliers": "suppliers AS (SELECT c_custkey AS supplier_id, c_name AS name, 'B' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS fiscal_id FROM customer)",
    "tenders": """tenders AS (
        SELECT o_orderkey AS tender, o_orderpriority AS body, CAST(o_orderdate AS DATE) AS publication_date, year(o_orderdate) AS publication_year,
               o_orderstatus AS state, CAST(o_orderkey % 6 AS INTEGER) AS lote_count,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS base_budget
        FROM orders WHERE o_orderkey % 23 <> 0)""",
    "awards": """awards AS (
        SELECT l_orderkey AS tender, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS lot,
               max(CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS amount,
               max(CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END) AS supplier_id,
               bool_and(l_returnflag = 'R') AS withdrawn, min(l_partkey) AS part
        FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "classes": """classes AS (
        SELECT DISTINCT l_orderkey AS tender, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS lot, p_type AS cpv,
               l_returnflag = 'A' AS withdrawn
        FROM lineitem JOIN part ON p_partkey = l_partkey)""",
    "readings": """readings AS (
        SELECT user_id AS supplier, CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_type END AS name,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS date,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id // 2 AS BIGINT) END AS source_id, event_id AS pos
        FROM events)""",
    "coverage": """coverage AS (
        SELECT event_id // 40 AS run, user_id % 9 AS body,
               CASE WHEN event_type = 'error' OR event_id // 40 % 10 = 3 THEN 'FAILED' WHEN event_id % 31 = 0 THEN 'SKIPPED' ELSE 'SUCCEEDED' END AS state,
               CASE WHEN event_type = 'error' OR event_id // 40 % 10 = 3 THEN 'reason ' || CAST(event_id % 4 AS VARCHAR) END AS reason,
               event_id % 5 AS added, event_id % 3 AS refreshed,
               CASE event_id % 3 WHEN 0 THEN 'INITIAL' WHEN 1 THEN 'RESUMED' ELSE 'INCREMENTAL' END AS mode, CASE WHEN event_id % 2 = 0 THEN 'CONTRACTS' ELSE 'TENDERS' END AS family
        FROM events)""",
    "runs": """runs AS (
        SELECT event_id // 40 AS run, CASE WHEN event_id // 40 % 2 = 0 THEN 'CONTRACTS' ELSE 'TENDERS' END AS importer,
               min(ts) AS started_at, max(ts) AS last_advanced_at, CASE WHEN event_id // 40 % 4 = 1 THEN 'IN_PROGRESS' ELSE 'SUCCEEDED' END AS state,
               CASE WHEN event_id // 40 % 3 = 0 THEN 'MANUAL' ELSE 'SCHEDULED' END AS trigger
        FROM events GROUP BY event_id // 40)""",
    "terms": """terms AS (SELECT p_partkey AS id, CASE WHEN p_partkey // 10 = 0 THEN NULL ELSE p_partkey // 10 END AS parent, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name FROM part)""",
    "stored": "stored AS (SELECT o_orderkey AS source_id, o_orderpriority AS body, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_custkey AS supplier_id FROM orders WHERE o_orderkey % 3 <> 0)",
    "incoming": "incoming AS (SELECT o_orderkey AS source_id, o_orderpriority AS body, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_totalprice + 1 AS DECIMAL(18,2)) END AS amount, o_custkey AS supplier_id FROM orders WHERE o_orderkey % 2 = 0)",
}


def with_ctes(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(CTES[n] for n in names) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_every(n: int, key: str, value):
    return F.when(F.col(key) % n != 0, value)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("body"), null_every(11, "o_orderkey", day).alias("publication_date"),
        null_every(7, "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"), null_every(13, "o_orderkey", F.col("o_custkey")).alias("supplier_id"),
        null_every(11, "o_orderkey", F.year(day)).alias("publication_year"), F.lit("object").alias("object"), F.lit("1 mes").alias("duration"),
    )


def stored_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts as an import leaves them: written once for each state of the input, by year; browsing reads that."""
    table_ = store.contracts(spark, f"{store.folder(spark)}/acopio-contracts-{store.fingerprint(spark, f'{sf_dir}/orders.parquet')}")
    if not table_.versions():
        table_.write(contracts(spark, sf_dir))
    return table_.read()


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("supplier_id"), F.col("c_name").alias("name"), F.concat(F.lit("B"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("fiscal_id"))


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").where("o_orderkey % 23 <> 0").select(
        F.col("o_orderkey").alias("tender"), F.col("o_orderpriority").alias("body"), day.alias("publication_date"), F.year(day).alias("publication_year"),
        F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 6).cast("int").alias("lote_count"), null_every(17, "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)")).alias("base_budget"),
    )


def lot():
    return F.when(F.col("l_linenumber") != 1, F.col("l_linenumber"))


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max(null_every(5, "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)"))).alias("amount"), F.max(null_every(4, "l_suppkey", F.col("l_suppkey"))).alias("supplier_id"),
        F.every(F.col("l_returnflag") == "R").alias("withdrawn"), F.min("l_partkey").alias("part"),
    )
    return rows.select(F.col("l_orderkey").alias("tender"), lot().alias("lot"), "amount", "supplier_id", "withdrawn", "part")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("cpv"))
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("tender"), lot().alias("lot"), "cpv", (F.col("l_returnflag") == "A").alias("withdrawn")).distinct()


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("supplier"), null_every(19, "event_id", F.col("event_type")).alias("name"), null_every(7, "event_id", F.to_date("ts")).alias("date"),
        null_every(5, "event_id", F.expr("event_id div 2")).alias("source_id"), F.col("event_id").alias("pos"),
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("run", F.expr("event_id div 40"))
    failed = (F.col("event_type") == "error") | (F.col("run") % 10 == 3)
    return e.select(
        "run", (F.col("user_id") % 9).alias("body"), F.when(failed, "FAILED").when(F.col("event_id") % 31 == 0, "SKIPPED").otherwise("SUCCEEDED").alias("state"),
        F.when(failed, F.concat(F.lit("reason "), (F.col("event_id") % 4).cast("string"))).alias("reason"), (F.col("event_id") % 5).alias("added"), (F.col("event_id") % 3).alias("refreshed"),
        F.when(F.col("event_id") % 3 == 0, "INITIAL").when(F.col("event_id") % 3 == 1, "RESUMED").otherwise("INCREMENTAL").alias("mode"), F.when(F.col("event_id") % 2 == 0, "CONTRACTS").otherwise("TENDERS").alias("family"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 40").alias("run")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_advanced_at"))
    return e.select("run", F.when(F.col("run") % 2 == 0, "CONTRACTS").otherwise("TENDERS").alias("importer"), "started_at", "last_advanced_at", F.when(F.col("run") % 4 == 1, "IN_PROGRESS").otherwise("SUCCEEDED").alias("state"), F.when(F.col("run") % 3 == 0, "MANUAL").otherwise("SCHEDULED").alias("trigger"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("nullif(p_partkey div 10, 0)").alias("parent"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("body"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_custkey").alias("supplier_id"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = null_every(10, "o_orderkey", (F.col("o_totalprice") + 1).cast("decimal(18,2)"))
    return table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("body"), price.alias("amount"), F.col("o_custkey").alias("supplier_id"))
