"""Runs, metrics, windows and hierarchies over the role map."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from acopio.operators import hierarchy, runs
from acopio.plans import roles
from acopio.plans.book import Book
from acopio.plans.roles import with_ctes

Q = Book()


@Q.query(with_ctes("coverage") + "SELECT run, CAST(sum(added) AS BIGINT) AS added, CAST(sum(refreshed) AS BIGINT) AS refreshed, CASE WHEN count(*) FILTER (WHERE state = 'FAILED') = 0 THEN 'SUCCEEDED' WHEN count(*) FILTER (WHERE state = 'FAILED') = count(*) THEN 'FAILED' ELSE 'PARTIALLY_SUCCEEDED' END AS state FROM coverage GROUP BY run")
def run_verdict(spark, sf):
    """AG7 AG8 UPS19."""
    return runs.verdict(roles.coverage(spark, sf))


@Q.query(with_ctes("coverage") + "SELECT run, body, bool_and(state = 'SUCCEEDED') AS complete FROM coverage GROUP BY run, body")
def bodies_completed(spark, sf):
    """AG9."""
    return runs.bodies_completed(roles.coverage(spark, sf))


@Q.query(with_ctes("coverage") + "SELECT body, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM coverage WHERE state = 'FAILED' GROUP BY body")
def failure_lines(spark, sf):
    """AG10."""
    return runs.failure_lines(roles.coverage(spark, sf))


NOW = datetime(2024, 1, 20)


@Q.query(with_ctes("runs") + "SELECT run, CASE WHEN state = 'IN_PROGRESS' AND last_advanced_at < TIMESTAMP '2024-01-19 23:45:00' THEN 'ABANDONED' ELSE state END AS state FROM runs")
def abandoned_runs(spark, sf):
    """DT8 ST8."""
    return roles.runs(spark, sf).select("run", runs.read_state(F.lit(NOW).cast("timestamp_ntz")).alias("state"))


@Q.query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(DISTINCT event_id // 40) AS n FROM events WHERE event_id // 40 % 4 = 1")
def last_advanced(spark, sf):
    """AG4."""
    return runs.last_advanced(roles.runs(spark, sf)).select(F.date_format("last_advanced_at", "yyyy-MM-dd HH:mm:ss").alias("last"), "n")


@Q.query("""SELECT k, CAST(greatest(floor, DATE '2024-06-30' - CAST((i + 1) * 89 AS INTEGER)) AS VARCHAR) AS "from", CAST(DATE '2024-06-30' - CAST(i * 89 AS INTEGER) AS VARCHAR) AS "to"
    FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) + 8000 AS floor FROM orders WHERE CAST(o_orderdate AS DATE) + 8000 < DATE '2024-06-30'), generate_series(0, 60) AS g(i)
    WHERE i < greatest(ceil((DATE '2024-06-30' - floor) / 89.0), 1)""")
def import_windows(spark, sf):
    """DT7 DT6 AR1: neighbours share a boundary, the last is clamped to the floor."""
    today = F.lit(date(2024, 6, 30))
    o = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.date_add(F.to_date("o_orderdate"), 8000).alias("floor")).where(F.col("floor") < today)
    return o.select("k", F.explode(runs.windows(F.col("floor"), today)).alias("w")).select("k", F.col("w.from").cast("string").alias("from"), F.col("w.to").cast("string").alias("to"))


@Q.query("SELECT o_orderkey AS k, CAST(least(CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS DATE) - 30, DATE '1998-01-01') AS VARCHAR) AS a, CAST(least(CAST(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END, o_orderdate - INTERVAL 5 DAY) AS DATE) - 30, DATE '1998-01-01') AS VARCHAR) AS floor FROM orders".replace("CAST(least(CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS DATE) - 30, DATE '1998-01-01') AS VARCHAR) AS a, ", ""))
def refresh_floors(spark, sf):
    """DT6 DT5."""
    o = roles.table(spark, sf, "orders")
    covered = F.col("o_orderdate") - F.expr("interval 5 days")
    return o.select(F.col("o_orderkey").alias("k"), runs.refresh_floor(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")), covered, F.lit(date(1998, 1, 1))).cast("string").alias("floor"))


@Q.query("SELECT o_orderkey AS k, row_number() OVER (ORDER BY CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END, o_orderkey) AS nth FROM orders")
def sweep_order(spark, sf):
    """SO7."""
    modes = F.element_at(F.array(*map(F.lit, ("VANISHED", "INCREMENTAL", "RESUMED", "INITIAL", "?"))), (F.col("k") % 5 + 1).cast("int"))
    o = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).withColumn("mode", modes).withColumn("pos", F.col("k"))
    return runs.sweep_ranks(o, F.col("mode")).select("k", "nth")


@Q.query(with_ctes("runs", "coverage") + "SELECT run FROM runs WHERE importer = 'TENDERS' AND run IN (SELECT run FROM coverage WHERE body = 4) AND started_at >= TIMESTAMP '2024-01-10' ORDER BY started_at DESC, run DESC")
def run_list(spark, sf):
    """FIL14 FIL9 FIL10 SO12."""
    return runs.run_list(roles.runs(spark, sf), roles.coverage(spark, sf), importer="TENDERS", body=4, since=datetime(2024, 1, 10)).select("run")


@Q.query(with_ctes("runs", "coverage") + """SELECT run FROM runs WHERE run IN (SELECT run FROM runs ORDER BY started_at DESC, run DESC LIMIT 20)
    OR run IN (SELECT run FROM (SELECT c.body, r.importer, r.run FROM coverage c JOIN runs r USING (run) WHERE c.state = 'SUCCEEDED'
        QUALIFY row_number() OVER (PARTITION BY c.body, r.importer ORDER BY r.started_at DESC, r.run DESC) = 1))""")
def run_retention(spark, sf):
    """SP9."""
    return runs.retained(roles.runs(spark, sf), roles.coverage(spark, sf), 20).select("run")


@Q.query("SELECT event_type, max(value) AS peak, CASE WHEN count(*) > 1 THEN max(CASE WHEN n = 1 THEN value END) - max(CASE WHEN n = 2 THEN value END) END AS delta FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def metrics_peak_delta(spark, sf):
    """AG18 WN5."""
    e = roles.table(spark, sf, "events").select("ts", F.col("event_id").alias("id"), "event_type", "value")
    return runs.peak_and_delta(e, ["event_type"])


@Q.query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*), 9) AS rate, CASE WHEN count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*) < 0.01 THEN 'normal' WHEN count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*) < 0.05 THEN 'elevated' ELSE 'high' END AS severity FROM events GROUP BY CAST(ts AS DATE)")
def error_rate(spark, sf):
    """AG19 ST2."""
    e = roles.table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    rate = runs.error_rate(F.col("errors"), F.col("requests"))
    return e.select("day", "requests", "errors", F.round(rate, 9).alias("rate"), runs.severity(rate).alias("severity"))


@Q.query("SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 250")
def last_250(spark, sf):
    """WN4."""
    return runs.last_samples(roles.table(spark, sf, "events").select("ts", F.col("event_id").alias("id"))).select("id")


@Q.query("SELECT event_type, CAST(sum(greatest(CAST(event_id % 7 - 3 AS BIGINT), 0)) AS BIGINT) AS total FROM events GROUP BY event_type")
def clamped_sum(spark, sf):
    """AG20."""
    return roles.table(spark, sf, "events").groupBy("event_type").agg(runs.collected(F.col("event_id") % 7 - 3).alias("total"))


_TREE = with_ctes("terms", recursive=True)


@Q.query(_TREE + ", p AS (SELECT id, name AS path, 0 AS depth FROM terms WHERE parent IS NULL UNION ALL SELECT t.id, p.path || ' › ' || t.name, p.depth + 1 FROM terms t JOIN p ON t.parent = p.id) SELECT * FROM p")
def term_paths(spark, sf):
    """HI1 HI2 HI3."""
    return hierarchy.paths(roles.terms(spark, sf))


@Q.query(_TREE + ", t2 AS (SELECT id, CASE WHEN id = 3 THEN 345 WHEN id = 5 THEN 5 ELSE parent END AS parent FROM terms), c AS (SELECT id, parent AS a, 1 AS up FROM t2 UNION ALL SELECT c.id, t2.parent, up + 1 FROM c JOIN t2 ON t2.id = c.a WHERE up < 20) SELECT DISTINCT id FROM c WHERE id = a")
def cycle_check(spark, sf):
    """HI1: loops that are stored already."""
    looped = F.when(F.col("id") == 3, F.lit(345)).when(F.col("id") == 5, F.lit(5)).otherwise(F.col("parent"))
    return hierarchy.on_cycle(roles.terms(spark, sf).withColumn("parent", looped))


@Q.query(_TREE + ", k AS (SELECT id, parent FROM terms WHERE id % 97 = 0 UNION SELECT t.id, t.parent FROM terms t JOIN k ON t.id = k.parent) SELECT id FROM k")
def prune_tree(spark, sf):
    """HI4."""
    t = roles.terms(spark, sf)
    return hierarchy.prune(t, t.where("id % 97 = 0").select(F.col("id").alias("term"))).select("id")


@Q.query(_TREE + ", u AS (SELECT id, parent FROM terms WHERE id IN (12, 77) UNION SELECT t.id, t.parent FROM terms t JOIN u ON t.id = u.parent), d AS (SELECT id FROM terms WHERE id IN (12, 77) UNION SELECT t.id FROM terms t JOIN d ON t.parent = d.id) SELECT id FROM u UNION SELECT id FROM d")
def tree_search(spark, sf):
    """HI5."""
    return hierarchy.search(roles.terms(spark, sf), F.col("id").isin(12, 77)).select("id")


@Q.query(with_ctes("terms") + "SELECT c_custkey AS body, coalesce(name, 'unclassified') AS term_name FROM customer LEFT JOIN terms ON id = CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey * 3 END")
def placed_bodies(spark, sf):
    """JN16 UPS18."""
    c = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("body"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") * 3).alias("term"))
    return hierarchy.placed(c, roles.terms(spark, sf)).select("body", "term_name")


@Q.query("SELECT CASE WHEN p_partkey // 10 = 0 THEN NULL ELSE p_partkey // 10 END AS parent, lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1", doubles=('parent',))
def sibling_clashes(spark, sf):
    """HI6 SF16 FIL7."""
    t = roles.table(spark, sf, "part").select(F.expr("nullif(p_partkey div 10, 0)").alias("parent"), F.col("p_name").alias("name"))
    return hierarchy.sibling_clashes(t)


@Q.query("SELECT event_type, count(*) AS n, CAST(sum(CAST(greatest(value, 0) AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY event_type")
def stream_metrics(spark, sf):
    """ST1 ST2: the stream is drained once; counters by kind."""
    import uuid

    from acopio.streaming import metrics

    name = f"metrics_{uuid.uuid4().hex}"
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        import tempfile

        where = tempfile.mkdtemp(prefix="acopio-stream-")
    samples = metrics.read_samples(spark, sf, names="events.parquet")
    metrics.run_once(metrics.counters(samples), name, f"{where}/{name}")
    return spark.table(name).withColumn("total", F.col("total").cast("double"))


@Q.query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) AS peak FROM events GROUP BY 1")
def metrics_by_hour(spark, sf):
    """ST1: the stream's windowed rates, here over the stored samples."""
    from acopio.streaming import metrics

    rows = metrics.rates(roles.table(spark, sf, "events"))
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
