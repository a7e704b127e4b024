"""Import runs: verdicts, abandonment, windows, order, retention; and runtime metrics."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict(coverage: DataFrame) -> DataFrame:
    """AG7, AG8: a run's counters and verdict; stopped and skipped bodies are no failures."""
    failed, n = F.count_if(F.col("state") == "FAILED"), F.count("*")
    state = F.when(failed == 0, "SUCCEEDED").when(failed == n, "FAILED").otherwise("PARTIALLY_SUCCEEDED")
    return coverage.groupBy("run").agg(F.sum("added").alias("added"), F.sum("refreshed").alias("refreshed"), state.alias("state"))


def with_verdict(runs: DataFrame, coverage: DataFrame) -> DataFrame:
    """AG8: a run that covered nothing succeeded."""
    return runs.join(verdict(coverage), "run", "left").withColumn("state", F.coalesce("state", F.lit("SUCCEEDED")))


def bodies_completed(coverage: DataFrame) -> DataFrame:
    """AG9: bodies of which every row succeeded."""
    return coverage.groupBy("run", "body").agg(F.every(F.col("state") == "SUCCEEDED").alias("complete"))


def failure_lines(coverage: DataFrame) -> DataFrame:
    """AG10: a body's distinct reasons, joined in order."""
    return coverage.where("state = 'FAILED'").groupBy("body").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))


def read_state(now: Column, minutes: int = 15) -> Column:
    """DT8, ST8: runs that have not advanced for a while read as abandoned; nothing is stored."""
    old = F.col("last_advanced_at") < now - F.make_interval(mins=F.lit(minutes))
    return F.when((F.col("state") == "IN_PROGRESS") & old, "ABANDONED").otherwise(F.col("state"))


def refresh_floor(refreshed: Column, covered: Column, today: Column, days: int = 30) -> Column:
    """DT6: where an incremental refresh starts."""
    return F.least(F.date_sub(F.to_date(F.coalesce(refreshed, covered)), days), today)


def windows(floor: Column, today: Column, step: int = 89) -> Column:
    """DT7: (from, to) going back by ``step`` days, neighbours sharing their boundary, the last
    one clamped to the floor."""
    n = F.greatest(F.ceil(F.datediff(today, floor) / step), F.lit(1)).cast("int")
    one = lambda k: F.struct(F.greatest(F.date_sub(today, ((k + 1) * step).cast("int")), floor).alias("from"), F.date_sub(today, (k * step).cast("int")).alias("to"))
    return F.transform(F.sequence(F.lit(0), n - 1), one)


def sweep_rank(mode: Column) -> Column:
    return F.when(mode == "VANISHED", 0).when(mode == "INCREMENTAL", 1).when(mode == "RESUMED", 2).when(mode == "INITIAL", 3).otherwise(4)


def sweep_order(mode: Column) -> list[Column]:
    """SO7: vanished, incremental, resumed, initial, unreadable; stable by position."""
    return [sweep_rank(mode).asc(), F.col("pos").asc()]


def sweep_ranks(bodies: DataFrame, mode: Column, width: int = 1 << 16) -> DataFrame:
    """SO7: bodies with ``nth``, their place from 1 in the sweep over all of them.

    Rows are counted by mode and range of ``width`` positions, and numbered within a range:
    only the counts, a row a range, meet in one task.
    """
    first, pos = sweep_order(mode)
    x = bodies.withColumns({"acopio_mode": sweep_rank(mode), "acopio_range": F.floor(F.col("pos") / width)})
    by = ["acopio_mode", "acopio_range"]
    ranges = x.groupBy(*by).agg(F.count("*").alias("acopio_n"))
    before = F.sum("acopio_n").over(Window.orderBy(*by)) - F.col("acopio_n")
    x = x.withColumn("acopio_nth", F.row_number().over(Window.partitionBy(*by).orderBy(first, pos)))
    x = x.join(ranges.select(*by, before.alias("acopio_before")), by)
    return x.withColumn("nth", F.col("acopio_nth") + F.col("acopio_before")).drop(*by, "acopio_nth", "acopio_before")


def run_list(runs: DataFrame, coverage: DataFrame, importer: str | None = None, body=None, state: str | None = None, since: datetime | date | None = None, until: datetime | date | None = None, trigger: str | None = None, mode: str | None = None) -> DataFrame:
    """FIL14, SO12: runs, newest first; a body or a mode matches if any covered row does, each on its own."""
    x = runs
    for column, value in (("importer", importer), ("state", state), ("trigger", trigger)):
        if value is not None:
            x = x.where(F.col(column) == value)
    if since is not None:
        x = x.where(F.col("started_at") >= F.lit(since))
    if until is not None:
        x = x.where(F.col("started_at") < F.lit(until))
    for column, value in (("body", body), ("mode", mode)):
        if value is not None:
            x = x.join(coverage.where(F.col(column) == value).select("run"), "run", "left_semi")
    return x.orderBy(F.desc("started_at"), F.desc("run"))


def enumerated(runs: DataFrame) -> DataFrame:
    """UPS19, AR1: a run's two parallel arrays (bodies, families) as coverage rows, pending, with zero counters."""
    pairs = runs.select("run", F.explode(F.arrays_zip("bodies", "families")).alias("x"))
    return pairs.select("run", F.col("x.bodies").alias("body"), F.col("x.families").alias("family"), F.lit("PENDING").alias("state"), F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("refreshed"))


def settled(coverage: DataFrame, log: DataFrame) -> DataFrame:
    """UPS19, AG7: coverage after a log (run, body, family, added, refreshed, state) of what happened: counters add
    up, and a state is taken only by a row that is not settled yet, the first that settles it by ``pos``."""
    key = ["run", "body", "family"]
    ends = F.min(F.when(F.col("state").isin("SUCCEEDED", "FAILED", "SKIPPED", "STOPPED"), F.struct("pos", "state")))
    told = log.groupBy(*key).agg(F.sum("added").alias("more"), F.sum("refreshed").alias("again"), ends.alias("end"))
    open_ = F.col("state").isin("PENDING", "IN_PROGRESS")
    x = coverage.join(told, key, "left")
    return x.select(*key, F.when(open_ & F.col("end").isNotNull(), F.col("end.state")).otherwise(F.col("state")).alias("state"), (F.col("added") + F.coalesce("more", F.lit(0))).alias("added"), (F.col("refreshed") + F.coalesce("again", F.lit(0))).alias("refreshed"))


def unsettled(coverage: DataFrame, states: tuple[str, ...] = ("PENDING", "IN_PROGRESS"), family: str | None = None) -> DataFrame:
    """FIL9, FIL10: coverage rows in one of the states, of one family if asked."""
    x = coverage.where(F.col("state").isin(*states))
    return x if family is None else x.where(F.col("family") == family)


def coverage_pairs(coverage: DataFrame) -> DataFrame:
    """SET5, SO8: a run's (body, family) pairs, each once, in order of body, then family."""
    return coverage.select("run", "body", "family").dropDuplicates().orderBy("run", "body", "family")


def last_advanced(runs: DataFrame) -> DataFrame:
    """AG4: when one of the running imports advanced last."""
    return runs.where("state = 'IN_PROGRESS'").agg(F.max("last_advanced_at").alias("last_advanced_at"), F.count("*").alias("n"))


def held(runs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """ST8: whether a live run holds the guard: in progress and advanced within the bound."""
    return runs.agg(F.coalesce(F.bool_or(read_state(now, minutes) == "IN_PROGRESS"), F.lit(False)).alias("held"))


def next_trigger(now: Column, hour: int, zone: str = "Europe/Madrid") -> Column:
    """ST9: the next ``hour`` o'clock in the zone after a UTC instant, as a UTC instant."""
    local = F.from_utc_timestamp(now, zone)
    today = F.date_trunc("day", local) + F.make_interval(hours=F.lit(hour))
    day = F.when(local < today, today).otherwise(F.date_trunc("day", local) + F.make_interval(days=F.lit(1), hours=F.lit(hour)))
    return F.to_utc_timestamp(day, zone)


def non_negative(c: Column, name: str) -> Column:
    """NU5: the value; negative is an error."""
    return F.when(c < 0, F.raise_error(F.lit(f"{name} is negative"))).otherwise(c)


def retained(runs: DataFrame, coverage: DataFrame, keep: int) -> DataFrame:
    """SP9: the newest ``keep`` runs, and the last one in which each body succeeded, by importer.

    The newest are a top-k, the last successes an aggregation: no window over all runs.
    """
    newest = runs.orderBy(F.desc("started_at"), F.desc("run")).limit(keep).select("run")
    good = coverage.where("state = 'SUCCEEDED'").select("run", "body").join(runs, "run")
    last = good.groupBy("body", "importer").agg(F.max_by("run", F.struct("started_at", "run")).alias("run")).select("run")
    return runs.join(newest.union(last).distinct(), "run", "left_semi")


def peak_and_delta(samples: DataFrame, by: list[str]) -> DataFrame:
    """AG18, WN5: highest value, and last minus the one before; null with fewer than two."""
    at = F.array_sort(F.collect_list(F.struct("ts", "id", "value")))
    known = samples.where(F.col("value").isNotNull())
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id"))
    two = known.withColumn("nth", F.row_number().over(w))
    last = two.where("nth <= 2").groupBy(*by).agg(at.alias("two"))
    top = known.groupBy(*by).agg(F.max("value").alias("peak"))
    return top.join(last, by).select(*by, "peak", F.when(F.size("two") == 2, F.col("two")[1]["value"] - F.col("two")[0]["value"]).alias("delta"))


def error_rate(errors: Column, requests: Column) -> Column:
    """AG19: null without requests."""
    return F.try_divide(errors.cast("double"), requests.cast("double"))


def severity(rate: Column) -> Column:
    return F.when(rate < 0.01, "normal").when(rate < 0.05, "elevated").when(rate.isNotNull(), "high")


def last_samples(samples: DataFrame, most: int = 250) -> DataFrame:
    """WN4: the newest samples, as a top-k."""
    return samples.orderBy(F.desc("ts"), F.desc("id")).limit(most)


def collected(values: Column) -> Column:
    """AG20: a sum in which negative values count nothing."""
    return F.sum(F.greatest(values, F.lit(0)))
