"""The supplier catalogue: displayed and retained names, unique matches, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def displayed_name(readings: DataFrame) -> DataFrame:
    """RES1-RES4, WN1: readings (supplier, name, date, source_id, pos) to one name a supplier.

    Candidates are ranked rows (a source_id is known) with a name, and the first row to
    arrive, whose null name shows as empty.  The highest (date, source_id) wins, null dates
    lowest; an equal rank never displaces an earlier row.  One aggregation, no sort.
    """
    low = F.lit(-(2**63)).cast("long")
    first = readings.groupBy("supplier").agg(F.min_by(F.struct("name", "date", "source_id", "pos"), "pos").alias("r"))
    opening = first.select("supplier", F.coalesce("r.name", F.lit("")).alias("name"), "r.date", F.coalesce("r.source_id", low).alias("source_id"), "r.pos")
    ranked = readings.where(F.col("source_id").isNotNull() & F.col("name").isNotNull()).select("supplier", "name", "date", "source_id", "pos")
    all_rows = ranked.unionByName(opening)
    rank = F.struct(F.col("date"), F.col("source_id"), (-F.col("pos")).alias("first"))
    top = all_rows.groupBy("supplier").agg(F.max_by(F.struct("name", "date", "source_id"), rank).alias("t"))
    return top.select("supplier", F.col("t.name").alias("name"), F.col("t.date").alias("rank_date"), F.col("t.source_id").alias("rank_id"))


def retained_names(readings: DataFrame) -> DataFrame:
    """RES4, UPS13, JN7: the other ranked names of a supplier, exactly as spelled, with their
    highest rank."""
    ranked = readings.where(F.col("source_id").isNotNull() & F.col("name").isNotNull())
    best = ranked.groupBy("supplier", "name").agg(F.max(F.struct("date", "source_id")).alias("r"))
    shown = displayed_name(readings).select("supplier", "name")
    return best.join(shown, ["supplier", "name"], "left_anti").select("supplier", "name", F.col("r.date").alias("last_date"), F.col("r.source_id").alias("last_id"))


def unique_match(names: DataFrame, key: str = "fold", ident: str = "supplier") -> DataFrame:
    """AG11, SET1: keys that name exactly one supplier, displayed or retained names alike."""
    return names.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(ident).alias("n"), F.min(ident).alias(ident)).where("n = 1").drop("n")


def sections(contracts: DataFrame, awards: DataFrame) -> DataFrame:
    """AG15: per supplier and section: how many, their total, and how many had no amount."""
    one = lambda df, name: df.groupBy("supplier_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.count_if(F.col("amount").isNull()).alias("unsummed")).withColumn("section", F.lit(name))
    return one(contracts, "contracts").unionByName(one(awards, "awards"))


def combined(parts: DataFrame) -> DataFrame:
    """AG16: figures over all sections, each under its own filter."""
    return parts.groupBy("supplier_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("unsummed").alias("unsummed"))


def reachable(suppliers: DataFrame, *shown: DataFrame) -> DataFrame:
    """SP1: suppliers that something visible leads to."""
    ids = shown[0]
    for x in shown[1:]:
        ids = ids.union(x)
    return suppliers.join(ids.toDF("supplier_id").distinct(), "supplier_id", "left_semi")


def not_won(bids: DataFrame, awards: DataFrame) -> DataFrame:
    """SP3: a supplier's bids on lots that it was not awarded."""
    same = bids["tender"].eqNullSafe(awards["tender"]) & bids["lot"].eqNullSafe(awards["lot"]) & (bids["supplier_id"] == awards["supplier_id"])
    return bids.join(awards, same, "left_anti")


def list_order(name: Column) -> list[Column]:
    """SO11: without case or accents, then fiscal id, then own id."""
    return [F.collate(name, "UNICODE_CI_AI").asc(), F.col("fiscal_id").asc_nulls_last(), F.col("supplier_id").asc()]


def mark_consortia(catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """RES5, UPS15: catalogue (fiscal_id, name, ute) with the consortia found (fiscal_id, name): a new one is
    inserted marked, one that is known is marked; marking again changes nothing and a name stays."""
    new = found.where(F.col("fiscal_id").isNotNull()).groupBy("fiscal_id").agg(F.min("name").alias("new_name"))
    both = catalogue.join(new.withColumn("found", F.lit(True)), "fiscal_id", "full")
    return both.select("fiscal_id", F.when(F.col("ute").isNotNull(), F.col("name")).otherwise(F.coalesce("new_name", F.lit(""))).alias("name"), (F.coalesce("ute", F.lit(False)) | F.coalesce("found", F.lit(False))).alias("ute"))


def promote_names(catalogue: DataFrame, retained: DataFrame, best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """UPS14, RES2: catalogue (supplier, name, rank_date, rank_id) and retained names (supplier, name, last_date,
    last_id) after each supplier's best new reading (supplier, name, date, source_id).

    A reading that outranks the shown name takes its place: its retained copy goes, and the name it
    displaces is retained with its rank.  One that doesn't is retained, unless it is the shown name.
    """
    new = best.select("supplier", F.col("name").alias("new"), F.struct("date", "source_id").alias("r"))
    x = catalogue.join(new, "supplier", "left")
    up = F.col("r").isNotNull() & (F.col("r") > F.struct(F.col("rank_date").alias("date"), F.col("rank_id").alias("source_id")))
    x = x.withColumn("up", F.coalesce(up, F.lit(False)))
    shown = x.select("supplier", F.when(F.col("up"), F.col("new")).otherwise(F.col("name")).alias("name"), F.when(F.col("up"), F.col("r.date")).otherwise(F.col("rank_date")).alias("rank_date"), F.when(F.col("up"), F.col("r.source_id")).otherwise(F.col("rank_id")).alias("rank_id"))
    displaced = x.where(F.col("up") & (F.col("name") != F.col("new"))).select("supplier", "name", F.col("rank_date").alias("last_date"), F.col("rank_id").alias("last_id"))
    lower = x.where(~F.col("up") & F.col("r").isNotNull() & (F.col("new") != F.col("name"))).select("supplier", F.col("new").alias("name"), F.col("r.date").alias("last_date"), F.col("r.source_id").alias("last_id"))
    kept = retained.unionByName(displaced).unionByName(lower).groupBy("supplier", "name").agg(F.max(F.struct("last_date", "last_id")).alias("k"))
    kept = kept.join(shown.select("supplier", "name"), ["supplier", "name"], "left_anti")
    return shown, kept.select("supplier", "name", F.col("k.last_date").alias("last_date"), F.col("k.last_id").alias("last_id"))


def identified_names(retained: DataFrame, catalogue: DataFrame) -> DataFrame:
    """JN5: retained names of suppliers that have an identifier."""
    return retained.join(catalogue.where(F.col("fiscal_id").isNotNull()).select("supplier", "fiscal_id"), "supplier")


def with_names(catalogue: DataFrame, retained: DataFrame) -> DataFrame:
    """JN4: suppliers with their other names, in order; none is an empty list."""
    names = retained.groupBy("supplier").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return catalogue.join(names, "supplier", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def history(entries: DataFrame, supplier, order: list[Column], number: int, size: int, year: int | None = None) -> DataFrame:
    """SP2: a page of a supplier's entries in a section, of one year if asked."""
    from acopio.operators.browse import page

    mine = entries.where(F.col("supplier_id") == supplier)
    return page(mine if year is None else mine.where(F.col("publication_year") == year), order, number, size)
