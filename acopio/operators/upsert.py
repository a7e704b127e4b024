"""Idempotent upserts that keep identity and count what was added and refreshed.

Plain Parquet has no MERGE, so an upsert is one full join and a new table.  Keys compare
null-safely unless told otherwise: a null lot is a key value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """UPS2, WN2, WN3: the first row of each key in ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def last_wins(rows: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    return distinct_by(rows, keys, [F.desc(position)])


def first_wins(rows: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    return distinct_by(rows, keys, [F.asc(position)])


def _joined(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    s = stored.select(F.struct(*stored.columns).alias("s"))
    i = incoming.select(F.struct(*incoming.columns).alias("i"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}"))
    return s.join(i, same, how)


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], protected: Sequence[str] = (), first_spelling: Sequence[str] = (), defaults: dict[str, Column] | None = None) -> DataFrame:
    """UPS1, UPS4-UPS11: incoming rows replace stored ones whole, nulls included.

    ``protected`` columns keep their stored value (a new row takes its default), and
    ``first_spelling`` ones keep it once there is one (UPS5, UPS9).
    """
    both = _joined(stored, incoming, keys, "full")
    old, new = F.col("s").isNotNull(), F.col("i").isNotNull()
    out = []
    for c in stored.columns:
        s = F.col(f"s.{c}")
        if c in protected:
            value = F.when(old, s).otherwise((defaults or {}).get(c, F.lit(None)))
        elif c in first_spelling:
            value = F.when(new, F.coalesce(s, F.col(f"i.{c}"))).otherwise(s)
        else:
            value = F.when(new, F.col(f"i.{c}")).otherwise(s)
        out.append(value.alias(c))
    return both.select(*out)


def upsert_counts(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UPS3: rows added and refreshed, from the join itself; only keys are read."""
    both = _joined(stored.select(*keys), incoming.select(*keys), keys, "right")
    return both.agg(F.count_if(F.col("s").isNull()).alias("added"), F.count_if(F.col("s").isNotNull()).alias("refreshed"))


def reconcile_bodies(stored: DataFrame, fetched: DataFrame, key: str = "body") -> DataFrame:
    """UPS16, JN8, JN9: each body's new name and activity, and what happened to it.

    Unchanged bodies are counted nowhere; absentees become inactive; the import mark stays.
    """
    both = stored.select(key, F.col("name").alias("old"), "active", "importable").join(fetched.select(key, F.col("name").alias("new")), key, "full")
    here, known = F.col("new").isNotNull(), F.col("active").isNotNull()
    what = F.when(here & ~known, "ADDED").when(here & (~F.col("active") | ~F.col("old").eqNullSafe(F.col("new"))), "REFRESHED").when(known & ~here & F.col("active"), "DEACTIVATED")
    return both.select(key, F.coalesce("new", "old").alias("name"), here.alias("active"), F.coalesce("importable", F.lit(False)).alias("importable"), what.alias("change"))


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """UPS20: rows whose parent is not stored; must be empty."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


def vocabulary(stored: DataFrame, incoming: DataFrame, key: str, labels: str = "last") -> DataFrame:
    """UPS9: a vocabulary grows by what is new; ``labels``: last overwrites, first never does."""
    if labels == "last":
        return upsert(stored, last_wins(incoming, [key]).select(*stored.columns), [key])
    new = first_wins(incoming, [key]).select(*stored.columns).join(stored.select(key), key, "left_anti")
    return stored.unionByName(new)


def ledger(stored: DataFrame, failed: DataFrame, cleared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UPS12: outstanding records after some failed again and some were cleared."""
    return upsert(stored, failed, keys).join(cleared.select(*keys), list(keys), "left_anti")


def outstanding_by(records: DataFrame, bodies: DataFrame) -> DataFrame:
    """UPS12, AG3: bodies with how many records are outstanding, and whether any is."""
    n = records.groupBy("body").agg(F.count("*").alias("outstanding"))
    return bodies.join(n, "body", "left").select("body", F.coalesce("outstanding", F.lit(0)).alias("outstanding"), F.col("outstanding").isNotNull().alias("has_outstanding"))


def withdraw_absent(stored: DataFrame, reread: DataFrame, parent: str, keys: Sequence[str]) -> DataFrame:
    """SP8: children of re-read parents that are not in the record any more become withdrawn; those
    of other parents stay; a removal by an administrator is sticky."""
    read_again = reread.select(F.col(parent).alias("_p")).distinct()
    both = _joined(stored, reread.select(parent, *keys).distinct(), [parent, *keys], "left")
    known = both.join(read_again, F.col("s")[parent].eqNullSafe(F.col("_p")), "left")
    gone = F.when(F.col("_p").isNull(), F.col("s.withdrawn")).otherwise(F.col("i").isNull() | F.col("s.removed"))
    return known.select(*[F.col(f"s.{c}") if c != "withdrawn" else gone.alias("withdrawn") for c in stored.columns])
