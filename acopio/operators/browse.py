"""Reads of a body's contracts: visibility, orders, pages, counts and facets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTABLE = ("publication_date", "amount")


def visible(year: int | None = None, body: str | None = None) -> Column:
    """FIL1, FIL2: date, amount and supplier are known; with a year and body, theirs only."""
    c = F.col("amount").isNotNull() & F.col("supplier_id").isNotNull()
    c &= F.col("publication_date").isNotNull() if year is None else F.col("publication_year") == year
    return c if body is None else c & (F.col("body") == body)


def visible_tender(body: str, year: int) -> Column:
    """FIL4: a body's tenders of a year that are not withdrawn; no other value is needed."""
    return (F.col("body") == body) & (F.col("publication_year") == year) & ~F.col("withdrawn")


def eligible() -> Column:
    """FIL6: bodies to import."""
    return F.col("active") & F.col("importable")


@dataclass(frozen=True)
class Sort:
    """SO1, SO2: one of the allowed columns, with source_id in the same direction."""

    column: str = "publication_date"
    descending: bool = True

    def __post_init__(self):
        if self.column not in SORTABLE:
            raise ValueError(f"cannot sort by {self.column!r}")

    def columns(self, tie: str = "source_id", nulls_last: bool | None = None) -> list[Column]:
        k, t = F.col(self.column), F.col(tie)
        if nulls_last:  # SO10
            return [k.desc_nulls_last(), t.desc()] if self.descending else [k.asc_nulls_last(), t.asc()]
        return [k.desc_nulls_first(), t.desc()] if self.descending else [k.asc_nulls_last(), t.asc()]


def parse_sort(text: str | None) -> Sort:
    """SO5: ``property,direction`` with one comma; publicationDate,desc when absent."""
    if text is None:
        return Sort()
    parts = text.split(",")
    names = {"publicationDate": "publication_date", "amount": "amount"}
    if len(parts) != 2 or parts[0] not in names or parts[1] not in ("asc", "desc"):
        raise ValueError(f"not a sort: {' '.join(text.split())[:40]!r}")
    return Sort(names[parts[0]], parts[1] == "desc")


def parse_year(text: str | None) -> int:
    """FIL11: mandatory, 1000 to 9999."""
    if text is None or not re.fullmatch(r"[1-9]\d{3}", text):
        raise ValueError("a year from 1000 to 9999 is needed")
    return int(text)


def parse_paging(page: str | None = None, size: str | None = None) -> tuple[int, int]:
    """SO4: 1-based page, 50 rows unless told otherwise, 100 at most."""

    def whole(x: str | None, default: int) -> int:
        if x is None:
            return default
        if not re.fullmatch(r"-?\d{1,10}", x) or not -(2**31) <= int(x) < 2**31:
            raise ValueError("not an integer")
        return int(x)

    p, n = whole(page, 1), whole(size, 50)
    if p < 1 or not 1 <= n <= 100:
        raise ValueError("page or size out of range")
    return p, n


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """SO3: one page (1-based); one past the end is empty.  A top-k, no full sort."""
    if not order or size < 1 or number < 1:
        raise ValueError("a page needs an order, a number and a size")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def contract_page(contracts: DataFrame, suppliers: DataFrame, body: str, year: int, sort: Sort, number: int, size: int) -> DataFrame:
    """FIL1, SO1, SO3, JN1, PRJ1: the page is cut first, then its rows meet their suppliers.

    Each visible row has exactly one supplier, so cutting first gives the same page and joins
    at most ``size`` rows.
    """
    return with_awardees(page(contracts.where(visible(year, body)), sort.columns(), number, size), suppliers, sort)


def with_awardees(cut: DataFrame, suppliers: DataFrame, sort: Sort) -> DataFrame:
    """JN1, PRJ1: a page of at most 100 rows with its suppliers' names, in the page's order."""
    names = suppliers.select("supplier_id", F.col("name").alias("awardee_name"), F.col("fiscal_id").alias("awardee_fiscal_id"))
    # a join keeps no order: at most a page of rows is put in order again, in one task and without sampling
    return F.broadcast(cut).join(names, "supplier_id").repartition(1).sortWithinPartitions(*sort.columns()).select("source_id", "publication_date", "object", "amount", "duration", "awardee_name", "awardee_fiscal_id")


def envelope(rows: DataFrame, number: int, size: int) -> DataFrame:
    """PRJ3, AG1: one row of totals, whatever the page."""
    n = F.count("*")
    return rows.agg(F.lit(number).alias("page"), F.lit(size).alias("size"), n.alias("total_items"), F.ceil(n / size).cast("long").alias("total_pages"))


def years(contracts: DataFrame, body: str) -> DataFrame:
    """SET3: years with something visible, newest first."""
    known = F.col("publication_year").isNotNull()  # prunes the folder of undated rows
    # a few years: one task puts them in order
    return contracts.where(visible(body=body) & known).select("publication_year").distinct().repartition(1).sortWithinPartitions(F.desc("publication_year"))


def bodies_with_visible(bodies: DataFrame, *families: DataFrame) -> DataFrame:
    """JN2, JN3, SET2: bodies with something visible in any family; in catalogue order, if they have names."""
    ids = families[0]
    for x in families[1:]:
        ids = ids.union(x)
    found = bodies.join(ids.toDF("body").distinct(), "body", "left_semi")
    return found.orderBy(*catalogue_order(F.col("name"))) if "name" in bodies.columns else found


def catalogue_order(name: Column, key: str = "body") -> list[Column]:
    """SO6: by name without case or accents, then by key."""
    return [F.collate(name, "UNICODE_CI_AI").asc(), F.col(key).asc()]


def visible_among(contracts: DataFrame, candidates: list) -> DataFrame:
    """JN2, SET6: which of a few bodies have something visible; nothing is read when there are none."""
    if not candidates:
        return contracts.sparkSession.createDataFrame([], contracts.select("body").schema)
    return by_keys(contracts.where(visible()), "body", candidates).select("body").distinct()


def by_keys(rows: DataFrame, key: str, keys: list, most: int = 1_000) -> DataFrame:
    """SRC8: the rows of a few keys: a filter that reaches the scan, or beyond ``most`` keys a join."""
    if len(keys) <= most:
        return rows.where(F.col(key).isin(list(keys)))
    wanted = rows.sparkSession.createDataFrame([(k,) for k in keys], rows.select(key).schema).distinct()
    return rows.join(wanted, key, "left_semi")


def page_after(rows: DataFrame, sort: Sort, last: tuple | None, size: int, tie: str = "source_id") -> DataFrame:
    """SO3 for deep pages: the page after the row with (value, tie) ``last``, a top-k however far in.  The
    sorted column has no nulls, as in the visible selection."""
    if size < 1:
        raise ValueError("a page needs a size")
    if last is not None:
        k, t, (value, key) = F.col(sort.column), F.col(tie), last
        rows = rows.where((k < value) | ((k == value) & (t < key)) if sort.descending else (k > value) | ((k == value) & (t > key)))
    return rows.orderBy(*sort.columns(tie)).limit(size)


def updated(rows: DataFrame, key: str, value, changes: dict[str, Column]) -> DataFrame:
    """UPS17: one row's columns changed, all others as they were."""
    return rows.withColumns({c: F.when(F.col(key).eqNullSafe(F.lit(value)), x).otherwise(F.col(c)) for c, x in changes.items()})


def may_disable(users: DataFrame) -> DataFrame:
    """FIL15, AG21: enabled administrators, and whether one of them may be disabled: never the last."""
    on = F.count_if(F.col("enabled") & F.col("admin"))
    return users.agg(F.count("*").alias("users"), F.count_if("admin").alias("admins"), on.alias("enabled_admins"), (on > 1).alias("may_disable"))


def anomalies(contracts: DataFrame) -> DataFrame:
    """FIL3: stored, not visible, by what is missing."""
    flags = {"no_date": F.col("publication_date").isNull(), "no_amount": F.col("amount").isNull(), "no_supplier": F.col("supplier_id").isNull()}
    return contracts.where(~visible()).groupBy(*[v.alias(k) for k, v in flags.items()]).agg(F.count("*").alias("n"))


def section_state(contracts: DataFrame, bodies: DataFrame, state: DataFrame) -> DataFrame:
    """ST10, SP10, PRJ5: years shown, partial, updating; bodies without a visible year have no section."""
    shown = contracts.where(visible()).groupBy("body").agg(F.countDistinct("publication_year").alias("n_years"))
    full = bodies.join(state, "body", "left").withColumn("import_status", F.coalesce("state", F.lit("NEVER_STARTED")))
    return shown.join(full, "body").select("body", "n_years", "import_status", (F.col("import_status") != "COMPLETE").alias("partial"), eligible().alias("updating"))


def import_mode(status: Column) -> Column:
    """PRJ6."""
    return F.when(status == "NEVER_STARTED", "INITIAL").when(status == "INCOMPLETE", "RESUMED").when(status == "COMPLETE", "INCREMENTAL")
