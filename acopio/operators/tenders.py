"""Tenders: rows with amounts and awardees, facets, lots, and who was awarded what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acopio.operators.upsert import distinct_by

#: Precedence of the routes to an awardee, strongest first (RES11).
PATHS = ("FORMALISATION", "BIDDER", "NAME_DERIVED", "UNRESOLVED")


def tender_rows(tenders: DataFrame, awards: DataFrame, lots: DataFrame) -> DataFrame:
    """AG12-AG14, JN13: a row a tender with its amount, basis, completeness and awardee.

    Awards and lots are aggregated before they are joined, so nothing multiplies.  Both are stored by (tender, lot),
    so their lots are counted without looking for repeats; only awardees repeat.
    """
    live = awards.where(~F.col("withdrawn"))
    per_award = live.groupBy("tender").agg(
        F.sum("amount").alias("awarded"),
        F.count(F.when(F.col("amount").isNotNull(), F.col("lot"))).alias("awarded_lots"),
        F.countDistinct("supplier_id").alias("n_awardees"),
        F.max("supplier_id").alias("one_awardee"),
    )
    per_lot = lots.where(~F.col("withdrawn")).groupBy("tender").agg(F.count("lot").alias("stored_lots"))
    t = tenders.join(per_award, "tender", "left").join(per_lot, "tender", "left")
    lot_count = F.greatest(F.coalesce("stored_lots", F.lit(0)), F.coalesce("lote_count", F.lit(0)))
    basis = F.when(F.col("awarded").isNotNull(), "AWARDED").when(F.col("base_budget").isNotNull(), "BUDGET").otherwise("UNSTATED")
    many = F.coalesce("n_awardees", F.lit(0))
    return t.select(
        *tenders.columns, F.coalesce("awarded", "base_budget").alias("amount"), basis.alias("basis"),
        ((basis == "AWARDED") & (F.coalesce("awarded_lots", F.lit(0)) < lot_count)).alias("partial"),
        many.alias("n_awardees"), F.when(many == 1, F.col("one_awardee")).alias("awardee_id"),
    )


def with_cpv(tenders: DataFrame, classes: DataFrame, code: str) -> DataFrame:
    """FIL5, JN14: tenders with a live classification of that code, on a lot or the whole."""
    return tenders.join(classes.where((F.col("cpv") == code) & ~F.col("withdrawn")).select("tender"), "tender", "left_semi")


def cpv_facets(tenders: DataFrame, classes: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """SET4: codes on the selection's tenders; with a vocabulary (cpv, label) their labels, null where it has none."""
    found = classes.where(~F.col("withdrawn")).join(tenders.select("tender"), "tender", "left_semi").select("cpv").distinct()
    return found if vocabulary is None else found.join(vocabulary.select("cpv", "label"), "cpv", "left")


def state_facets(tenders: DataFrame, states: DataFrame) -> DataFrame:
    """SET4: states by code: two codes that share a label stay two."""
    return tenders.select("state").distinct().join(states, "state", "left").orderBy("label", "state")


def lots_of(cells: DataFrame, table: DataFrame) -> DataFrame:
    """HX5: a tender's lots: cells (tender, lot, printed, source, pos) in source order, first
    spelling kept; described by the lots table, plus the lots only it has."""
    seen = distinct_by(cells.where(F.col("lot").isNotNull()), ["tender", "lot"], [F.asc("source"), F.asc("pos")])
    described = distinct_by(table, ["tender", "lot"], [F.asc("pos")]).select("tender", "lot", F.col("printed").alias("printed2"), "description")
    return seen.join(described, ["tender", "lot"], "full").select("tender", "lot", F.coalesce("printed", "printed2").alias("printed"), "description")


def participants_differ(stated: DataFrame, bidders: DataFrame) -> DataFrame:
    """AG5, AG6: award points whose stated participants are not the bidder rows parsed; a
    figure missing on either side is not checked."""
    counted = bidders.groupBy("tender", "lot").agg(F.count("*").alias("parsed"))
    s = stated.where(F.col("stated").isNotNull()).alias("s")
    return s.join(counted.alias("c"), F.col("s.tender").eqNullSafe(F.col("c.tender")) & F.col("s.lot").eqNullSafe(F.col("c.lot"))).where("s.stated <> c.parsed").select("s.tender", "s.lot", "s.stated", "c.parsed")


def award_cascade(awards: DataFrame, formalised: DataFrame, bidders: DataFrame, catalogue: DataFrame, consortia: DataFrame) -> DataFrame:
    """RES10, RES11, JN10, JN11: each award's supplier and the route to it.

    In order: a catalogued consortium of that name in the tender; a bid as an uncatalogued
    consortium (nobody); the formalisation of the same lot, unless it names another party; the
    one identifier among same-name bidders, if each of them has it; the one catalogue
    entry of that name; else unresolved.  Every route is aggregated to one row an award
    before it is joined.
    """
    group = consortia.groupBy("tender", "fold").agg(F.min("supplier_id").alias("consortium"), F.lit(True).alias("is_consortium"))
    form = formalised.groupBy("tender", "lot").agg(F.min(F.struct("pos", "fold", "supplier_id")).alias("f"))
    form = form.select(F.col("tender").alias("ft"), F.col("lot").alias("fl"), F.col("f.fold").alias("ff"), F.col("f.supplier_id").alias("fs"))
    bids = bidders.groupBy("tender", "fold").agg(F.countDistinct("supplier_id").alias("ids"), F.count_if(F.col("supplier_id").isNull()).alias("nameless"), F.min("supplier_id").alias("bidder"))
    by_name = catalogue.where(F.col("fold").isNotNull()).groupBy("fold").agg(F.countDistinct("supplier_id").alias("matches"), F.min("supplier_id").alias("named"))
    x = awards.join(group, ["tender", "fold"], "left").join(bids, ["tender", "fold"], "left").join(by_name, "fold", "left")
    x = x.join(form, (F.col("tender") == F.col("ft")) & F.col("lot").eqNullSafe(F.col("fl")), "left")
    same_party = F.col("ff").isNull() | F.col("fold").isNull() | (F.col("ff") == F.col("fold"))
    nobody = F.coalesce("is_consortium", F.lit(False)) & F.col("consortium").isNull()
    route = (
        F.when(F.col("consortium").isNotNull(), "BIDDER").when(nobody, "UNRESOLVED").when(F.col("fs").isNotNull() & same_party, "FORMALISATION")
        .when((F.col("ids") == 1) & (F.col("nameless") == 0), "BIDDER").when(F.col("matches") == 1, "NAME_DERIVED").otherwise("UNRESOLVED")
    )
    who = F.when(F.col("consortium").isNotNull(), F.col("consortium")).when(route == "FORMALISATION", F.col("fs")).when(route == "BIDDER", F.col("bidder")).when(route == "NAME_DERIVED", F.col("named"))
    return x.select(*awards.columns, route.alias("path"), who.alias("awardee_id"))


def supersedes(new: Column, old: Column) -> Column:
    """RES11: strictly stronger routes replace weaker ones."""
    rank = F.create_map(*[F.lit(y) for k, p in enumerate(PATHS) for y in (p, k)])
    return rank[new] < rank[old]


def consortium_members(consortia: DataFrame) -> DataFrame:
    """RES9, UPS11: consortia (consortium, members array<string>) to distinct pairs; unusable
    identifiers and a consortium itself are left out."""
    from acopio.functions.clean import usable_fiscal_id

    pairs = consortia.select("consortium", F.explode_outer("members").alias("m")).select("consortium", usable_fiscal_id(F.col("m")).alias("member"))
    return pairs.where(F.col("member").isNotNull() & (F.col("member") != F.col("consortium"))).distinct()


def consortium_key(tender: Column, fold: Column) -> Column:
    """RES6: the key of a consortium without an identifier: one for each tender and name."""
    return F.when(fold.isNotNull(), F.sha2(F.concat_ws("|", tender.cast("string"), fold), 256))


def consortium_identity(parties: DataFrame, formalised: DataFrame) -> DataFrame:
    """RES6-RES8: the consortia of a tender, one for each folded name: (tender, fold, name, fiscal_id, path, party).

    parties: (tender, pos, fold, name, fiscal_id), formalised: (tender, pos, fold, fiscal_id).  The identifier is the
    first that a bidder row of the name has, else the first of a formalisation with that name; without one the
    party is known by tender and name, so a re-import finds it again.
    """
    named = parties.where(F.col("fold").isNotNull()).groupBy("tender", "fold").agg(
        F.min_by("name", "pos").alias("name"), F.min(F.when(F.col("fiscal_id").isNotNull(), F.struct("pos", "fiscal_id"))).alias("b")
    )
    form = formalised.where(F.col("fold").isNotNull() & F.col("fiscal_id").isNotNull()).groupBy("tender", "fold").agg(F.min(F.struct("pos", "fiscal_id")).alias("f"))
    both = named.join(form, ["tender", "fold"], "left").withColumn("fiscal_id", F.coalesce("b.fiscal_id", "f.fiscal_id"))
    path = F.when(F.col("b").isNull() & F.col("f").isNotNull(), "FORMALISATION").otherwise("BIDDER")
    return both.select("tender", "fold", "name", "fiscal_id", path.alias("path"), F.coalesce("fiscal_id", consortium_key(F.col("tender"), F.col("fold"))).alias("party"))


def consortium_bids(parties: DataFrame, identities: DataFrame) -> DataFrame:
    """RES8, RES12: each row's bid, won by nobody yet; a row without a name is a bid by nobody."""
    return parties.join(identities.select("tender", "fold", "party"), ["tender", "fold"], "left").select("tender", "lot", "party", F.lit(False).alias("won"))


def at_lots(rows: DataFrame, lots: DataFrame, strict: bool = True) -> DataFrame:
    """JN12: rows with the ``lot_id`` of their lot (null: the whole procedure).  A lot that is not stored is an
    error, or with ``strict`` off a row whose ``stored`` is false."""
    found = rows.join(lots.select("tender", "lot", "lot_id"), ["tender", "lot"], "left").withColumn("stored", F.col("lot").isNull() | F.col("lot_id").isNotNull())
    if not strict:
        return found
    says = F.concat(F.lit("a row names lot "), F.col("lot").cast("string"), F.lit(", which tender "), F.col("tender").cast("string"), F.lit(" has not stored"))
    return found.withColumn("lot_id", F.when(F.col("stored"), F.col("lot_id")).otherwise(F.raise_error(says))).drop("stored")


def awardee_rank(date: Column, publication: Column) -> Column:
    """RES13: where a name that an award gives ranks; null where the publication is no number."""
    from acopio.functions.clean import numeric_id

    number = numeric_id(publication)
    return F.when(number.isNotNull(), F.struct(date.alias("date"), number.alias("source_id")))


def with_state(tenders: DataFrame, code: str) -> DataFrame:
    """FIL5: by code; an unknown one matches nothing."""
    return tenders.where(F.col("state") == code)


def detail(tenders: DataFrame, lots: DataFrame, awards: DataFrame, formalised: DataFrame, classes: DataFrame, bidders: DataFrame) -> DataFrame:
    """SP5: a row a tender with arrays of its lots, awards, formalisations, classes and bidders; a bidder
    is the winner of a lot if an award of that lot (or of the whole) is theirs.  Each family is gathered before it is joined."""

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("tender").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != "tender"]))).alias(name))

    won = awards.where(F.col("supplier_id").isNotNull()).select(F.col("tender").alias("wt"), F.col("lot").alias("wl"), F.col("supplier_id").alias("ws")).distinct()
    same = (F.col("tender") == F.col("wt")) & F.col("lot").eqNullSafe(F.col("wl")) & (F.col("supplier_id") == F.col("ws"))
    marked = bidders.join(won, same, "left").select("tender", "lot", "supplier_id", F.col("wt").isNotNull().alias("winner"))
    out = tenders
    for rows, name in ((lots, "lots"), (awards, "awards"), (formalised, "formalisations"), (classes, "classes"), (marked, "bidders")):
        out = out.join(gathered(rows, name), "tender", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def won_through(memberships: DataFrame, awards: DataFrame) -> DataFrame:
    """SP4, JN15, FIL8: awards of a consortium, shown for each live member and in none of their totals."""
    live = memberships.where(~F.col("withdrawn"))
    return live.join(awards, live["consortium"] == awards["supplier_id"]).select(live["member"].alias("supplier_id"), "tender", "lot", "amount", F.lit(False).alias("counts"))
