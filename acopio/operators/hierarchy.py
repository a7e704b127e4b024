"""Trees of terms: paths, cycles, pruning and search, with self-joins that double their reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checkpoints(spark) -> None:
    """Rounds are cut off with checkpoint(), which executors share."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="acopio-"))


def _jumps(terms: DataFrame) -> DataFrame:
    """(id, above) for terms whose parent is a term."""
    known = terms.select(F.col("id").alias("parent"))
    return terms.where(F.col("parent").isNotNull()).join(known, "parent", "left_semi").select("id", F.col("parent").alias("above")).checkpoint()


def _doubled(jump: DataFrame) -> DataFrame:
    return jump.join(jump.select(F.col("id").alias("above"), F.col("above").alias("top")), "above").select("id", F.col("top").alias("above")).checkpoint()


def closure(terms: DataFrame) -> DataFrame:
    """HI1: (id, ancestor, up) for terms (id, parent), itself included, at any depth.

    An ancestor that a loop leads to again and again is one row, with the fewest steps.  The
    number of joins is the logarithm of the depth, or with loops of the number of terms.
    """
    _checkpoints(terms.sparkSession)
    jump = _jumps(terms)
    found = terms.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("up"))
    reach, total = 1, terms.count()
    while reach <= total and not jump.isEmpty():
        more = found.join(jump.select(F.col("id").alias("ancestor"), "above"), "ancestor").select("id", F.col("above").alias("ancestor"), (F.col("up") + reach).alias("up"))
        found = found.unionByName(more).groupBy("id", "ancestor").agg(F.min("up").alias("up")).checkpoint()
        jump = _doubled(jump)
        reach *= 2
    return found


def on_cycle(terms: DataFrame, depth: int | None = None) -> DataFrame:
    """HI1: terms that are their own ancestors, in loops of any length.

    After as many steps as there are terms only loops are left to jump in, and every term of a
    loop is jumped to from it.  ``depth`` bounds nothing; callers may still give it.
    """
    _checkpoints(terms.sparkSession)
    jump, reach, total = _jumps(terms), 1, terms.count()
    while reach < total and not jump.isEmpty():
        jump = _doubled(jump)
        reach *= 2
    return jump.select(F.col("above").alias("id")).distinct()


def move_refused(terms: DataFrame, moved: int, to: int) -> DataFrame:
    """HI1: a row if putting ``moved`` under ``to`` would close a loop."""
    return closure(terms).where((F.col("id") == to) & (F.col("ancestor") == moved)).select(F.lit(True).alias("refused")).limit(1)


def paths(terms: DataFrame) -> DataFrame:
    """HI2, HI3: names from root to term joined by a mark, and the depth; orphans are roots.  Terms on or below
    a loop have no path.

    Each round puts what leads to a term's topmost known ancestor before its own names: a row a term, and
    twice the reach.
    """
    _checkpoints(terms.sparkSession)
    known = terms.select(F.col("id").alias("parent"), F.lit(True).alias("acopio_known"))
    x = terms.join(known, "parent", "left").select("id", F.when(F.col("acopio_known"), F.col("parent")).alias("above"), F.array("name").alias("names")).checkpoint()
    reach, total = 1, terms.count()
    while reach <= total and not x.where("above is not null").isEmpty():
        up = x.select(F.col("id").alias("above"), F.col("above").alias("top"), F.col("names").alias("before"))
        joined = x.join(up, "above", "left")
        x = joined.select("id", F.col("top").alias("above"), F.when(F.col("before").isNull(), F.col("names")).otherwise(F.concat("before", "names")).alias("names")).checkpoint()
        reach *= 2
    return x.where("above is null").select("id", F.array_join("names", " › ").alias("path"), (F.size("names") - 1).alias("depth"))


def prune(terms: DataFrame, bodies: DataFrame) -> DataFrame:
    """HI4: terms with a body on them or beneath."""
    kept = closure(terms).join(bodies.select(F.col("term").alias("id")).distinct(), "id", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    return terms.join(kept, "id", "left_semi")


def search(terms: DataFrame, match, pinned=None) -> DataFrame:
    """HI5: matching terms, what lies beneath, what leads to them, and a pinned term with what leads to it.

    The closure is made once and read from the checkpoint for all three.
    """
    c = closure(terms)
    hits = terms.where(match).select("id")
    above = hits if pinned is None else hits.unionByName(terms.where(F.col("id") == pinned).select("id"))
    up = c.join(above, "id", "left_semi").select(F.col("ancestor").alias("id"))
    down = c.join(hits.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    return terms.join(up.union(down).distinct(), "id", "left_semi")


def picker(terms: DataFrame, match, pinned=None) -> DataFrame:
    """HI5: the terms a search shows, with their depth, in pre-order: children after their parent, by name and id."""
    shown = search(terms, match, pinned)
    steps = closure(terms).join(shown.select("id"), "id", "left_semi").join(terms.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    line = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), F.lower("name").alias("fold"), F.col("ancestor").alias("of"))))
    rows = steps.groupBy("id").agg(line.alias("p")).select("id", (F.size("p") - 1).alias("depth"), F.transform("p", lambda x: F.struct(x["fold"], x["of"])).alias("acopio_line"))
    return shown.select("id", "name").join(rows, "id").orderBy("acopio_line").drop("acopio_line")


def deleted(terms: DataFrame, gone) -> DataFrame:
    """UPS18, AG3: terms without one; an error if it has children."""
    children = terms.where(F.col("parent") == gone)
    if not children.isEmpty():
        raise ValueError(f"term {gone} has terms beneath")
    return terms.where(~F.col("id").eqNullSafe(F.lit(gone)))


def with_children(terms: DataFrame) -> DataFrame:
    """AG3: terms and whether any term lies beneath: an aggregate, not a row a child."""
    beneath = terms.where(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct().withColumn("has_children", F.lit(True))
    return terms.join(beneath, "id", "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def placed(bodies: DataFrame, terms: DataFrame) -> DataFrame:
    """JN16, UPS18: bodies with the name of their term; unknown or none: unclassified."""
    return bodies.join(terms.select(F.col("id").alias("term"), F.col("name").alias("term_name")), "term", "left").withColumn("term_name", F.coalesce("term_name", F.lit("unclassified")))


def sibling_clashes(terms: DataFrame) -> DataFrame:
    """HI6, SF16, FIL7: names that two children of one parent share, whatever the case."""
    return terms.groupBy("parent", F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
