from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from acopio.operators import browse, hierarchy, runs, suppliers, tenders, upsert
from acopio.sources import store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def grid(spark):
    """Two bodies, two years, ties in date and amount, and rows with something missing."""
    cells = [(b * 100000 + (y - 2000) * 1000 + n, f"b{b}", date(y, 1, 1 + n % 24), float(n % 40), n % 5, y) for b in (1, 2) for y in (2024, 2025) for n in range(240)]
    cells += [(1, "b1", None, 1.0, 1, None), (2, "b1", date(2024, 1, 1), None, 1, 2024), (3, "b1", date(2024, 1, 1), 1.0, None, 2024), (4, "b1", None, None, None, None), (5, "b3", date(2020, 1, 1), None, 1, 2020)]
    return spark.createDataFrame(cells, "source_id long, body string, publication_date date, amount double, supplier_id int, publication_year int")


@pytest.mark.parametrize("sort", [browse.Sort(c, d) for c in browse.SORTABLE for d in (True, False)])
def test_pages_are_exhaustive(grid, sort):
    seen = grid.where(browse.visible(2024, "b1"))
    got = [r.source_id for n in range(1, 7) for r in browse.page(seen, sort.columns(), n, 50).collect()]
    assert len(got) == len(set(got)) == 240
    key = lambda r: (r[sort.column], r.source_id)
    assert got == [r.source_id for r in sorted(seen.collect(), key=key, reverse=sort.descending)]
    assert browse.page(seen, sort.columns(), 7, 50).count() == 0
    assert browse.envelope(seen, 7, 50).first().asDict() == {"page": 7, "size": 50, "total_items": 240, "total_pages": 5}


def test_facets_and_anomalies(grid):
    assert [r[0] for r in browse.years(grid, "b1").collect()] == [2025, 2024]
    assert browse.years(grid, "b3").count() == 0
    assert browse.anomalies(grid).agg(F.sum("n")).first()[0] == 5


def test_arguments_are_checked():
    assert browse.parse_sort(None) == browse.Sort() and browse.parse_paging() == (1, 50) and browse.parse_year("2024") == 2024
    for bad in ("amount", "amount,up", "x,asc", "a,b,c"):
        with pytest.raises(ValueError):
            browse.parse_sort(bad)
    for bad in (("0", None), ("1", "101"), ("x", None), ("99999999999", None)):
        with pytest.raises(ValueError):
            browse.parse_paging(*bad)
    for bad in (None, "0999", "24", "20245"):
        with pytest.raises(ValueError):
            browse.parse_year(bad)


def test_upsert_replaces_whole_rows_and_counts(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, 1, "c")], "t int, lot int, v string")
    new = spark.createDataFrame([(2, None, None), (3, None, "d")], "t int, lot int, v string")
    assert rows(upsert.upsert(old, new, ["t", "lot"])) == [(1, None, "a"), (2, 1, "c"), (2, None, None), (3, None, "d")]
    assert tuple(upsert.upsert_counts(old, new, ["t", "lot"]).first()) == (1, 1)
    assert rows(upsert.upsert(old, new.where("1 = 0"), ["t", "lot"])) == rows(old)
    assert rows(upsert.upsert(old, new, ["t", "lot"], first_spelling=["v"]))[2] == (2, None, "b")


def test_last_and_first_win(spark):
    b = spark.createDataFrame([("k", "x", 1), ("k", "y", 2), ("l", "z", 3)], "k string, v string, pos int")
    assert rows(upsert.last_wins(b, ["k"])) == [("k", "y", 2), ("l", "z", 3)]
    assert rows(upsert.first_wins(b, ["k"])) == [("k", "x", 1), ("l", "z", 3)]


def test_reconcile(spark):
    old = spark.createDataFrame([("a", "A", True, True), ("b", "B", False, True), ("c", "C", True, False), ("d", "D", True, True), ("e", "E", False, True)], "body string, name string, active boolean, importable boolean")
    new = spark.createDataFrame([("a", "A"), ("b", "B"), ("d", "D2"), ("n", "N")], "body string, name string")
    assert rows(upsert.reconcile_bodies(old, new)) == [
        ("a", "A", True, True, None), ("b", "B", True, True, "REFRESHED"), ("c", "C", False, False, "DEACTIVATED"), ("d", "D2", True, True, "REFRESHED"), ("e", "E", False, True, None), ("n", "N", True, False, "ADDED"),
    ]


def test_names(spark):
    r = spark.createDataFrame(
        [(1, "Old", date(2020, 1, 1), 5, 0), (1, "New", date(2021, 1, 1), 1, 1), (1, "new", date(2021, 1, 1), 1, 2), (2, None, None, None, 0), (2, "X", None, 9, 1), (3, "First", None, None, 0)],
        "supplier int, name string, date date, source_id long, pos long",
    )
    assert [(x.supplier, x.name) for x in suppliers.displayed_name(r).orderBy("supplier").collect()] == [(1, "New"), (2, "X"), (3, "First")]
    assert [(x.supplier, x.name) for x in suppliers.retained_names(r).orderBy("name").collect()] == [(1, "Old"), (1, "new")]


def test_tender_rows(spark):
    t = spark.createDataFrame([(1, 5, 100.0), (2, 0, None), (3, 1, 50.0)], "tender int, lote_count int, base_budget double")
    a = spark.createDataFrame([(1, 1, 10.0, 7, False), (1, 2, 5.0, 8, False), (1, 3, 99.0, 9, True), (3, None, None, 7, False)], "tender int, lot int, amount double, supplier_id int, withdrawn boolean")
    got = {r.tender: (r.amount, r.basis, r.partial, r.n_awardees, r.awardee_id) for r in tenders.tender_rows(t, a, a).collect()}
    assert got == {1: (15.0, "AWARDED", True, 2, None), 2: (None, "UNSTATED", False, 0, None), 3: (50.0, "BUDGET", False, 1, 7)}


def test_cascade(spark):
    s = "tender int, lot int, fold string"
    aw = spark.createDataFrame([(1, None, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (1, 4, "e"), (1, 5, "f"), (1, 6, "u")], s)
    fo = spark.createDataFrame([(1, None, "a", 10, 0), (1, 1, "z", 11, 0)], s + ", supplier_id int, pos int")
    bi = spark.createDataFrame([(1, "b", 20), (1, "c", 21), (1, "c", None), (1, "d", 22), (1, "d", 23)], "tender int, fold string, supplier_id int")
    ca = spark.createDataFrame([("e", 30), ("c", 31), ("c", 32)], "fold string, supplier_id int")
    co = spark.createDataFrame([(1, "f", 40), (1, "u", None)], "tender int, fold string, supplier_id int")
    got = {r.fold: (r.path, r.awardee_id) for r in tenders.award_cascade(aw, fo, bi, ca, co).collect()}
    assert got == {"a": ("FORMALISATION", 10), "b": ("BIDDER", 20), "c": ("UNRESOLVED", None), "d": ("UNRESOLVED", None), "e": ("NAME_DERIVED", 30), "f": ("BIDDER", 40), "u": ("UNRESOLVED", None)}


def test_consortia_and_precedence(spark):
    c = spark.createDataFrame([("U1", ["b1", " ", "u1", "b1"])], "consortium string, members array<string>")
    assert rows(tenders.consortium_members(c)) == [("U1", "B1")]
    p = spark.createDataFrame([("FORMALISATION", "BIDDER"), ("BIDDER", "BIDDER"), ("UNRESOLVED", "NAME_DERIVED")], "a string, b string")
    assert [r[0] for r in p.select(tenders.supersedes(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_tree(spark):
    t = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 9, "d"), (5, 6, "e"), (6, 5, "f")], "id int, parent int, name string")
    good = t.where("id < 5")
    assert rows(hierarchy.paths(good)) == [(1, "a", 0), (2, "a › b", 1), (3, "a › b › c", 2), (4, "d", 0)]
    assert rows(hierarchy.on_cycle(t, 8)) == [(5,), (6,)]
    assert hierarchy.move_refused(good, 1, 3).count() == 1 and hierarchy.move_refused(good, 3, 1).count() == 0
    assert rows(hierarchy.prune(good, spark.createDataFrame([(3,)], "term int")).select("id")) == [(1,), (2,), (3,)]


def test_deep_tree(spark):
    """A chain of 100 terms, and a loop of 70 with one term below."""
    chain = [(k, k - 1 if k > 1 else None, f"n{k}") for k in range(1, 101)]
    loop = [(k, k - 1 if k > 200 else 269, f"n{k}") for k in range(200, 270)] + [(300, 250, "below")]
    t = spark.createDataFrame(chain, "id int, parent int, name string")
    got = {r.id: (r.path, r.depth) for r in hierarchy.paths(t).collect()}
    assert got == {k: (" › ".join(f"n{j}" for j in range(1, k + 1)), k - 1) for k in range(1, 101)}
    assert hierarchy.prune(t, spark.createDataFrame([(100,)], "term int")).count() == 100
    assert hierarchy.search(t, F.col("id") == 1).count() == 100 and hierarchy.move_refused(t, 1, 100).count() == 1
    both = t.unionByName(spark.createDataFrame(loop, "id int, parent int, name string"))
    assert rows(hierarchy.on_cycle(both)) == sorted([(k,) for k in range(200, 270)], key=repr) and hierarchy.on_cycle(t).count() == 0
    assert hierarchy.closure(both).where("id = 300").count() == 71


def test_sweep_ranks(spark):
    """All orders, whatever the width of a range, numbered within modes."""
    modes = F.element_at(F.array(*map(F.lit, ("VANISHED", "INCREMENTAL", "RESUMED", "INITIAL", "?"))), (F.col("pos") % 5 + 1).cast("int"))
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_orderkey").alias("pos")).withColumn("mode", modes)
    keys = sorted((r.pos for r in o.collect()), key=lambda k: (k % 5, k))
    assert max(keys) > 200
    for width in (1 << 16, 100):
        assert {r.pos: r.nth for r in runs.sweep_ranks(o, F.col("mode"), width).collect()} == {k: n for n, k in enumerate(keys, 1)}
    plan = runs.sweep_ranks(o, F.col("mode"))._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(acopio_mode" in plan


def test_runs(spark):
    c = spark.createDataFrame([(1, "a", "SUCCEEDED"), (1, "b", "SKIPPED"), (2, "a", "FAILED"), (3, "a", "FAILED"), (3, "b", "SUCCEEDED")], "run int, body string, state string").withColumns({"added": F.lit(1), "refreshed": F.lit(0)})
    all_runs = spark.createDataFrame([(n,) for n in range(1, 5)], "run int")
    assert [(r.run, r.state) for r in runs.with_verdict(all_runs, c).orderBy("run").collect()] == [(1, "SUCCEEDED"), (2, "FAILED"), (3, "PARTIALLY_SUCCEEDED"), (4, "SUCCEEDED")]
    w = spark.range(1).select(runs.windows(F.lit(date(2024, 1, 1)), F.lit(date(2024, 6, 1))).alias("w")).first().w
    assert [(x["from"], x["to"]) for x in w] == [(date(2024, 3, 4), date(2024, 6, 1)), (date(2024, 1, 1), date(2024, 3, 4))]
    now = F.lit(datetime(2024, 1, 1, 1))
    r = spark.createDataFrame([("IN_PROGRESS", datetime(2024, 1, 1)), ("IN_PROGRESS", datetime(2024, 1, 1, 0, 50)), ("SUCCEEDED", datetime(2024, 1, 1))], "state string, last_advanced_at timestamp")
    assert [x[0] for x in r.select(runs.read_state(now)).collect()] == ["ABANDONED", "IN_PROGRESS", "SUCCEEDED"]


def test_pages_come_in_order(spark):
    """Through the join with suppliers, in all four orders."""
    rng = random.Random(1)
    rows = [(k, "b", date(2024, 1, rng.randint(1, 9)), float(rng.randint(1, 9)), k % 7, 2024, "o", "d") for k in range(300)]
    contracts = spark.createDataFrame(rows, "source_id long, body string, publication_date date, amount double, supplier_id long, publication_year int, object string, duration string")
    names = spark.createDataFrame([(k, f"n{k}", f"f{k}") for k in range(7)], "supplier_id long, name string, fiscal_id string")
    for column, place in (("publication_date", 2), ("amount", 3)):
        for down in (True, False):
            sort, got, last = browse.Sort(column, down), [], None
            want = [r[0] for r in sorted(rows, key=lambda r: (r[place], r[0]), reverse=down)]
            for number in range(1, 8):
                page = browse.contract_page(contracts, names, "b", 2024, sort, number, 50)
                got += [r.source_id for r in page.collect()]
            assert got == want
            for at in range(0, 300, 100):
                after = [(r[column], r.source_id) for r in browse.page_after(contracts, sort, last, 100).collect()]
                assert [k for _, k in after] == want[at : at + 100]
                last = after[-1]


def test_deep_trees(spark):
    terms = spark.createDataFrame([(k, k - 1 if k else None, f"t{k}") for k in range(200)] + [(500, 499, "orphan")], "id long, parent long, name string")
    rows = {r.id: r for r in hierarchy.picker(terms, F.col("name") == "t150", pinned=20).collect()}
    assert set(rows) == set(range(200)) and rows[199].depth == 199
    few = {r.id for r in hierarchy.search(terms, F.col("name") == "nothing", pinned=3).collect()}
    assert few == {0, 1, 2, 3}
    assert hierarchy.move_refused(terms, 0, 199).count() == 1 and hierarchy.move_refused(terms, 199, 0).count() == 0
    order = [r.id for r in hierarchy.picker(spark.createDataFrame([(1, None, "b"), (2, None, "a"), (3, 1, "z"), (4, 1, "Y"), (5, 2, "q")], "id long, parent long, name string"), F.lit(True)).collect()]
    assert order == [2, 5, 1, 4, 3]
    with pytest.raises(ValueError):
        hierarchy.deleted(terms, 5)
    assert hierarchy.deleted(terms, 199).count() == 200


def test_store(spark, tmp_path):
    rows = [(k, f"b{k % 3}", date(2020 + k % 4, 1, 1), float(k), 2020 + k % 4) for k in range(100)] + [(900, "b0", None, 1.0, None)]
    kind = "source_id long, body string, publication_date date, amount double, publication_year int"
    table = store.contracts(spark, str(tmp_path / "c")).write(spark.createDataFrame(rows, kind))
    plan = table.read().where("publication_year = 2021 and body = 'b1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(publication_year" in plan
    table.upsert(spark.createDataFrame([(1, "b9", date(2023, 1, 1), None, 2023), (901, "b1", date(2022, 1, 1), 2.0, 2022)], kind))
    got = {r.source_id: r for r in table.read().collect()}
    assert len(got) == 102 and got[1].body == "b9" and got[1].amount is None and got[1].publication_year == 2023 and got[900].publication_year is None
    assert table.versions() == [1, 2]
    table.prune()
    assert table.versions() == [2] and table.read().count() == 102


def test_unknown_lots_are_an_error(spark):
    rows = spark.createDataFrame([(1, "1"), (1, None)], "tender long, lot string")
    lots = spark.createDataFrame([(1, "1", 10)], "tender long, lot string, lot_id long")
    assert {(r.lot, r.lot_id) for r in tenders.at_lots(rows, lots).collect()} == {("1", 10), (None, None)}
    with pytest.raises(Exception, match="has not stored"):
        tenders.at_lots(spark.createDataFrame([(1, "7")], "tender long, lot string"), lots).collect()


def test_negative_samples_are_an_error(spark):
    with pytest.raises(Exception, match="requests is negative"):
        spark.range(1).select(runs.non_negative(F.lit(-1), "requests")).collect()
