"""Invariants of the whole jobs that have no SQL."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from popweave.catalog import QUERIES, SQL
from popweave.catalog.registry import Tables
from popweave.catalog.standins import lines
from popweave.plans import jobs, places
from popweave.operators.checks import margin_table


def run(spark, key):
    return QUERIES[key](spark, SF).cache()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 200


def test_unit_inventory_keeps_margins(spark):
    units = run(spark, "pl_04")
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert units.count() == orders == units.select("huid").distinct().count()
    # Every unit of more than one person in the block/race cells with a known family count is set.
    assert units.filter("family not in (0, 1)").count() == 0
    bad = units.filter("(incomegroup between 1 and 16) and not (randincome >= 0)").count()
    assert bad == 0
    assert units.filter("hhinc is null").count() == 0


def test_person_inventory_counts(spark):
    persons = run(spark, "pl_05")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert persons.count() == lines == persons.select("precid").distinct().count()
    low = F.element_at(F.array(*[F.lit(v) for v in (0, 5, 10, 15, 18, 20, 21, 22, 25, 30, 35, 40, 45, 50, 55, 60, 62, 65, 67, 70, 75, 80, 85)]), F.col("agegroupP12"))
    assert persons.filter(F.col("randage") < low).count() == 0


def test_allocation_is_one_to_one(spark):
    pairs = run(spark, "pl_09").collect()
    assert len({r["c_custkey"] for r in pairs}) == len(pairs) == len({r["addrptid"] for r in pairs}) > 0


def test_community_keeps_every_unit(spark):
    out = run(spark, "pl_10")
    assert out.count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert out.filter("addrptid is null and p_partkey <> 'missing building id'").count() == 0


def test_final_person_table_keeps_everyone(spark):
    out = run(spark, "pl_18")
    inside = out.filter("precid not like '%PJ%'")
    assert inside.select("precid").distinct().count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    jobs = lines(Tables(spark, SF)).select("line_key")
    assert jobs.distinct().count() == jobs.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert rows(out.filter("jobid is not null").select("jobid")) == rows(jobs)


def test_allocation_follows_place_and_tenure(spark):
    """Two single houses and one duplex in a block; brute force of the first round."""
    units = spark.createDataFrame([(1, "b", 1), (2, "b", 1), (3, "b", 2), (4, "c", 1)], "u int, ub string, own int")
    points = spark.createDataFrame([("p1", "s1", 1, 1, "b"), ("p2", "s2", 1, 3, "b"), ("p3", "s2", 2, 3, "b"), ("p4", "s2", 3, 3, "b")],
                                   "pt string, st string, place long, units long, pb string")
    from popweave.operators.random_merge import Side
    got = places.allocate_units(Side(units, "u"), points, "pt", "st", ("block", F.col("ub"), F.col("pb")), ("group", F.col("ub"), F.col("pb")), "own", 3)
    pairs = {r["u"]: r["pt"] for r in got.collect()}
    assert set(pairs) == {1, 2, 3} and pairs[3] == "p2" and "p1" in (pairs[1], pairs[2])


def test_selection_by_agreement_meets_expected_numbers(spark):
    got = run(spark, "pl_23_agreement")
    assert got.count() == got.select("pk").distinct().count() > 0


def _brute_selection(pool, seed, want):
    """Chosen keys of one seed; pool: (pk, block, choice, traits, sure)."""
    order = lambda r: (hashlib.md5(f"{r[0]}|{seed}".encode()).hexdigest(), r[0])
    ranked = sorted(pool, key=order)
    first = {}
    for r in ranked:
        first.setdefault((r[1], r[2]), r[0])
    picked = {r[0]: first[r[1], r[2]] == r[0] or r[4] for r in pool}
    have, turn, out = Counter(r[1] for r in pool if picked[r[0]]), Counter(), set()
    for r in ranked:
        block, sel = r[1], picked[r[0]]
        turn[block, sel] += 1
        w, h, n = want[block], have[block], turn[block, sel]
        if sel if w == h else (sel and n <= w) or (not sel and n <= w - h):
            out.add(r[0])
    return out


def _brute_best(pool, targets, seeds, want):
    best = {}
    for seed in seeds:
        chosen = _brute_selection(pool, seed, want)
        for block in {r[1] for r in pool} | {t[0] for t in targets}:
            made = Counter((t, str(v)) for r in pool if r[1] == block and r[0] in chosen for t, v in zip("xy", r[3]))
            gap = {k: made[k] for k in made}
            for (b, t, v), n in targets.items():
                if b == block:
                    gap[t, v] = gap.get((t, v), 0) - n
            mine = {r[0] for r in pool if r[1] == block and r[0] in chosen}
            fit = (sum(map(abs, gap.values())), seed)
            if block not in best or fit < best[block][0]:
                best[block] = (fit, mine)
    return best


def _brute_agreement(rows, margins, want, seeds):
    """Every block on its own, until a pass changes nothing or nothing is open."""
    left = []
    for block in sorted({r[1] for r in rows}):
        pool = [r for r in rows if r[1] == block]
        for step in range(100):
            starts = [1 + 1000 * (k + (k >= 9)) for k in (2 * step, 2 * step + 1)]
            runs = [_brute_best(pool, {k: n for k, n in m.items() if k[0] == block}, range(a, a + seeds), want)[block][1] for m, a in zip(margins, starts)]
            winner = {}
            for r in pool:
                if r[0] in runs[0] & runs[1]:
                    winner[r[2]] = min(winner.get(r[2], r[0]), r[0])
            after = [(*r[:4], r[4] or winner.get(r[2]) == r[0]) for r in pool if winner.get(r[2], r[0]) == r[0]]
            moved, pool = after != pool, after
            if not moved or {r[2] for r in pool} == {r[2] for r in pool if r[4]}:
                break
        left += pool
    both = {}
    for m in margins:
        for k, n in m.items():
            both[k] = max(n, both.get(k, 0))
    final = _brute_best(left, both, range(9001, 9001 + seeds), want)
    return sorted((pk, fit[1], fit[0]) for fit, chosen in final.values() for pk in chosen)


@pytest.mark.parametrize("parts", [1, 7])
def test_agreement_against_brute_force(spark, parts):
    g = random.Random(3)
    rows = [(f"j{i}", i % 3, g.randrange(9), (g.randrange(3), g.randrange(2)), False) for i in range(70)]
    want = {b: 7 - b for b in range(3)}
    taken = rows[::7]
    margins = [Counter((r[1], t, str(r[3][k])) for r in taken) for k, t in enumerate("xy")]
    cand = spark.createDataFrame([(r[0], r[1], r[2], *r[3], want[r[1]], 0.0) for r in rows], "pk string, b int, ch int, x int, y int, want int, prob_selected double").repartition(parts)
    tables = {t: spark.createDataFrame([(*k, n) for k, n in m.items()], "b int, trait string, code string, n long") for t, m in zip("xy", margins)}
    got = jobs.select_jobs_by_agreement(cand, tables, ["b"], ["b", "ch"], ["b"], "pk", "want", ["x", "y"], 2)
    assert sorted((r["pk"], r["seed"], r["fitness"]) for r in got.collect()) == _brute_agreement(rows, margins, want, 2)


def test_best_seed_is_really_the_best(spark):
    cand = spark.range(120).select(F.col("id").cast("string").alias("pk"), (F.col("id") % 3).alias("b"), (F.col("id") % 12).alias("ch"), (F.col("id") % 2).alias("t"), F.lit(4).alias("want"))
    target = margin_table(cand.filter("cast(pk as int) < 40"), ["b"], ["t"])
    best = jobs.select_by_fit(cand, target, ["b"], ["b", "ch"], ["b"], "pk", "want", F.lit(False), ["t"], 6).collect()
    for block in range(3):
        fits = []
        for seed in range(1, 7):
            one = jobs.select_by_fit(cand, target, ["b"], ["b", "ch"], ["b"], "pk", "want", F.lit(False), ["t"], 1, seed).filter(F.col("b") == block)
            fits.append(one.first()["fitness"])
        mine = [r for r in best if r["b"] == block]
        assert len(mine) == 4 and mine[0]["fitness"] == min(fits)


def test_jobs_from_margins_keep_surplus_values(spark):
    wide = spark.createDataFrame([("b", 2, 2, 2, 1, 0), ("c", 0, 0, 1, 0, 2), (None, 1, 1, 0, 1, 0)], "block string, C000 int, CA01 int, CA02 int, CE01 int, CE02 int")
    out = jobs.jobs_from_margins(wide, "block", "C000", {"CA": "Age", "CE": "Earnings"}, 1)
    assert rows(out, "block", "job") == [("b", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 1), ("c", 2), (None, 1)]
    assert rows(out.filter("Age is not null").groupBy("block", "Age").count()) == [("b", 1, 2), ("b", 2, 2), ("c", 2, 1), (None, 1, 1)]
    assert rows(out.filter("Earnings is not null").groupBy("block", "Earnings").count()) == [("b", 1, 1), ("c", 2, 2), (None, 1, 1)]


def test_repair_moves_surplus_jobs_to_missing_codes(spark, paths):
    g = random.Random(8)
    made = [(f"j{i}", g.choice(["a", "b", None]), g.choice([1, 2, 3, None])) for i in range(400)] + [(f"z{i}", "full", 2) for i in range(5)]
    expected = [(b, c, g.randrange(70)) for b in ("a", "b", None) for c in (1, 2, 4, 5)] + [("none", 1, 3)]
    df = spark.createDataFrame([(*r, "x") for r in made], "pk string, block string, Age int, _places string").withColumnRenamed("_places", "extra").repartition(5)
    out, report = jobs.repair_margins(df, "pk", "block", "Age", spark.createDataFrame(expected, "block string, code int, n long"), 3)
    got = {r["pk"]: r for r in out.collect()}
    assert len(got) == len(made) == out.count() and out.columns == df.columns
    want = Counter()
    for b, c, n in expected:
        want[b, c] += n
    before, after = Counter((b, c) for _, b, c in made), Counter((r["block"], r["Age"]) for r in got.values())
    left = {(r["block"], None if r["code"] is None else int(r["code"])): r["gap"] for r in report.collect()}
    for key in set(want) | set(after) | set(before):
        assert after[key] - want[key] == left.get(key, 0)
    for b in {k[0] for k in left}:
        signs = {v > 0 for k, v in left.items() if k[0] == b}
        assert len(signs) == 1  # nothing that could have been moved is left
    for pk, b, c in made:  # only surplus jobs move, to codes that lacked some
        if got[pk]["Age"] != c:
            assert before[b, c] > want[b, c] and before[b, got[pk]["Age"]] < want[b, got[pk]["Age"]]


@pytest.mark.parametrize("kind,left,right,fails", [
    ("one_to_one", [1, 2, None], [1, 3, None], False), ("one_to_one", [1, 1], [1], True), ("one_to_one", [1], [2, 2], True), ("one_to_one", [None, None], [1], True),
    ("one_to_many", [1, 2], [1, 1, None, None], False), ("one_to_many", [1, 1], [2], True), ("many_to_one", [1, 1, None, None], [1, None], False),
    ("many_to_one", [1], [None, None], True), ("many_to_many", [1, 1], [1, 1], False)])
def test_joins_check_their_kind(spark, kind, left, right, fails):
    from popweave.operators.joins import checked_join, outer_indicator
    l, r = spark.createDataFrame([(k,) for k in left], "k int"), spark.createDataFrame([(k, "r") for k in right], "k int, v string")
    for run in (lambda: checked_join(l, r, ["k"], kind, "left").collect(), lambda: outer_indicator(l, r, ["k"], kind=kind).collect()):
        if fails:
            with pytest.raises(Exception, match="duplicate key"):
                run()
        else:
            run()


def test_a_checked_join_adds_no_exchange(spark):
    from popweave.operators.joins import checked_join
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        l, r = spark.range(50).withColumnRenamed("id", "k"), spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
        l, r = l.repartition(3), r.repartition(3)
        assert plan(checked_join(l, r, ["k"], "one_to_one")) == plan(l.join(r, "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_jobs_from_margins_match_counts(spark):
    wide = spark.createDataFrame([("b", 5, 2, 3, 4, 1), ("c", 2, 2, 0, 1, 0)], "block string, C000 int, CA01 int, CA02 int, CE01 int, CE02 int")
    out = jobs.jobs_from_margins(wide, "block", "C000", {"CA": "Age", "CE": "Earnings"}, 1)
    assert rows(out.groupBy("block", "Age").count()) == [("b", 1, 2), ("b", 2, 3), ("c", 1, 2)]
    assert rows(out.groupBy("block", "Earnings").count()) == [("b", 1, 4), ("b", 2, 1), ("c", 1, 1), ("c", None, 1)]
