"""Aggregations, reshaping, tabulation and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.registry import Tables, query
from popweave.catalog.standins import money
from popweave.operators import checks, profile, reshape, tabulate
from popweave.operators.groups import exact_quantiles, group_count, group_sum, selection_probability
from popweave.operators.joins import add_tables, subtract_tables
from popweave.session import case_sensitive, constant_table

STATUS = ["F", "O", "P"]


def total(col):
    return F.sum(money(col)).cast("double")


@query("ag_01", """
SELECT l_suppkey, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, round_even(sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(l_quantity), 6) AS mean_quantity
FROM lineitem GROUP BY 1""")
def ag_01(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), total("l_quantity").alias("quantity"),
        F.bround(total("l_quantity") / F.count("l_quantity"), 6).alias("mean_quantity"))


@query("ag_02", """
WITH b AS (SELECT l_partkey AS building, count(*) AS people FROM lineitem GROUP BY 1)
SELECT building, people, (SELECT count(*) FROM lineitem) - (SELECT sum(people) FROM b)::BIGINT AS unplaced FROM b""")
def ag_02(t):
    people = t.lineitem.groupBy(F.col("l_partkey").alias("building")).agg(F.count(F.lit(1)).alias("people"))
    gap = t.lineitem.agg(F.count(F.lit(1))).scalar() - people.agg(F.sum("people")).scalar()
    return people.withColumn("unplaced", gap)


@query("ag_03", """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def ag_03(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))


@query("ag_04", """
SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::DECIMAL(18,2)) OVER (PARTITION BY l_suppkey), 0)::DOUBLE AS total_quantity FROM lineitem""")
def ag_04(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", money("l_quantity").alias("q"))
    return group_sum(rows, ["l_suppkey"], "q", "total_quantity").select(
        "l_orderkey", "l_linenumber", F.col("total_quantity").cast("double").alias("total_quantity"))


@query("ag_05", """
SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey, l_returnflag) AS total_count FROM lineitem""")
def ag_05(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return group_count(rows, ["l_partkey", "l_returnflag"], "l_orderkey", "total_count").select("l_orderkey", "l_linenumber", "total_count")


@query("ag_06", """
SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) / count(*) OVER (PARTITION BY l_suppkey)::DOUBLE AS prob_selected FROM lineitem""")
def ag_06(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return selection_probability(rows, ["l_suppkey"], "l_returnflag").select("l_orderkey", "l_linenumber", "prob_selected")


_TWO_WAY = """WITH c AS (SELECT o_orderpriority AS r, o_orderstatus AS s, o_totalprice FROM orders),
t AS (SELECT coalesce(r, 'Total') AS o_orderpriority, count(*) FILTER (s = 'F') AS "F", count(*) FILTER (s = 'O') AS "O",
  count(*) FILTER (s = 'P') AS "P", count(*) AS "Total" FROM c GROUP BY ROLLUP (r))"""


def _two_way(t):
    return tabulate.two_way(t.orders, "o_orderpriority", "o_orderstatus", STATUS, F.count(F.lit(1)))


@query("ag_07", _TWO_WAY + " SELECT * FROM t")
def ag_07(t):
    return _two_way(t)


@query("ag_08", _TWO_WAY + ' SELECT *, round_even("F" / "Total"::DOUBLE * 100, 6) AS row_percent FROM t')
def ag_08(t):
    return tabulate.row_percent(_two_way(t), "F")


@query("ag_09", _TWO_WAY + """, p AS (SELECT *, "F" / (SELECT "F" FROM t WHERE o_orderpriority = 'Total')::DOUBLE AS share FROM t)
SELECT o_orderpriority, "F", round_even(share * 100, 6) AS f_percent, format('{:,}', "F") || chr(9) || ' (' || printf('%.1f', share * 100) || '%)' AS f FROM p""")
def ag_09(t):
    # Two names of the result differ by case only, so it lives in a session of its own that tells them apart.
    t = Tables(case_sensitive(t.spark), t.folder)
    shared = tabulate.column_percent(_two_way(t), "o_orderpriority", "F", "text")
    return shared.select("o_orderpriority", "F", F.col("text_percent").alias("f_percent"), F.col("text").alias("f"))


@query("ag_10", """
SELECT coalesce(o_orderpriority, 'Total') AS o_orderpriority, round_even(median(o_totalprice), 6) AS median_price FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def ag_10(t):
    rows = t.orders.select("o_orderpriority", "o_totalprice")
    by_row = exact_quantiles(rows, ["o_orderpriority"], "o_totalprice", {"median_price": 0.5})
    overall = exact_quantiles(rows, [], "o_totalprice", {"median_price": 0.5}).withColumn("o_orderpriority", F.lit("Total"))
    return by_row.unionByName(overall).withColumn("median_price", F.bround("median_price", 6))


@query("ag_11", """
SELECT coalesce(l_returnflag, 'Total') AS l_returnflag, count(*) AS n, round_even(sum(l_quantity::DECIMAL(18,2))::DOUBLE / count(*), 6) AS mean_quantity,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def ag_11(t):
    return tabulate.margins(t.lineitem, ["l_returnflag"], n=F.count(F.lit(1)),
                            mean_quantity=F.bround(total("l_quantity") / F.count(F.lit(1)), 6), price=total("l_extendedprice"))


@query("ag_12", """
SELECT 'o_totalprice' AS variable, count(*) AS n, count(o_totalprice) AS valid, count(*) - count(o_totalprice) AS missing, min(o_totalprice) AS min, max(o_totalprice) AS max,
  round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, """ + ", ".join(
    f"round(quantile_cont(o_totalprice, {i / 10}), 4) AS p{i}0" for i in range(1, 10)) + " FROM orders")
def ag_12(t):
    wide = profile.numeric_profile(t.orders, "o_totalprice")
    return wide.withColumns({c: F.round(c, 4) for c in ["mean", "sd", *profile.DECILES]})


@query("ag_13", """
SELECT 'text' AS variable, count(*) AS n, count(text) AS valid, count(DISTINCT text) AS "distinct", min(length(text))::INT AS min_length, max(length(text))::INT AS max_length FROM documents""")
def ag_13(t):
    return profile.text_profile(t.documents.select("text"), "text")


@query("ag_14", """
SELECT 'quality' AS variable, count(*) AS n, count(quality) AS valid, count(*) - count(quality) AS missing, min(quality) AS min, max(quality) AS max
FROM documents LEFT JOIN labels USING (doc_id)""")
def ag_14(t):
    return profile.category_summary(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality")


@query("ag_15", """
WITH c AS (SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS w FROM orders GROUP BY 1),
l AS (SELECT DISTINCT l_linestatus AS code, 'status ' || l_linestatus AS label FROM lineitem UNION ALL SELECT 'X', 'status X')
SELECT coalesce(code, o_orderstatus) AS code, label, coalesce(n, 0) AS n, round_even(coalesce(n, 0) / (SELECT sum(n) FROM c)::DOUBLE * 100, 6) AS percent, coalesce(w, 0)::DOUBLE AS weighted
FROM l FULL JOIN c ON code = o_orderstatus""")
def ag_15(t):
    names = t.lineitem.select(F.col("l_linestatus").alias("code")).distinct().withColumn("label", F.concat(F.lit("status "), "code"))
    names = names.unionByName(constant_table(t.spark, ["code", "label"], [("X", "status X")]))
    rows = t.orders.select("o_orderstatus", money("o_totalprice").alias("w"))
    out = profile.category_table(rows, "o_orderstatus", names, "code", "w")
    return out.withColumn("weighted", F.col("weighted").cast("double"))


@query("ag_17", """
WITH c AS (SELECT o_custkey, count(*) AS a, count(*) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY 1) SELECT round(corr(a, b), 9) AS r FROM c""")
def ag_17(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("a"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("b"))
    return counts.agg(F.round(F.corr("a", "b"), 9).alias("r"))


@query("ag_18", """
WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey FROM c WHERE a = 1 AND n = 1 AND r = 1""")
def ag_18(t):
    return checks.in_all_segments(t.lineitem, ["l_orderkey"], "l_returnflag", ["A", "N", "R"])


def wide_counts(t):
    """Wide count table: one column per (return flag) code, stem H016."""
    flag = F.col("l_returnflag")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("block")).agg(
        F.count(F.when(flag == "A", 1)).alias("H016003"), F.count(F.when(flag == "N", 1)).alias("H016004"),
        F.count(F.when((flag == "R") & (F.col("l_linestatus") == "O"), 1)).alias("H016005"),
        F.count(F.when((flag == "R") & (F.col("l_linestatus") != "O"), 1)).alias("H016006"))


WIDE_SQL = """wide AS (SELECT l_suppkey AS block, count(*) FILTER (l_returnflag = 'A') AS "H016003", count(*) FILTER (l_returnflag = 'N') AS "H016004",
  count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS "H016005", count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') AS "H016006" FROM lineitem GROUP BY 1),
long AS (SELECT block, substr(name, 5) AS code, n FROM (UNPIVOT wide ON "H016003", "H016004", "H016005", "H016006" INTO NAME name VALUE n) WHERE n <> 0)"""


@query("ag_19", f"WITH {WIDE_SQL} SELECT * FROM long")
def ag_19(t):
    return reshape.unpivot_stem(wide_counts(t), ["block"], "H016", "code", "n")


@query("ag_20", """
WITH w AS (SELECT l_suppkey, count(*) FILTER (l_quantity <= 15) AS a1, count(*) FILTER (l_quantity > 15 AND l_quantity <= 35) AS a2, count(*) FILTER (l_quantity > 35) AS a3,
  count(*) FILTER (l_returnflag = 'A') AS e1, count(*) FILTER (l_returnflag = 'N') AS e2, count(*) FILTER (l_returnflag = 'R') AS e3 FROM lineitem GROUP BY 1),
a AS (SELECT *, unnest([1, 2, 3]) AS "Age", unnest([a1, a2, a3]) AS na FROM w), e AS (SELECT *, unnest([1, 2, 3]) AS "Earnings", unnest([e1, e2, e3]) AS ne FROM a)
SELECT l_suppkey, "Age", "Earnings", least(na, ne) AS jobcount FROM e WHERE na <> 0 AND ne <> 0""")
def ag_20(t):
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    wide = t.lineitem.groupBy("l_suppkey").agg(
        F.count(F.when(q <= 15, 1)).alias("CA01"), F.count(F.when((q > 15) & (q <= 35), 1)).alias("CA02"), F.count(F.when(q > 35, 1)).alias("CA03"),
        *[F.count(F.when(flag == f, 1)).alias(f"CE0{i}") for i, f in enumerate("ANR", 1)])
    return reshape.cascade(wide, ["l_suppkey"], {"CA": "Age", "CE": "Earnings"})


def _margins(df, by, traits):
    return checks.margin_table(df, by, traits)


_FIT = """WITH s AS (SELECT l_suppkey AS block, l_returnflag AS jobtype, l_linestatus AS trait_a, (l_linenumber % 3)::VARCHAR AS trait_b FROM lineitem),
e AS (SELECT (l_partkey + 19) // 20 AS block, l_returnflag AS jobtype, l_linestatus AS trait_a, (l_linenumber % 3)::VARCHAR AS trait_b FROM lineitem),
m AS (SELECT block, jobtype, 'a' AS trait, trait_a AS code, 1 AS n FROM s UNION ALL SELECT block, jobtype, 'b', trait_b, 1 FROM s
  UNION ALL SELECT block, jobtype, 'a', trait_a, -1 FROM e UNION ALL SELECT block, jobtype, 'b', trait_b, -1 FROM e),
g AS (SELECT block, jobtype, trait, code, sum(n) AS gap FROM m GROUP BY 1, 2, 3, 4)"""


def _fit_sides(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("block"), F.col("l_returnflag").alias("jobtype"), F.col("l_linestatus").alias("a"),
                             (F.col("l_linenumber") % 3).alias("b"), F.expr("(l_partkey + 19) div 20").alias("other"))
    by = ["block", "jobtype"]
    return _margins(rows, by, ["a", "b"]), _margins(rows.withColumn("block", F.col("other")), by, ["a", "b"])


@query("ag_21", _FIT + " SELECT block, jobtype, sum(abs(gap))::BIGINT AS fitness FROM g WHERE trait = 'a' GROUP BY 1, 2")
def ag_21(t):
    s, e = (x.filter("trait = 'a'") for x in _fit_sides(t))
    return checks.margin_fitness(s, e, ["block", "jobtype"])


@query("ag_22", _FIT + " SELECT block, jobtype, sum(abs(gap))::BIGINT AS fitness FROM g GROUP BY 1, 2")
def ag_22(t):
    s, e = _fit_sides(t)
    return checks.margin_fitness(s, e, ["block", "jobtype"])


@query("ag_23", _FIT + " SELECT jobtype, sum(abs(gap))::BIGINT AS fitness FROM g GROUP BY 1")
def ag_23(t):
    s, e = _fit_sides(t)
    return checks.margin_fitness(s, e, ["block", "jobtype"]).groupBy("jobtype").agg(F.sum("fitness").alias("fitness"))


@query("ag_24", _FIT + """, f AS (SELECT block, sum(abs(gap)) FILTER (trait = 'a') AS single_fitness, sum(abs(gap)) AS combined_fitness FROM g GROUP BY 1),
n AS (SELECT block, sum(x) AS expected, sum(y) AS selected FROM (SELECT block, 0 AS x, 1 AS y FROM s UNION ALL SELECT block, 1, 0 FROM e) GROUP BY 1)
SELECT block, expected::BIGINT AS expected, selected::BIGINT AS selected, coalesce(single_fitness, 0)::BIGINT AS single_fitness, combined_fitness::BIGINT AS combined_fitness FROM n JOIN f USING (block)""")
def ag_24(t):
    s, e = _fit_sides(t)
    by = ["block", "jobtype"]
    gap = subtract_tables(s, e, [*by, "trait", "code"], ["n"])
    # Every row appears once under trait a, so job totals come from its margins.
    totals = add_tables([(1, s.select("block", "trait", F.col("n").alias("selected"), F.lit(0).alias("expected"))),
                         (1, e.select("block", "trait", F.lit(0).alias("selected"), F.col("n").alias("expected")))],
                        ["block", "trait"], ["selected", "expected"]).filter("trait = 'a'")
    fit = gap.groupBy("block").agg(F.sum(F.when(F.col("trait") == "a", F.abs("n")).otherwise(0)).alias("single_fitness"), F.sum(F.abs("n")).alias("combined_fitness"))
    return totals.join(fit, "block").select("block", "expected", "selected", "single_fitness", "combined_fitness")


@query("ag_25", """
SELECT coalesce(l_returnflag, 'Total') AS l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O", count(*) AS "Total" FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def ag_25(t):
    return tabulate.two_way(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"], F.count(F.lit(1)))


@query("ag_26", """
WITH p AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT o_custkey * 2 AS o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT coalesce(p.o_custkey, e.o_custkey) AS o_custkey, coalesce(p.o_orderpriority, e.o_orderpriority) AS o_orderpriority, coalesce(p.n, 0) - coalesce(e.n, 0) AS error
FROM p FULL JOIN e ON p.o_custkey = e.o_custkey AND p.o_orderpriority = e.o_orderpriority""")
def ag_26(t):
    keys = ["o_custkey", "o_orderpriority"]
    count = lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("error"))
    return subtract_tables(count(t.orders), count(t.orders.withColumn("o_custkey", F.col("o_custkey") * 2)), keys, ["error"])


@query("ag_27", """
SELECT o_custkey, count(*) - count(*) FILTER (o_orderstatus = 'F') AS remaining FROM orders GROUP BY 1""")
def ag_27(t):
    source = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("remaining"))
    used = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("remaining"))
    return subtract_tables(source, used, ["o_custkey"], ["remaining"])


@query("ag_28", """
WITH c AS (SELECT c_nationkey AS block, count(*) AS "T", count(*) FILTER (o_orderstatus <> 'P') AS "H", count(*) FILTER (o_orderstatus = 'F') AS "A",
  count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) AS "I" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT block, 'A-I' AS out_key, "A" - "I" AS n FROM c UNION ALL SELECT block, 'H-(A-I)', "H" - "A" + "I" FROM c UNION ALL SELECT block, 'T-H', "T" - "H" FROM c""")
def ag_28(t):
    rows = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.col("o_orderstatus")
    member = F.array_compact(F.array(F.lit("T"), F.when(status != "P", "H"), F.when(status == "F", "A"),
                                     F.when((status == "F") & (F.col("o_totalprice") > 200000), "I")))
    counts = (rows.select(F.col("c_nationkey").alias("block"), F.explode(member).alias("grp"))
              .groupBy("block", "grp").agg(F.count(F.lit(1)).alias("n")))
    equations = reshape.equation_table(t.spark, {"A-I": {"A": 1, "I": -1}, "H-(A-I)": {"H": 1, "A": -1, "I": 1}, "T-H": {"T": 1, "H": -1}})
    return reshape.solve_equations(counts, equations, ["block"], "grp", "n")


JOB_COUNTS_SQL = """jc AS (SELECT l_suppkey AS block, count(*) AS jt0, count(*) FILTER (l_linenumber <= 5) AS jt1, count(*) FILTER (l_returnflag <> 'A') AS jt2,
  count(*) FILTER (l_returnflag <> 'A' AND l_linenumber <= 5) AS jt3, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 30) AS jt4,
  count(*) FILTER (l_returnflag = 'A' AND l_quantity > 30 AND l_linenumber <= 5) AS jt5 FROM lineitem GROUP BY 1)"""


def job_counts(t):
    """Overlapping job-type counts per block: all, primary, private, ... ."""
    private = F.col("l_returnflag") != "A"
    federal = ~private & (F.col("l_quantity") > 30)
    primary = F.col("l_linenumber") <= 5
    n = lambda cond: F.count(F.when(cond, 1))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("block")).agg(
        F.count(F.lit(1)).alias("JT00"), n(primary).alias("JT01"), n(private).alias("JT02"), n(private & primary).alias("JT03"),
        n(federal).alias("JT04"), n(federal & primary).alias("JT05"))


@query("ag_29", f"""WITH {JOB_COUNTS_SQL}
SELECT block, jt3 AS "JT03", jt4 AS "JT04", jt5 AS "JT05", jt0 - jt2 - jt4 AS "JT06", jt1 - jt3 - jt4 AS "JT07", jt0 - jt1 AS "JT08", jt2 - jt3 AS "JT09", jt4 - jt5 AS "JT10",
  (jt0 - jt2 - jt4) - (jt1 - jt3 - jt4) AS "JT11" FROM jc""")
def ag_29(t):
    return reshape.exclusive_columns(job_counts(t), ["block"], reshape.job_type_equations())


@query("ag_30", """
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1""")
def ag_30(t):
    from popweave.operators.ranks import first_per_group
    return first_per_group(t.lineitem, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_extendedprice"], ["l_orderkey", "l_linenumber"])


@query("ag_31", """
SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_keys, count(*) - count(l_orderkey) AS null_keys, count(*) = count(DISTINCT l_orderkey) AND count(*) = count(l_orderkey) AS is_key FROM lineitem""")
def ag_31(t):
    return checks.primary_key_report(t.lineitem.select("l_orderkey"), "l_orderkey")


@query("ag_32", """
SELECT max(l_orderkey)::VARCHAR AS longest, CASE WHEN length(max(l_orderkey)::VARCHAR) = 6 THEN 'match' WHEN length(max(l_orderkey)::VARCHAR) = 5 THEN 'pad' ELSE 'none' END AS status FROM lineitem""")
def ag_32(t):
    from popweave.functions.ids import id_length_status
    longest = t.lineitem.agg(F.max("l_orderkey").alias("m"))
    return longest.select(F.col("m").cast("string").alias("longest"), id_length_status(F.col("m"), 6).alias("status"))


@query("ag_33", """
WITH s AS (SELECT unnest([1, 2, 3, 4]) AS seed), d AS (SELECT seed, c_nationkey AS area, avg(CASE WHEN ('0x' || substr(md5(concat_ws('|', o_orderkey, seed)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < 0.25 THEN 1.0 ELSE 0.0 END) AS share
  FROM orders JOIN customer ON o_custkey = c_custkey, s GROUP BY 1, 2)
SELECT area, round(avg(share), 9) AS mean_share, round(min(share), 9) AS min_share, round(max(share), 9) AS max_share FROM d GROUP BY 1""")
def ag_33(t):
    from popweave.functions.seeded import uniform
    rows = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    seeded = rows.select(F.col("c_nationkey").alias("area"), "o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("seed"))
    shares = seeded.groupBy("seed", "area").agg(F.avg(F.when(uniform("o_orderkey", F.col("seed")) < 0.25, 1.0).otherwise(0.0)).alias("share"))
    return shares.groupBy("area").agg(F.round(F.avg("share"), 9).alias("mean_share"), F.round(F.min("share"), 9).alias("min_share"), F.round(F.max("share"), 9).alias("max_share"))


@query("ag_34", """
SELECT o_orderpriority, CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 600000 THEN 13 ELSE floor(o_totalprice / 50000)::INT + 1 END::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1, 2""")
def ag_34(t):
    return tabulate.histogram(t.orders, "o_orderpriority", "o_totalprice", 0.0, 600000.0, 12)


@query("ag_35", """
WITH l AS (SELECT 'flag' AS trait, l_returnflag AS code, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY 2),
r AS (SELECT 'flag' AS trait, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'X' END AS code, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', CASE WHEN l_quantity > 10 THEN 'O' ELSE 'F' END, count(*) FROM lineitem GROUP BY 2)
SELECT trait, code, coalesce(l.n, 0) AS left_n, coalesce(r.n, 0) AS right_n FROM l FULL JOIN r USING (trait, code) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""")
def ag_35(t):
    left = checks.margin_table(t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")), [], ["flag", "status"])
    number = F.col("l_linenumber") % 3
    right = checks.margin_table(t.lineitem.select(F.when(number == 0, "A").when(number == 1, "N").otherwise("X").alias("flag"),
                                                  F.when(F.col("l_quantity") > 10, "O").otherwise("F").alias("status")), [], ["flag", "status"])
    return checks.margin_differences(left, right, ["trait", "code"], "n")


@query("ag_36", """
WITH e AS (SELECT l_returnflag AS f, count(*) FILTER (l_quantity > 40) AS old_error, count(*) FILTER (l_quantity > 45) AS new_error FROM lineitem GROUP BY 1)
SELECT coalesce(f, 'Total') AS code, sum(old_error)::BIGINT AS old_error, sum(new_error)::BIGINT AS new_error, round_even((sum(old_error) - sum(new_error)) / sum(old_error)::DOUBLE * 100, 2) AS reduction_percent FROM e GROUP BY ROLLUP (f)""")
def ag_36(t):
    q = F.col("l_quantity")
    rows = t.lineitem.select(F.col("l_returnflag").alias("code"), F.when(q > 40, 1).otherwise(0).alias("a"), F.when(q > 45, 1).otherwise(0).alias("b"))
    return tabulate.margins(rows, ["code"], old_error=F.sum("a"), new_error=F.sum("b"),
                            reduction_percent=F.bround((F.sum("a") - F.sum("b")) / F.sum("a") * 100, 2))


@query("ag_37", """
SELECT min(l_extendedprice) AS min_x, min(l_quantity) AS min_y, max(l_extendedprice) AS max_x, max(l_quantity) AS max_y FROM lineitem""")
def ag_37(t):
    from popweave.operators.spatial import bounding_box
    return bounding_box(t.lineitem, "l_extendedprice", "l_quantity")


@query("ag_38", """
WITH c AS (SELECT l_partkey, l_suppkey, sum(a) AS a, sum(b) AS b FROM (SELECT l_partkey, l_suppkey, 1 AS a, 0 AS b FROM lineitem UNION ALL SELECT l_partkey, l_suppkey + l_linenumber % 2, 0, 1 FROM lineitem) GROUP BY 1, 2)
SELECT sum(least(a, b))::BIGINT AS matched, sum(a)::BIGINT AS left_rows, sum(b)::BIGINT AS right_rows, round_even(sum(least(a, b)) / least(sum(a), sum(b))::DOUBLE * 100, 6) AS match_percent FROM c""")
def ag_38(t):
    side = lambda key: t.lineitem.select("l_partkey", key.alias("l_suppkey"))
    return checks.multiset_match(side(F.col("l_suppkey")), side(F.col("l_suppkey") + F.col("l_linenumber") % 2), ["l_partkey", "l_suppkey"])


@query("ag_39", "SELECT source, lang, count(*) AS enrolled FROM documents GROUP BY 1, 2 UNION ALL SELECT source, 'all', count(*) FROM documents GROUP BY 1")
def ag_39(t):
    by_grade = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("enrolled"))
    return by_grade.unionByName(by_grade.groupBy("source").agg(F.sum("enrolled").alias("enrolled")).withColumn("lang", F.lit("all")))


@query("ag_40", "SELECT p_type, sum(p_size)::BIGINT AS employees, count(*) AS establishments FROM part GROUP BY 1")
def ag_40(t):
    return t.part.groupBy("p_type").agg(F.sum("p_size").alias("employees"), F.count(F.lit(1)).alias("establishments"))
