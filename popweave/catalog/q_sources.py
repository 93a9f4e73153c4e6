"""Readers and writers: each query writes the given tables in the file layout
that the operator reads, into the shared folder, and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave import sources
from popweave.catalog.registry import query
from popweave.functions import geo
from popweave.functions.ids import zfill
from popweave.operators import recode
from popweave.session import scratch_path

CHUNK = 500  # rows of one request body or feature collection


@query("src_01", "SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS geoid, o_custkey, o_totalprice FROM orders")
def src_01(t):
    path = scratch_path(t.spark, "csv")
    t.orders.select(zfill(F.col("o_orderkey"), 12).alias("geoid"), "o_custkey", "o_totalprice").write.option("header", True).csv(path)
    return sources.read_delimited(t.spark, path, "geoid string, o_custkey bigint, o_totalprice double")


@query("src_02", """
SELECT lpad(c_custkey::VARCHAR, 8, '0') AS geo_id, c_nationkey AS state, c_mktsegment AS segment FROM customer""")
def src_02(t):
    path = scratch_path(t.spark, "bodies")
    row = F.array(zfill(F.col("c_custkey"), 8), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))
    head = F.array(*[F.lit(n) for n in ("GEO_ID", "SEG", "STATE")])
    bodies = t.customer.groupBy(F.floor(F.col("c_custkey") / CHUNK)).agg(F.collect_list(row).alias("rows"))
    bodies.select(F.to_json(F.concat(F.array(head), F.col("rows")))).write.text(path)
    read = sources.read_header_json(t.spark, path, {"STATE": "int", "GEO_ID": "string", "SEG": "string"}, body_per_line=True)
    return read.select(F.col("GEO_ID").alias("geo_id"), F.col("STATE").alias("state"), F.col("SEG").alias("segment"))


@query("src_03", """
SELECT l_suppkey::VARCHAR AS w_geocode, count(*)::INT AS "C000", 'nc' AS state, 'wac' AS od, 'S000' AS segpart, CASE l_returnflag WHEN 'A' THEN 'JT00' WHEN 'N' THEN 'JT01' ELSE 'JT02' END AS jobtype, '2010' AS year
FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def src_03(t):
    path = scratch_path(t.spark, "jobs")
    counts = t.lineitem.groupBy("l_returnflag", F.col("l_suppkey").alias("w_geocode")).agg(F.count(F.lit(1)).alias("C000"))
    for job, flag in (("JT00", "A"), ("JT01", "N"), ("JT02", "R")):
        counts.filter(F.col("l_returnflag") == flag).drop("l_returnflag").write.option("header", True).option(
            "compression", "gzip").csv(f"{path}/nc_wac_S000_{job}_2010.csv.gz")
    return sources.read_job_files(t.spark, path, "w_geocode string, C000 int")


@query("src_04", "SELECT s_suppkey, s_nationkey FROM supplier")
def src_04(t):
    return t.supplier.select("s_suppkey", "s_nationkey")


@query("src_05", "SELECT c_custkey, 'Café ' || c_name AS name FROM customer WHERE c_nationkey = 3")
def src_05(t):
    path = scratch_path(t.spark, "latin")
    t.customer.select("c_custkey", F.concat(F.lit("Café "), "c_name").alias("name"), "c_nationkey").write.option("header", True).option(
        "encoding", "ISO-8859-1").csv(path)
    return sources.read_delimited(t.spark, path, "c_custkey bigint, name string, c_nationkey int", "ISO-8859-1",
                                  F.col("c_nationkey") == 3, ["c_custkey", "name"])


@query("src_06", "SELECT s_suppkey AS fd_id, s_name AS name, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier")
def src_06(t):
    path = scratch_path(t.spark, "features")
    feature = F.struct(F.struct(F.lit("Point").alias("type"), F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double")).alias("coordinates")).alias("geometry"),
                       F.struct(F.col("s_suppkey").alias("fd_id"), F.col("s_name").alias("name")).alias("properties"))
    sets = t.supplier.groupBy(F.floor(F.col("s_suppkey") / CHUNK)).agg(F.collect_list(feature).alias("features"))
    sets.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))).write.text(path)
    read = sources.read_features(t.spark, path, "fd_id: bigint, name: string", collection_per_line=True)
    return read.select("fd_id", "name", "geometry.x", "geometry.y")


@query("src_07", "SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity AS y FROM lineitem")
def src_07(t):
    pts = t.lineitem.select("l_orderkey", "l_linenumber", geo.point(F.col("l_extendedprice"), F.col("l_quantity")).alias("p"))
    return pts.select("l_orderkey", "l_linenumber", "p.x", "p.y")


@query("src_08", """
SELECT p_partkey, p_partkey::DOUBLE AS x, p_size::DOUBLE AS y, 4 AS ring_size, (p_partkey + p_size)::DOUBLE AS max_x, (p_size * p_size)::DOUBLE AS area FROM part""")
def src_08(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    s_ = lambda c: c.cast("string")
    pt = geo.point_text(k, s)
    ring = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", F.concat_ws(" ", s_(k), F.lit("0")), F.concat_ws(" ", s_(k + s), F.lit("0")),
                    F.concat_ws(" ", s_(k + s), s_(s)), F.concat_ws(" ", s_(k), s_(s)), F.concat_ws(" ", s_(k), F.lit("0"))), F.lit("))"))
    parsed = t.part.select("p_partkey", geo.parse_point(pt).alias("p"), geo.parse_ring(ring).alias("r"))
    return parsed.select("p_partkey", "p.x", "p.y", F.size("r").alias("ring_size"), geo.ring_bounds(F.col("r"))["max_x"].alias("max_x"),
                         geo.ring_area(F.col("r")).alias("area"))


# A square with a square hole, and a second part beside it.
@query("src_08_parts", """
SELECT p_partkey, 3 AS n_rings, (p_partkey + 9 * p_size)::DOUBLE AS max_x, true AS in_part, false AS in_hole, true AS in_second, false AS between FROM part""")
def src_08_parts(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    square = lambda a, b: F.concat(F.lit("("), F.concat_ws(", ", *[
        F.concat_ws(" ", (k + s * p).cast("string"), (s * q).cast("string")) for p, q in ((a, a), (b, a), (b, b), (a, b), (a, a))]), F.lit(")"))
    text = F.concat(F.lit("MULTIPOLYGON (("), square(0, 6), F.lit(", "), square(2, 4), F.lit("), ("), square(7, 9), F.lit("))"))
    parsed = t.part.select("p_partkey", k.alias("k"), s.alias("s"), geo.parse_rings(text).alias("r"))
    corner = F.flatten(F.transform("r", lambda ring: F.transform(ring, lambda p: p["x"])))
    spots = {"in_part": 1, "in_hole": 3, "in_second": 8, "between": 6.5}
    held = [geo.inside_rings(F.col("r"), F.col("k") + F.col("s") * d, F.col("s") * F.lit(float(d))).alias(n) for n, d in spots.items()]
    return parsed.select("p_partkey", F.size("r").alias("n_rings"), F.array_max(corner).alias("max_x"), *held)


@query("src_09", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def src_09(t):
    path = scratch_path(t.spark, "saved")
    build = lambda: t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    sources.materialize(t.spark, build, path)
    return sources.materialize(t.spark, build, path)


@query("src_10", "SELECT o_orderkey, o_totalprice, o_orderstatus AS area FROM orders")
def src_10(t):
    path = scratch_path(t.spark, "areas")
    sources.write_areas(t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("area")), path, "area")
    return t.spark.read.parquet(path)


@query("src_11", """
SELECT s_suppkey::VARCHAR AS ncesid, s_name AS name, 'public' AS schtype, s_nationkey::VARCHAR AS cnty FROM supplier UNION ALL SELECT c_custkey::VARCHAR, c_name, 'private', NULL FROM customer""")
def src_11(t):
    return sources.load_listed(t.spark, [
        {"path": f"{t.folder}/supplier.parquet", "columns": {"s_suppkey": "ncesid", "s_name": "name", "s_nationkey": "cnty"}, "constants": {"schtype": "public"}},
        {"path": f"{t.folder}/customer.parquet", "columns": {"c_custkey": "ncesid", "c_name": "name"}, "constants": {"schtype": "private"}},
    ])


@query("src_12", """
WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS total FROM lineitem GROUP BY 1)
SELECT l_suppkey::VARCHAR AS "NCESSCH", CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE a END::INT AS a, n::INT AS n, r::INT AS r, (CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE a END + n + r)::INT AS row_total,
  (total - CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE a END - n - r)::INT AS difference, CASE WHEN l_suppkey % 5 = 0 AND a <> 0 THEN 1 ELSE 0 END AS discrepancy
FROM c JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 12""")
def src_12(t):
    path = scratch_path(t.spark, "schools")
    n = lambda f: F.count(F.when(F.col("l_returnflag") == f, 1)).cast("string")
    counts = t.lineitem.groupBy("l_suppkey").agg(n("A").alias("a"), n("N").alias("n"), n("R").alias("r"), F.count(F.lit(1)).alias("total"))
    raw = counts.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("b'"), F.col("l_suppkey").cast("string"), F.lit("'")).alias("NCESSCH"), F.col("s_nationkey").alias("CONUM"),
        F.when(F.col("l_suppkey") % 5 == 0, "-2").otherwise(F.concat(F.lit("b'"), "a", F.lit("'"))).alias("a"), "n", "r", "total")
    raw.write.option("header", True).csv(path)
    read = sources.read_delimited(t.spark, path, "NCESSCH string, CONUM int, a string, n string, r string, total string", where=F.col("CONUM") < 12)
    clean = read.withColumns({c: recode.clean_count(F.col(c)) for c in ("a", "n", "r", "total")})
    clean = clean.withColumn("NCESSCH", F.regexp_replace("NCESSCH", r"^b'|'$", ""))
    return recode.row_sum_check(clean, ["a", "n", "r"], "total").select("NCESSCH", "a", "n", "r", "row_total", "difference", "discrepancy")
