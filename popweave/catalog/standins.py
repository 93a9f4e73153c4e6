"""How the reference notions are acted out on the given tables.

customer = housing unit, nation = block, region = tract, orders = address
slots, part = building, lineitem = job rows, supplier = establishment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.operators.ranks import value_rank


def case_sql(expr: str, table: dict, otherwise: str = "NULL") -> str:
    """CASE text for a code table."""
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {expr} = {quote(k)} THEN {quote(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def band_sql(expr: str, bands, otherwise: str = "NULL") -> str:
    """CASE text for a band table; later bands are tested first."""
    return "CASE " + " ".join(f"WHEN {expr} BETWEEN {lo} AND {hi} THEN {c}" for c, lo, hi in reversed(bands)) + f" ELSE {otherwise} END"


def u_sql(key: str, seed) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {key}, {seed})), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


def units(t) -> DataFrame:
    """customer with its block and tract."""
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", F.col("c_nationkey").alias("block"), F.col("n_regionkey").alias("tract"),
        "c_acctbal", "c_mktsegment")


UNITS_SQL = """units AS (SELECT c_custkey, c_name, c_nationkey AS block, n_regionkey AS tract, c_acctbal, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def slots(t) -> DataFrame:
    """orders in the block of their customer."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("block"), "o_orderstatus", "o_totalprice", "o_orderpriority")


SLOTS_SQL = """slots AS (SELECT o_orderkey, c_nationkey AS block, o_orderstatus, o_totalprice, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def spot(key: Column, salt: int, size: float = 20.0) -> Column:
    """A fixed pseudo-random coordinate in [0, size) for an integer key, on a
    grid of 1/1024 so that arithmetic on it is exact."""
    return F.floor(((key * salt + salt * 7) % 1009) * F.lit(size * 1024 / 1009)).cast("double") / 1024


def spot_sql(key: str, salt: int, size: float = 20.0) -> str:
    return f"(floor((({key} * {salt} + {salt * 7}) % 1009) * {size * 1024 / 1009!r}::DOUBLE) / 1024)"


_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINE_REST = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lines(t, ids_only: bool = False, meet: str = _LINE_KEYS[0]) -> DataFrame:
    """lineitem with a key: its four ids and, where they repeat, the number of the repeat.

    With ``ids_only`` there are no other columns; then it does not matter which of the rows of the same ids
    gets which number, and the columns that decide it stay where they are.  Rows meet by the id ``meet``, where
    a join by that id wants them.
    """
    rows = t.lineitem.select(*_LINE_KEYS) if ids_only else t.lineitem
    order = (_LINE_KEYS[0], ()) if ids_only else ("l_extendedprice", _LINE_REST)
    numbered = value_rank(rows, _LINE_KEYS, *order, "_nth", near=[meet])
    parts = [*_LINE_KEYS, F.when(F.col("_nth") > 1, F.col("_nth"))]
    return numbered.withColumn("line_key", F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in parts])).drop("_nth")


LINES_SQL = f"""(SELECT *, concat_ws('|', {', '.join(_LINE_KEYS)}, CASE WHEN nth > 1 THEN nth END) AS line_key FROM (
  SELECT *, row_number() OVER (PARTITION BY {', '.join(_LINE_KEYS)} ORDER BY l_extendedprice, {', '.join(_LINE_REST)}) AS nth FROM lineitem))"""


def money(c) -> Column:
    """Exact sums of two-decimal amounts."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def cascade_sql(p_cte: str, p_pk: str, s_cte: str, s_pk: str, rounds: list, seed: int, p_sort: str = "", s_sort: str = "",
                prefix: str = "", first: int = 1) -> tuple[str, str]:
    """SQL of a merge cascade with plain windows: (CTE text, union of pairs).

    ``rounds`` lists (primary key expressions, secondary key expressions).
    """
    x, ctes, pairs = prefix, [], []
    p_now, s_now = p_cte, s_cte
    for i, (pk, sk) in enumerate(rounds, 1):
        def ranked(src, key, exprs, sort):
            cols = "".join(f", {e} AS g{j}" for j, e in enumerate(exprs))
            part = ("PARTITION BY " + ", ".join(exprs)) if exprs else ""
            ready = " AND ".join(f"({e}) IS NOT NULL" for e in exprs) or "true"
            return (f"(SELECT {key}{cols}, row_number() OVER ({part} ORDER BY {sort + ', ' if sort else ''}"
                    f"md5(concat_ws('|', {key}, {seed + first - 1 + i})), {key}) AS rk FROM {src} WHERE {ready})")
        on = " AND ".join([f"a.g{j} = b.g{j}" for j in range(len(pk))] + ["a.rk = b.rk"])
        ctes.append(f"{x}m{i} AS MATERIALIZED (SELECT {p_pk}, {s_pk}, {first - 1 + i} AS match_round FROM {ranked(p_now, p_pk, pk, p_sort)} a JOIN {ranked(s_now, s_pk, sk, s_sort)} b ON {on})")
        for side, now, key in (("p", p_now, p_pk), ("s", s_now, s_pk)):
            ctes.append(f"{x}{side}{i} AS MATERIALIZED (SELECT * FROM {now} WHERE NOT EXISTS (SELECT 1 FROM {x}m{i} WHERE {x}m{i}.{key} = {now}.{key}))")
        pairs.append(f"SELECT * FROM {x}m{i}")
        p_now, s_now = f"{x}p{i}", f"{x}s{i}"
    return ",\n".join(ctes), " UNION ALL ".join(pairs)
