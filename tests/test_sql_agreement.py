"""A sample of the registered queries against their SQL on the smallest tables
(tools/check_oracle.py runs all of them)."""

import sys
from pathlib import Path

import duckdb
import pytest

from conftest import SF
from popweave.catalog import QUERIES, SQL

sys.path.insert(0, str(Path(__file__).parent.parent / "tools"))
from check_oracle import TABLES, rows_of  # noqa: E402

SAMPLE = ["entry_units_to_slots", "prj_02", "prj_06", "prj_26", "ag_04", "ag_06", "ag_07", "ag_10", "ag_12", "ag_20", "ag_28", "jn_07", "jn_08", "jn_08_modulo", "jn_10",
          "jn_11", "jn_14", "jn_16", "jn_18", "jn_23", "wn_03", "wn_05", "so_04", "fn_06", "fn_16", "ex_02", "pl_02", "pl_03", "pl_07", "pl_08", "pl_14", "pl_21", "pl_24", "pl_25", "pl_31", "src_02"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_sql(spark, con, key):
    names, got, _ = rows_of(QUERIES[key](spark, SF).toArrow())
    want_names, want, _ = rows_of(con.sql(SQL[key]).to_arrow_table())
    assert names == want_names and got == want and got
