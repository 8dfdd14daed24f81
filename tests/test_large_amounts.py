"""Amounts as large as those of tables of some GB, whose sums are beyond what doubles add up to 1e-4."""

import random
from pathlib import Path

import duckdb
import pytest

from driftcube.operators import coverage as cov
from driftcube.plans import oracle, queries

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Windows of sf0.01 add up to 1.1e8, those of 360 copies of sf0.1 to 4e11.
TIMES = 3_600


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """sf0.01 with all prices multiplied: scores do not change, sums grow."""
    folder = tmp_path_factory.mktemp("large")
    for t in TABLES[:-1]:
        (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duckdb.execute(f"COPY (SELECT * REPLACE (l_extendedprice * {TIMES} AS l_extendedprice) FROM '{SF}/lineitem.parquet') TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def tables(large):
    con = duckdb.connect(config={"max_temp_directory_size": "1GB"})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(large) / t}.parquet'")
    return con


def shown(v):
    if v is None or v != v:
        return None
    return f"{float(v) + 0.0:.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def listed(rows):
    return sorted(([shown(v) for v in row] for row in rows), key=repr)


def panel_of(spark, times):
    """Integer amounts, summed as such and divided once, as the mart does; a segment of some atoms, one of all."""
    draw = random.Random(4)
    atoms = [draw.randrange(10**9, 10**10) * times for _ in range(600)]
    rows = [("t", 0, sum(atoms)), ("p", 1, sum(atoms[:400])), *((f"a{i}", 2, x) for i, x in enumerate(atoms))]
    table = [("t", f"a{i}") for i in range(600)] + [("p", f"a{i}") for i in range(400)]
    make = lambda off: spark.createDataFrame([(i, d, 1, x / 10_000 + off.get(i, 0.0)) for i, d, x in rows], "segment_id string, slice_depth int, cal_date long, gmv double")
    return make, spark.createDataFrame(table, "segment_id string, atom_id string")


@pytest.mark.parametrize("times", [1, 1_001, 10**6 + 3, 10**9 + 7])
def test_sums_of_large_amounts_reconcile(spark, times):
    """Sums up to 3e17, where a double's neighbours are 64 apart; the rows in any order."""
    make, table = panel_of(spark, times)
    for parts in (1, 7):
        cov.check_reconciliation(make({}).repartition(parts), table.repartition(parts))


def test_small_faults_of_large_sums_are_found(spark):
    make, table = panel_of(spark, 1_001)  # sums of 3e11
    for segment in ("t", "p"):
        with pytest.raises(ValueError, match=f"segment {segment} on 1"):
            cov.check_reconciliation(make({segment: 0.001}), table)
    with pytest.raises(ValueError, match="segment p on 1"):
        cov.check_reconciliation(make({"a3": -0.001}), table)
    make, table = panel_of(spark, 1)
    with pytest.raises(ValueError, match="segment p on 1"):
        cov.check_reconciliation(make({"a3": 0.0002}), table)


def test_values_that_no_decimal_holds(spark):
    rows = [("p", 1, 1, 6e300), ("x", 2, 1, 2e300), ("y", 2, 1, 4e300), ("q", 1, 1, 1.0), *((f"z{i}", 2, 1, 1 / 3) for i in range(3))]
    schema = "segment_id string, slice_depth int, cal_date long, gmv double"
    table = spark.createDataFrame([("p", "x"), ("p", "y"), *(("q", f"z{i}") for i in range(3))], "segment_id string, atom_id string")
    cov.check_reconciliation(spark.createDataFrame(rows, schema), table, 0.0)
    with pytest.raises(ValueError, match="segment p on 1"):
        cov.check_reconciliation(spark.createDataFrame([("p", 1, 1, 6.1e300), *rows[1:]], schema), table)


def test_packing_bound(spark, large):
    rows = queries.packing_bound(spark, large)
    assert listed(rows.collect()) == listed(queries.packing_bound(spark, SF).select(*rows.columns).collect())
    assert rows.where("not certified").count() == 0


@pytest.mark.parametrize("name", ["packing_bound_strict", "final_ranked_strict", "hierarchy_adjust_strict", "component_stats_strict", "decision_log_strict"])
def test_queries_of_large_amounts_against_sql(spark, large, tables, name):
    got = queries.queries()[name](spark, large)
    want = tables.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert listed(got.select(*names).collect()) == listed(want.fetchall())
