"""The engine over small histories and candidate sets, with the results written out."""

import math

import pytest
from pyspark.sql import functions as F

import driftcube as dc
from driftcube.config import DIMENSIONS
from driftcube.functions import keys
from driftcube.operators import coverage as cov
from driftcube.operators import packing, panel, scoring, solver
from driftcube.operators import mart
from driftcube.plans import figure, oracle, queries, reports
from driftcube.sources import workbook
from driftcube.sources.history import load_history_table

T = dc.AnomalyThresholds
DATES = [1, 8, 15, 22]
COLUMNS = ["period", "cal_date", "slice_depth", *DIMENSIONS, "gmv", "tx", "au", "am", "aov", "tpm", "freq"]


def history_rows():
    row = lambda date, depth, geo, gmv: ["1W", date, depth, geo, None, None, None, gmv, 10.0, 5.0, 2.0, gmv / 10, 5.0, 2.0]
    rows = [row(d, 0, None, 1000.0) for d in DATES]
    rows += [row(d, 1, "A", g) for d, g in zip(DATES, (400.0, 400.0, 400.0, 800.0))]
    rows += [row(d, 1, "B", 600.0) for d in DATES[:3]]
    return [*rows, row(22, 1, "C", 200.0)]


def write_csv(path, rows, columns=COLUMNS):
    import csv

    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([columns, *([("" if v is None else v) for v in r] for r in rows)])
    return str(path)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    path = write_csv(tmp_path_factory.mktemp("in") / "history.CSV", [["string"] * len(COLUMNS), *history_rows()])
    return load_history_table(spark, path, period=" 1w ")


def test_load_grid_and_states(spark, loaded):
    history, dims, dates = loaded
    assert dims == list(DIMENSIONS) and dates == DATES
    grid = panel.full_grid(history, dates)
    assert grid.count() == 4 * 4
    b = grid.where("geo = 'B' and cal_date = 22").first()
    assert b["row_missing_in_source"] and b["gmv"] == 0 and b["tx"] == 0 and b["aov"] is None
    m = {r["geo"]: r for r in scoring.segment_metrics(grid, dates).collect()}
    assert m["B"]["state"] == "vanished" and m["C"]["state"] == "new" and m["A"]["state"] == "ordinary"
    assert m["C"]["robust_z"] == T().lifecycle_z_score and m["B"]["aov_wow_pct"] is None
    report = panel.missing_zero_report(grid, dates).collect()
    assert [(r["segment_key"], r["missing_week_count"]) for r in report] == [("geo=C", 3), ("geo=B", 1)]


def test_candidates_hold_their_panel_to_the_contract(spark, loaded):
    history, _, dates = loaded
    grid = panel.full_grid(history, dates)
    covers = spark.createDataFrame([(s, a) for a in ('["A",null,null,null]', '["B",null,null,null]', '["C",null,null,null]') for s in (a, "[null,null,null,null]")], "segment_id string, atom_id string")
    found = dc.build_anomaly_candidates(grid, dates, coverage=covers)
    assert found.count() == 4 == dc.build_anomaly_candidates(grid, dates).count()
    with pytest.raises(ValueError, match="total is not positive on .8"):
        dc.build_anomaly_candidates(grid.where("not (slice_depth = 0 and cal_date = 8)"), dates)
    with pytest.raises(ValueError, match="not the sum"):
        dc.build_anomaly_candidates(grid.withColumn("gmv", F.when(F.col("slice_depth") == 0, F.col("gmv") + 1).otherwise(F.col("gmv"))), dates)
    with pytest.raises(ValueError, match="differ between rows"):
        panel.full_grid(history.withColumn("segment_level", F.when(F.col("cal_date") == 8, "x").otherwise(F.col("segment_level"))), dates)


def test_public_names(spark):
    row = {"geo": " A ", "products": float("nan"), "merchants_type": None, "is_terminal_or_cpqr": "x|y"}
    df = spark.createDataFrame([(" A ", None, None, "x|y")], ", ".join(f"{d} string" for d in DIMENSIONS)).select(*(keys.clean_dimension(F.col(d)).alias(d) for d in DIMENSIONS))
    made = df.select(keys.segment_id(), keys.segment_key(), keys.segment_level()).first()
    assert (dc.segment_id_from_row(row), *dc.build_segment_key_and_level(row)) == tuple(made)
    assert dc.normalize_dim_value(" ") is None and dc.normalize_dim_value(3) == "3" and dc.period_to_weeks(" 4w ") == 4
    assert dc.candidate_covers_atomic({"geo": "A"}, row) and dc.candidate_covers_atomic({}, row) and not dc.candidate_covers_atomic({"products": "q"}, row)
    assert dc.infer_anomaly_dimension_columns(COLUMNS) == list(DIMENSIONS)
    with pytest.raises(ValueError, match="missing"):
        dc.infer_anomaly_dimension_columns(["geo"])
    assert all(hasattr(dc, n) for n in dc.__all__) and "operators" not in dc.__all__
    assert dc.highlight_manager_rows_on_anomaly_analysis(["segment", "manager_rank"], [["a", 1], ["b", None]]) == {0}


def test_number_formats(spark):
    df = spark.createDataFrame([(1234567.89, 0.1234), (-0.5, None), (2.5, float("nan")), (1e9, float("inf"))], "m double, p double")
    assert [tuple(r) for r in df.select(reports.money(F.col("m")), reports.percent(F.col("p"))).collect()] == [("1 234 568", "12.34%"), ("0", ""), ("2", ""), ("1 000 000 000", "")]


def change(rows, column, value, at=4):
    rows = [list(r) for r in rows]
    rows[at][COLUMNS.index(column)] = value
    return rows


BAD = [
    *((change(history_rows(), c, v), "not finite numbers") for c in ("cal_date", "slice_depth", "gmv", "tx", "au", "am") for v in ("bad", "", "nan", "inf", "-inf")),
    (history_rows() + history_rows()[4:5], "duplicate"),
    (change(history_rows(), "slice_depth", 2), "slice_depth"),
    ([], "no rows"),
    (change(history_rows(), "period", "1w"), "more than one spelling"),
    (history_rows() + change(history_rows(), "cal_date", 29)[4:5], "without a total"),
    ([r for r in history_rows() if r[1] != 8], "at least 4"),
    (change(history_rows(), "gmv", -1.0, 0), "not positive"),
    (change(history_rows(), "geo", "A × b"), "separator"),
]


@pytest.mark.parametrize("rows, message", BAD)
def test_load_refuses(spark, tmp_path, rows, message):
    with pytest.raises(ValueError, match=message):
        load_history_table(spark, write_csv(tmp_path / "h.csv", rows), period="1W")


def test_load_refuses_calendar_columns_and_names(spark, tmp_path):
    path = write_csv(tmp_path / "h.csv", [[("13W" if i == 0 else v) for i, v in enumerate(r)] for r in history_rows()])
    with pytest.raises(ValueError, match="expects 91"):
        load_history_table(spark, path, period="13W")
    with pytest.raises(ValueError, match="missing.*gmv"):
        load_history_table(spark, write_csv(tmp_path / "i.csv", [r[:7] for r in history_rows()], COLUMNS[:7]), period="1W")
    for bad in ("W", "0W", "1D", None):
        with pytest.raises(ValueError):
            load_history_table(spark, path, period=bad)
    with pytest.raises(ValueError, match="expected a"):
        load_history_table(spark, "h.json", period="1W")


def test_workbook_round_trip(spark, tmp_path):
    path = tmp_path / "h.xlsx"
    workbook.write(path, {"other": (["x"], []), "data & more": (COLUMNS, history_rows())}, {"data & more": {0}})
    history, _, dates = load_history_table(spark, str(path), "data & more", period="1W")
    assert dates == DATES and history.count() == len(history_rows())
    with pytest.raises(ValueError, match="no sheet"):
        workbook.read(path, "absent")
    columns, rows = workbook.read(path, 1)
    assert columns == COLUMNS and rows[0][0] == "1W" and rows[0][3] is None


def test_keys(spark):
    assert dc.parse_segment_key_parts("geo=РФ × products=QR") == [("geo", "РФ"), ("products", "QR")]
    assert dc.parse_segment_key_parts("ИТОГО") == [] == dc.parse_segment_key_parts("")
    assert dc.parse_segment_key_parts("geo=A=1") == [("geo", "A=1")]
    assert dc.parse_segment_key_parts("geo=A x B") == [("geo", "A x B")]
    for bad in ("geo=A × broken", "=РФ", "geo="):
        with pytest.raises(ValueError):
            dc.parse_segment_key_parts(bad)
    df = spark.createDataFrame([("a|b", None), (" \tx ", " "), (None, "∅")], "g string, p string")
    df = df.select(*(keys.clean_dimension(F.col(c)).alias(c) for c in "gp"))
    got = [tuple(r) for r in df.select(keys.segment_id("gp"), keys.segment_key("gp"), keys.depth("gp")).collect()]
    assert got == [('["a|b",null]', "g=a|b", 1), ('["x",null]', "g=x", 1), ('[null,"∅"]', "p=∅", 1)]
    parts = spark.createDataFrame([("geo=A=1 × products=Q",), ("ИТОГО",)], "k string").select(keys.key_parts(F.col("k"))).collect()
    assert [[tuple(p) for p in r[0]] for r in parts] == [[("geo", "A=1"), ("products", "Q")], []]


def one_segment(spark, series, **thresholds):
    rows = [("s", "geo=A", "geo", 1, "A", None, None, None, 7 * i, float(g), 0.0, 0.0, 0.0, None, None, None, False) for i, g in enumerate(series)]
    schema = "segment_id string, segment_key string, segment_level string, slice_depth int, geo string, products string, merchants_type string, is_terminal_or_cpqr string, cal_date long, gmv double, tx double, au double, am double, aov double, tpm double, freq double, row_missing_in_source boolean"
    return scoring.segment_metrics(spark.createDataFrame(rows, schema), [7 * i for i in range(len(series))], thresholds=T(**thresholds)).first()


def test_robust_z(spark):
    floor = one_segment(spark, [100, 100, 100, 100, 200])
    assert floor["robust_z"] > 6 and floor["z_scale_source"] == "SIGMA_FLOOR"
    assert one_segment(spark, [100, 110, 99, 118.8, 130])["z_scale_source"] == "MAD"
    assert one_segment(spark, [0, 0, 0, 10], lifecycle_z_score=7.0)["robust_z"] == 7
    new = one_segment(spark, [0, 0, 0, 500])
    assert new["state"] == "new" and new["history_nonzero_weeks"] == 0 and new["reliability_factor"] == 0.1
    with pytest.raises(ValueError, match="sigma_floor"):
        one_segment(spark, [1, 2], sigma_floor=0.0)


def frame(spark, rows, atoms_level=None):
    """rows: (id, depth, score, delta, passed)."""
    deepest = max(r[1] for r in rows) if atoms_level is None else atoms_level
    data = [(i, f"k={i}", d, d == deepest, p, float(s), float(delta), float(abs(s)), 1.0, 1.0) for i, d, s, delta, p in rows]
    return spark.createDataFrame(data, "segment_id string, segment_key string, slice_depth int, is_atom boolean, passes_initial_anomaly_filter boolean, base_anomaly_score double, wow_delta_gmv double, abs_robust_z double, materiality_share double, reliability_factor double")


def solved(spark, rows, covers, **t):
    table = spark.createDataFrame([(s, a) for s, atoms in covers.items() for a in atoms], "segment_id string, atom_id string")
    return {r["segment_id"]: r for r in packing.solve(frame(spark, rows), table, T(**t)).collect()}


def test_children_beat_parent(spark):
    got = solved(spark, [("p", 1, 10, 1000, True), ("c1", 2, 6, 600, True), ("c2", 2, 6, 600, True), ("q", 2, 4, 400, True)], {"p": ["c1", "c2"], "c1": ["c1"], "c2": ["c2"], "q": ["q"]})
    assert {k for k, r in got.items() if r["selected"]} == {"c1", "c2", "q"}
    p = got["p"]
    assert p["hierarchy_group_count"] == 3 and p["hierarchy_best_group_ids"] == ["c1", "c2"] and p["hierarchy_factor"] == pytest.approx(1.15)
    assert got["q"]["component_id"] != p["component_id"] and got["q"]["solver_name"] == "TRIVIAL"


def test_mixed_depths(spark):
    rows = [("p", 1, 20, 1000, True), ("product_a", 2, 6, 400, True), ("product_b", 2, 5, 400, True), ("merchant_x", 2, 8, 600, True), ("a2", 3, 4, 200, True), ("a4", 3, 3, 200, True), ("a1", 3, 1, 200, False), ("a3", 3, 1, 200, False)]
    covers = {"p": ["a1", "a2", "a3", "a4"], "product_a": ["a1", "a2"], "product_b": ["a3", "a4"], "merchant_x": ["a1", "a3"], **{a: [a] for a in ("a1", "a2", "a3", "a4")}}
    p = solved(spark, rows, covers)["p"]
    assert (p["hierarchy_group_count"], p["hierarchy_best_group_ids"], p["hierarchy_best_group_score"]) == (12, ["a2", "a4", "merchant_x"], 15)
    assert p["hierarchy_unidirectionality"] == 1 and p["hierarchy_balance_max"] == pytest.approx(0.6) and p["hierarchy_balance_eff"] == pytest.approx(7 / 11)
    assert p["hierarchy_factor"] == pytest.approx(1.03) and p["anomaly_score"] == pytest.approx(20.6) and p["selected"]


@pytest.mark.parametrize("other, sign, capture, factor, score, applied, winner", [(10000, 1, 800 / 10800, 0.85, 8.5, False, "p"), (200, 1, 0.8, 0.784, 7.84, True, "c"), (200, -1, 0.8, 0.85, 8.5, False, "p")])
def test_single_child(spark, other, sign, capture, factor, score, applied, winner):
    rows = [("p", 1, 10, 1000, True), ("c", 2, 8, sign * 800, True), ("f", 2, 1, other, False)]
    got = solved(spark, rows, {"p": ["c", "f"], "c": ["c"], "f": ["f"]})
    p = got["p"]
    assert p["hierarchy_capture"] == pytest.approx(capture) and p["hierarchy_factor"] == pytest.approx(factor) and p["anomaly_score"] == pytest.approx(score)
    assert p["hierarchy_cap_applied"] == applied and got[winner]["selected"]


@pytest.mark.parametrize("deltas, factor", [((12e6, 7.8e6, 0.2e6), None), ((500, -500), 0.85)])
def test_coherence(spark, deltas, factor):
    names = [f"c{i}" for i in range(len(deltas))]
    rows = [("p", 1, 12, sum(map(abs, deltas)), True), *((n, 2, 6, d, True) for n, d in zip(names, deltas))]
    p = solved(spark, rows, {"p": names, **{n: [n] for n in names}})["p"]
    if factor is None:
        effective = (1 / 0.5122 - 1) / 2
        assert p["hierarchy_balance_max"] == pytest.approx(0.6) and p["hierarchy_balance_eff"] == pytest.approx(effective)
        factor = 1 + 0.3 * (effective - 0.5)
    assert p["hierarchy_factor"] == pytest.approx(factor)


def test_range_of_scores_guard_and_no_candidates(spark):
    got = solved(spark, [("p", 1, 1e-6, 1, True), ("a", 2, 1e6, 1, True)], {"p": ["a"], "a": ["a"]})
    assert got["a"]["selected"] and not got["p"]["selected"]
    assert solver.count_disjoint([1 << i for i in range(10)]) == 2**10 - 1
    rows = [("p", 1, 5, 11, True), *((f"c{i:02}", 2, 1, 1, True) for i in range(11))]
    with pytest.raises(Exception, match="exceed max_hierarchy_descendants=10"):
        solved(spark, rows, {"p": [r[0] for r in rows[1:]], **{r[0]: [r[0]] for r in rows[1:]}}, max_hierarchy_descendants=10)
    table = spark.createDataFrame([("p", "p")], "segment_id string, atom_id string")
    nothing = frame(spark, [("p", 1, 1, 1, False)])
    none = packing.diagnostics(nothing, table, packing.solve(nothing, table))
    assert packing.final(none).count() == 0
    log = packing.decision_log(none, table).collect()
    assert [r["event_type"] for r in log] == ["GLOBAL_OPTIMIZATION_SUMMARY"] and log[0]["global_status"] == "EMPTY"


def test_solver_against_brute_force():
    import random
    from itertools import combinations

    draw = random.Random(4)
    for _ in range(150):
        n = draw.randint(1, 9)
        bits = [draw.randint(1, 63) for _ in range(n)]
        scores = [float(draw.choice([1, 2, 2, 3, 5])) for _ in range(n)]
        sets = [c for k in range(1, n + 1) for c in combinations(range(n), k) if all(not bits[a] & bits[b] for a, b in combinations(c, 2))]
        assert solver.count_disjoint(bits) == len(sets)
        want = min(sets, key=lambda c: (-sum(scores[i] for i in c), len(c), sorted(c)))
        assert tuple(sorted(solver.best_disjoint(bits, scores, list(range(n)), 10**6))) == want
    for _ in range(60):  # large enough for the price bounds
        n = draw.randint(13, 16)
        bits = [draw.randint(1, 255) for _ in range(n)]
        scores = [float(draw.choice([1, 2, 2, 3, 5])) for _ in range(n)]
        sets = [c for k in range(1, 9) for c in combinations(range(n), k) if all(not bits[a] & bits[b] for a, b in combinations(c, 2))]
        want = min(sets, key=lambda c: (-sum(scores[i] for i in c), len(c), sorted(c)))
        assert solver.count_disjoint(bits) == len(sets)
        assert tuple(sorted(solver.best_disjoint(bits, scores, list(range(n)), 10**6))) == want
        price = solver.atom_prices(bits, scores)
        above = sum(max(0.0, s - sum(p for a, p in price.items() if a & b)) for b, s in zip(bits, scores))
        assert sum(price.values()) + above >= sum(scores[i] for i in want) - 1e-9 and min(price.values()) >= 0
    with pytest.raises(solver.SearchExhausted):
        solver.best_disjoint([3 << i for i in range(12)], [1.0] * 12, list(range(12)), 3)


def test_reconciliation(spark, loaded):
    depth = {"t": 0, "p": 1, "x": 2, "y": 2}
    rows = [(i, d, g) for d, values in ((1, {"t": 30.0, "p": 30.0, "x": 10.0, "y": 20.0}), (8, {"t": 35.0, "p": 35.0, "x": 15.0, "y": 20.0})) for i, g in values.items()]
    table = spark.createDataFrame([(s, a) for s in "tp" for a in "xy"] + [("x", "x"), ("y", "y")], "segment_id string, atom_id string")
    grid = lambda r: spark.createDataFrame([(i, depth[i], d, g) for i, d, g in r], "segment_id string, slice_depth int, cal_date long, gmv double")
    cov.check_reconciliation(grid(rows), table)
    broken = [(i, d, g + (0.001 if (i, d) == ("p", 8) else 0)) for i, d, g in rows]
    with pytest.raises(ValueError, match="segment p on 8"):
        cov.check_reconciliation(grid(broken), table)
    with pytest.raises(ValueError, match="no segment"):
        cov.check_reconciliation(grid(rows), table.limit(0))
    with pytest.raises(ValueError, match="segment p on 1"):  # a parent without atoms
        cov.check_reconciliation(grid(rows), table.where("segment_id <> 'p'"))
    with pytest.raises(ValueError, match="segment p on 1"):  # an atom that is not in the panel
        cov.check_reconciliation(grid(rows), table.union(spark.createDataFrame([("p", "z")], table.schema)))
    with pytest.raises(ValueError, match="more than once"):
        cov.check_reconciliation(grid([*rows, rows[0]]), table)
    for value in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite"):
            cov.check_reconciliation(grid([*rows[1:], (*rows[0][:2], value)]), table)
    for tolerance in (float("nan"), -1.0, float("inf")):
        with pytest.raises(ValueError, match="tolerance"):
            cov.check_reconciliation(grid(rows), table, tolerance)
    with pytest.raises(ValueError, match="empty"):
        cov.check_reconciliation(grid(rows).limit(0), table)


def test_pipeline_end_to_end(spark, tmp_path):
    path = write_csv(tmp_path / "h.csv", history_rows())
    loose = T(min_anomaly_abs=0.0, min_z_score=0.0, min_materiality_share=0.0)
    path2 = write_csv(tmp_path / "g.csv", [r for r in history_rows()])
    results = dc.run_pipeline(spark, path2, str(tmp_path / "report.xlsx"), str(tmp_path / "tree.svg"), period="1W", thresholds=loose)
    assert list(results) == ["history", "panel", "candidates", "final", "manager", "optimization_decision_log", "control"]
    del path
    names = [workbook.read(tmp_path / "report.xlsx", i)[0] for i in range(9)]
    assert names[0] == ["section", "metric", "value"] and names[2][:3] == ["rank", "output_block", "segment_key"] and names[7] == ["metric", "value", "text"]
    assert names[3] == list(reports.ANALYSIS_COLUMNS) and len(names[3]) == 47 and set(names[2]) == set(reports.FINAL_COLUMNS)
    control = {r["metric"]: r["value"] if r["text"] is None else r["text"] for r in results["control"].collect()}
    assert len(control) == 20 and control["set_packing_global_status"] == "OPTIMAL"
    manager = workbook.read(tmp_path / "report.xlsx", "01_manager")[1]
    assert manager[0][-1] == "total GMV of the current window: 1 000" and manager[1][-1].startswith("GMV of the segment went")
    again = dc.build_anomaly_tree_from_excel(tmp_path / "report.xlsx", tmp_path / "again.svg")
    assert again.read_text() == (tmp_path / "tree.svg").read_text()
    assert control["selected_count"] == 3 and control["double_count_violation_count"] == 0 and control["panel_rows"] == 16
    assert "<svg" in (tmp_path / "tree.svg").read_text()


def test_figure():
    assert figure.dominant_child_suffix("business=SMB × payment=QR", "business=SMB × payment=QR × country=РФ × product=FULL") == "РФ*FULL"
    assert figure.wrapped("РФ*FULLPAYMENT", 8) == ["РФ*FULLP", "AYMENT"]
    siblings = [figure.Box(f"g={g}", 1, 1, 1, 1) for g in "ab"] + [figure.Box(f"g={g} × p={i}", 2, 1, 1, 1) for i in range(3) for g in "ab"]
    bottom = figure.layers(siblings, figure.edges(siblings))[1]
    assert [s[2] for s in bottom] in (list("aaabbb"), list("bbbaaa"))  # a parent's children stand side by side
    boxes = [figure.Box("geo=A", 1, 3, 1, 1, crossed=True), figure.Box("products=B", 1, 3, 1, 1, crossed=True), figure.Box("geo=A × products=B", 2, 3, 1, 1, selected=True), figure.Box("nan", 1, 0, 0, 0)]
    drawing = figure.svg(boxes)
    assert drawing.count(f'stroke="{figure.CROSS}"') == 4
    assert figure.edges(boxes[:3]) == [("geo=A", "geo=A × products=B"), ("products=B", "geo=A × products=B")]
    assert math.isclose(figure.PORTS, 0.72)
    with pytest.raises(ValueError):
        figure.write("x.png", boxes)


def test_search_with_given_scores(spark):
    rows = [("p", 1, 10, 1000, True), ("a", 2, 6, 600, True), ("b", 2, 3, 400, True)]
    base = frame(spark, rows).withColumnRenamed("base_anomaly_score", "anomaly_score")
    table = spark.createDataFrame([("p", "a"), ("p", "b"), ("a", "a"), ("b", "b")], "segment_id string, atom_id string")
    final, diagnosed, log = dc.search_anomal(base, coverage=table)
    assert [r["segment_id"] for r in final.collect()] == ["p"] and diagnosed.count() == 3
    assert {r["event_type"] for r in log.collect()} == {"GLOBAL_OPTIMIZATION_SUMMARY", "ATOM_TO_SEGMENTS", "CONFLICT_PAIR", "COMPONENT_SOLVE", "SEGMENT_DECISION"}
    with pytest.raises(ValueError, match="required"):
        dc.search_anomal(base)
    with pytest.raises(ValueError, match="missing"):
        dc.search_anomal(base.drop("anomaly_score"), coverage=table)
    with pytest.raises(ValueError, match="positive score"):
        dc.search_anomal(base.withColumn("anomaly_score", F.lit(0.0)), coverage=table)
    extra = lambda s, a: table.union(spark.createDataFrame([(s, a)], table.schema))
    for bad, message in ((extra("x", "a"), "unknown segments"), (extra("p", "x"), "unknown atoms"), (extra("p", "a"), "repeated"), (extra("p", " "), "blank"), (extra("a", "b"), "cover others"), (table.where("segment_id <> 'b'"), "no coverage")):
        with pytest.raises(ValueError, match=message):
            dc.search_anomal(base, coverage=bad)
    keyed = base.withColumn("segment_key", F.when(F.col("segment_id") == "p", "geo=A").otherwise(F.concat(F.lit("geo=A × products="), "segment_id")))
    final, diagnosed, _ = dc.search_anomal(keyed, allow_segment_key_fallback=True)
    assert {r["segment_id"] for r in final.collect()} == {"p"} and diagnosed.first()["atomic_coverage_source"] == "SEGMENT_KEY_FALLBACK"


def test_command_line(spark, tmp_path, capsys):
    from driftcube.__main__ import main

    main([write_csv(tmp_path / "h.csv", history_rows()), "--report", str(tmp_path / "r.xlsx")])
    assert "candidate_count: 4" in capsys.readouterr().out and (tmp_path / "r.xlsx").exists()


def test_solution_checks(spark):
    """Each fault that a solution may have is refused."""
    rows = [("p", 1, 10, 1000, True), ("a", 2, 6, 600, True), ("b", 2, 3, 400, True)]
    table = spark.createDataFrame([("p", "a"), ("p", "b"), ("a", "a"), ("b", "b")], "segment_id string, atom_id string")
    base = frame(spark, rows)
    solved = packing.solve(base, table)
    found = packing.diagnostics(base, table, solved).cache()
    best = packing.final(found)
    packing.validate(found, table, solved, best)
    row = {r["segment_id"]: r for r in found.collect()}
    assert row["p"]["set_packing_global_status"] == "OPTIMAL" and row["p"]["variable_count"] == 3 and row["p"]["constraint_count"] == 2 and row["p"]["set_packing_component_atom_count"] == 2
    assert "solver BRANCH_AND_BOUND" in row["p"]["set_packing_reason"] and row["p"]["absolute_gap"] == 0
    wider = found.withColumn("objective_value", F.col("objective_value") + 1)
    for bad, message in (
        (wider, "sum of their scores"),
        (found.withColumn("relative_gap", F.lit(0.5)).withColumn("absolute_gap", F.lit(0.5)), "not proven"),
        (found.withColumn("selected", F.lit(True)), "atoms selected twice"),
        (found.withColumn("is_resolved", F.lit(False)), "unresolved"),
        (found.withColumn("set_packing_global_status", F.lit("NOT_OPTIMAL")), "globally"),
        (found.withColumn("covered_atomic_count", F.lit(0)), "without coverage"),
        (found.unionByName(found), "repeated ids"),
    ):
        with pytest.raises(ValueError, match=message):
            packing.validate(bad, table)
    with pytest.raises(ValueError, match="did not choose"):
        packing.validate(found, table, solved, found)
    with pytest.raises(ValueError, match="not final"):
        packing.validate(found, table, solved, best.limit(0))
    pair = frame(spark, [("x", 2, 5, 100, True), ("y", 2, 5, 0, True)])
    with pytest.raises(Exception, match="needs a finite base score and a change"):  # in a component of several
        packing.solve(pair, spark.createDataFrame([("x", "x"), ("y", "x"), ("y", "y")], table.schema)).collect()
    for delta, score in ((0, 5), (float("nan"), 5), (100, float("inf"))):
        with pytest.raises(Exception, match="needs a finite base score and a change"):
            solved_rows = frame(spark, [("x", 1, score, delta, True)])
            packing.solve(solved_rows, spark.createDataFrame([("x", "x")], table.schema)).collect()
    assert solver.constraint_rows([3, 1, 2, 4]) == [[0, 1], [0, 2]]


def test_components_of_any_shape(spark):
    """Long chains and stars of segments against a search by hand."""
    links = [(f"c{i:03}", f"x{i}") for i in range(40)] + [(f"c{i:03}", f"x{i + 1}") for i in range(40)] + [(f"s{i}", "hub") for i in range(30)] + [("alone", "own")]
    eligible = spark.createDataFrame([(f"id-{s}", a, s, 1) for s, a in links], "segment_id string, atom_id string, segment_key string, slice_depth int")
    got = {r["segment_id"]: r["component_id"] for r in cov.components(eligible).collect()}
    assert got["id-alone"] == "C001" and {got[f"id-c{i:03}"] for i in range(40)} == {"C002"} and {got[f"id-s{i}"] for i in range(30)} == {"C003"}


def test_unknown_dimensions(spark):
    """Null and blank values are a value of their own and never meet what is rolled up."""
    rows = spark.createDataFrame([(1, "a", None), (2, " ", "x"), (3, "a", "x")], "id int, geo string, products string")
    known = rows.select("id", *(mart._known(c).alias(c) for c in ("geo", "products")))
    assert [tuple(r) for r in known.orderBy("id").collect()] == [(1, "a", "Unknown"), (2, "Unknown", "x"), (3, "a", "x")]
    sales = known.selectExpr("7L as cal_date", "geo", "products", "'m' as merchants_type", "'t' as is_terminal_or_cpqr", "cast(id * 10000 as long) as amount", "id as order_id", "id as user_id", "id as merchant_id")
    cube = mart.with_segment(mart.cube(sales))
    assert cube.groupBy("segment_id", "cal_date").count().where("count > 1").count() == 0
    assert cube.where("geo is null and products is null and merchants_type is null and is_terminal_or_cpqr is null").first()["gmv"] == 6


def test_mart_is_replaced(spark, loaded, tmp_path):
    history = loaded[0]
    for rows in (history, history.where("geo is null")):
        mart.save_mart(rows, str(tmp_path / "mart"))
        assert spark.read.parquet(str(tmp_path / "mart")).count() == rows.count()
    assert (tmp_path / "mart" / "cal_date=22").exists()


def test_windows_reach_the_scan(spark):
    rows = mart.windowed_sales(spark, "/root/testdata/sf0.001", windows=2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/lineitem.parquet") == 1 and "GreaterThanOrEqual(l_shipdate" in plan
    days = mart.sales_days(spark, "/root/testdata/sf0.001")
    whole = mart.complete_windows(mart.transactions(spark, "/root/testdata/sf0.001"), windows=2, days=days)
    assert rows.count() == whole.count() == mart.complete_windows(mart.transactions(spark, "/root/testdata/sf0.001"), windows=2).count() > 0


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect(config={"max_temp_directory_size": "1GB"})
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_against_sql(spark, tables, name):
    """Every registered query of the engine and its SQL, value by value."""
    got = queries.queries()[name](spark, SF)
    if name not in oracle.oracle_sql():
        assert name in ("final_ranked", "packing_bound", "packing_frontier") and got.count() > 0  # see test_full_solution, test_planted_solution_is_refused and tests/test_frontier.py
        return
    want = tables.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)

    def shown(v):
        if v is None or v != v:
            return None
        return f"{float(v) + 0.0:.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    listed = lambda rows: sorted(([shown(v) for v in row] for row in rows), key=repr)
    assert listed(got.select(*names).collect()) == listed(want.fetchall())


def test_full_solution(spark):
    """The default z and materiality: every component proven, the largest far beyond enumeration, and no single exchange improves it."""
    a = queries.analysis(spark, SF)
    rows = {r["segment_id"]: r for r in a.diagnosed.where("is_eligible").collect()}
    atoms = {}
    for r in a.eligible.collect():
        atoms.setdefault(r["segment_id"], set()).add(r["atom_id"])
    sizes = [r["segment_count"] for r in packing.component_stats(a.diagnosed, a.coverage).collect()]
    assert len(rows) == 247 and max(sizes) == 226 and a.final.count() > 0
    chosen = {i for i, r in rows.items() if r["selected"]}
    covered = [x for i in chosen for x in atoms[i]]
    assert len(covered) == len(set(covered))
    for i in rows.keys() - chosen:  # no segment is worth more than all it would drive out
        against = sum(rows[j]["anomaly_score"] for j in chosen if atoms[i] & atoms[j])
        assert rows[i]["anomaly_score"] <= against + 1e-9
