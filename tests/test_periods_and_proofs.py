"""Mart of several periods, ranks by ranges, and the certificate of a packing."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from driftcube.config import DIMENSIONS, AnomalyThresholds
from driftcube.operators import certificate, mart, packing
from driftcube.operators.ranks import with_rank
from driftcube.plans.engine import Analysis

SALES = "day long, amount long, order_id long, user_id long, merchant_id long, geo string, products string, brand string, is_terminal_or_cpqr string"


def sales():
    """A year of sales; one merchant in a third of the rows, ids that are missing, brands of equal amounts."""
    draw = random.Random(8)
    rows = []
    for i in range(900):
        merchant = 1 if i % 3 == 0 else draw.choice([2, 3, 4, None])
        rows.append((draw.randrange(366), 100 * draw.randint(1, 50), i // 3, draw.choice([*range(20), None]), merchant, draw.choice("ab"), draw.choice(["p", "q", "Unknown"]), f"b{draw.randrange(9)}", draw.choice("xy")))
    rows += [(d, 10_000_000, 5000 + d, 1, 1, "a", "p", b, "x") for d, b in [(0, "old"), (365, "now"), (200, "tie1"), (200, "tie2")]]
    return rows


def by_hand(rows, periods, windows=13, top=5):
    first, last = min(r[0] for r in rows), max(r[0] for r in rows)
    out = {}
    for period in periods:
        span = 7 * int(period[:-1])
        placed = [(last - span * ((last - r[0]) // span), (last - r[0]) // span, r) for r in rows]
        placed = [p for p in placed if p[1] < windows and p[0] - (span - 1) >= first]
        sums = {}
        for _, idx, r in placed:
            if idx >= 1:
                sums[r[7]] = sums.get(r[7], 0) + r[1]
        best = sorted(sums, key=lambda b: (-sums[b], b))[:top]
        cells = {}
        for date, _, r in placed:
            dims = (r[5], r[6], r[7] if r[7] in best else "Other", r[8])
            for keep in product((True, False), repeat=4):
                cells.setdefault((period, date, *(d if k else None for d, k in zip(dims, keep))), []).append(r)
        for key, held in cells.items():
            out[key] = (sum(r[1] for r in held) / 10_000, *(float(len({r[i] for r in held} - {None})) for i in (2, 3, 4)))
    return out


@pytest.mark.parametrize("most, few", [(mart.BROADCAST_VALUES, mart.LITERAL_VALUES), (mart.BROADCAST_VALUES, 3), (3, 3)])
def test_mart_of_several_periods(spark, monkeypatch, most, few):
    monkeypatch.setattr(mart, "BROADCAST_VALUES", most)  # numbers by the driver, in the plan or broadcast, and by ranges of the values
    monkeypatch.setattr(mart, "LITERAL_VALUES", few)
    rows = sales()
    df = spark.createDataFrame(rows, SALES).repartition(5)
    windowed = mart.complete_windows(df, ["1w", "4W", " 13W", "1W"])
    got = mart.cube(mart.bucketed(windowed))
    found = {(r["period"], r["cal_date"], *(r[d] for d in DIMENSIONS)): tuple(r[c] for c in ("gmv", "tx", "au", "am")) for r in got.collect()}
    assert found == by_hand(rows, ["1W", "4W", "13W"])
    assert len(found) == got.count()
    tops = {p: [r["brand"] for r in sorted(mart.top_brands(windowed).where(F.col("period") == p).collect(), key=lambda r: r["rank"])] for p in ("4W", "13W")}
    assert tops["13W"][:2] == ["tie1", "tie2"] and "now" not in tops["4W"] and "old" not in tops["4W"]


def test_mart_of_one_period_is_that_of_several(spark):
    df = spark.createDataFrame(sales(), SALES)
    several = mart.cube(mart.bucketed(mart.complete_windows(df, ["1W", "4W"]))).where("period = '4W'")
    one = mart.cube(mart.bucketed(mart.complete_windows(df, "4W")), "4W")
    assert one.columns == several.columns and one.exceptAll(several).count() == 0 == several.exceptAll(one).count()
    assert mart.cube(mart.bucketed(mart.complete_windows(df.limit(0), ["1W", "4W"]))).count() == 0


def test_null_values_of_dimensions(spark, monkeypatch):
    """A null value given to the cube is a value's place of its own, apart from what is rolled up, whichever way it is numbered."""
    df = spark.createDataFrame([(7, 10_000, 1, 1, 1, None, "p", "m", "x"), (7, 10_000, 2, 1, 1, "a", "p", "m", "x")], "cal_date long, amount long, order_id long, user_id long, merchant_id long, geo string, products string, merchants_type string, is_terminal_or_cpqr string")
    results = []
    for few in (64, 0):
        monkeypatch.setattr(mart, "LITERAL_VALUES", few)
        results.append(sorted(map(repr, mart.cube(df).collect())))
        assert len(results[-1]) == 24  # geo null, a or rolled up, times the 8 sets of the others
    assert results[0] == results[1]


def test_sales_are_read_once(spark):
    plan = mart.windowed_sales(spark, "/root/testdata/sf0.001", ["1W", "4W", "13W"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/lineitem.parquet") == 1 and plan.count("Generate explode") == 1


def test_ids_are_shuffled_unexpanded(spark):
    """Before the ids are dealt they are one row a window and atom; after that only counts move."""
    df = spark.createDataFrame(sales(), SALES)
    plan = mart.cube(mart.bucketed(mart.complete_windows(df, "4W")), "4W")._jdf.queryExecution().executedPlan().toString()
    ids = [line for line in plan.split("\n") if "Exchange" in line and " id#" in line.replace("(", " ").replace(",", " ")]
    assert ids and not any("combination" in line for line in ids)


def test_periods_of_an_analysis(spark):
    found = Analysis.of_periods(spark, "/root/testdata/sf0.001", ["4W", "13W"], AnomalyThresholds(min_anomaly_abs=0.0))
    alone = Analysis.of_sales(spark, "/root/testdata/sf0.001", "4W", AnomalyThresholds(min_anomaly_abs=0.0))
    assert found["4W"].dates == alone.dates and found["13W"].dates != alone.dates
    assert found["4W"].history.exceptAll(alone.history).count() == 0


def test_ranks_by_ranges(spark):
    draw = random.Random(1)
    rows = [(draw.randrange(40), None if i % 50 == 0 else draw.choice("abc"), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string, i int").repartition(7)
    got = with_rank(df, [F.col("a").desc(), F.col("b").asc_nulls_last(), "i"])
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or "", r[2]))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(*r, n) for n, r in enumerate(want, 1)]
    ties = with_rank(df, ["a"], "no").collect()  # of 40 values, which ranges must not cut
    assert sorted(r["no"] for r in ties) == list(range(1, 1001))
    firsts = {a: min(r["no"] for r in ties if r["a"] == a) for a in range(40)}
    assert firsts == {a: 1 + sum(r[0] < a for r in rows) for a in range(40)}
    assert with_rank(df.limit(0), ["a"]).collect() == []


def test_ranks_need_no_task_of_all_rows(spark):
    from driftcube.plans import queries

    a = queries.analysis(spark, "/root/testdata/sf0.001")
    for df in (packing.final(a.diagnosed), queries.structure_changes(spark, "/root/testdata/sf0.001"), queries.components(spark, "/root/testdata/sf0.001")):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in text


def packed(spark, chosen, scores, covers):
    rows = [("C001", s, float(x), s in chosen) for s, x in scores.items()]
    coverage = [(s, a) for s, atoms in covers.items() for a in atoms]
    return spark.createDataFrame(rows, "component_id string, segment_id string, anomaly_score double, selected boolean"), spark.createDataFrame(coverage, "segment_id string, atom_id string")


def test_certificate(spark):
    scores, covers = {"p": 10, "c1": 6, "c2": 6, "q": 4, "low": -1}, {"p": "abc", "c1": "a", "c2": "b", "q": "c", "low": "a"}
    best = certificate.price_bounds(*packed(spark, {"c1", "c2", "q"}, scores, covers)).first()
    assert (best["certified"], best["objective"], best["segment_count"]) == (True, 16.0, 5) and best["bound"] == pytest.approx(16)
    worse = certificate.price_bounds(*packed(spark, {"p"}, scores, covers)).first()
    assert not worse["certified"] and worse["bound"] >= 16
    part = certificate.price_bounds(*packed(spark, {"c1", "c2"}, scores, covers)).first()  # q is free
    assert not part["certified"] and part["bound"] >= 16
    with pytest.raises(ValueError, match="share the atom"):
        certificate.price_bounds(*packed(spark, {"p", "q"}, scores, covers))
    odd = certificate.price_bounds(*packed(spark, {"x"}, {"x": 1, "y": 1, "z": 1}, {"x": "ab", "y": "bc", "z": "ca"})).first()
    assert not odd["certified"] and odd["bound"] >= 1.5 - 1e-9  # the best there is, which no prices prove
    nothing = packed(spark, set(), {"x": 1}, {"x": "a"})
    assert certificate.price_bounds(nothing[0].limit(0), nothing[1]).count() == 0


def test_certificate_needs_uneven_splits(spark):
    """Random packings: certified only where a search by hand finds nothing better, and bounds never below it."""
    draw = random.Random(6)
    for _ in range(2):
        covers = {f"s{i}": {f"a{draw.randrange(9)}" for _ in range(draw.randint(1, 4))} for i in range(9)}
        scores = {s: draw.randint(1, 30) for s in covers}
        sets = [(0, frozenset())]
        for s in covers:
            sets += [(w + scores[s], c | {s}) for w, c in sets if not any(covers[s] & covers[x] for x in c)]
        most, best = max(sets, key=lambda x: x[0])
        for total, chosen in (max(sets, key=lambda x: x[0]), draw.choice(sets)):
            found = certificate.price_bounds(*packed(spark, chosen, scores, covers)).first()
            assert found["bound"] >= most - 1e-6 and (total == most or not found["certified"])


def test_planted_solution_is_refused(spark):
    from driftcube.plans import queries

    a = queries.analysis(spark, "/root/testdata/sf0.001")
    bounds = a.bounds.collect()
    assert all(r["certified"] for r in bounds) and sum(r["segment_count"] for r in bounds) == a.solved.count()
    assert sum(r["objective"] for r in bounds) == pytest.approx(sum(r["anomaly_score"] for r in a.final.select("anomaly_score").collect()))
    lost = a.final.orderBy("anomaly_score").first()["segment_id"]
    keep = F.col("selected") & (F.col("segment_id") != lost)
    lower = F.sum(F.when(keep, F.col("anomaly_score"))).over
    from pyspark.sql import Window

    forged = a.diagnosed.withColumns({"objective_value": lower(Window.partitionBy("component_id")), "selected": keep, "best_bound": lower(Window.partitionBy("component_id"))})
    forged = forged.withColumn("set_packing_status", F.when(F.col("segment_id") == lost, "SET_PACKING_NOT_SELECTED").otherwise(F.col("set_packing_status")))
    packing.validate(forged, a.coverage, thresholds=a.thresholds)  # its own figures agree
    with pytest.raises(ValueError, match="better set"):
        packing.validate(forged, a.coverage, thresholds=a.thresholds, bounds=packing.certified(forged, a.coverage, a.thresholds))


def stored(spark, path):
    return {(r["period"], r["cal_date"], *(r[d] for d in DIMENSIONS)): (r["gmv"], r["tx"], r["au"], r["am"]) for r in spark.read.parquet(path).collect()}


def test_refresh_of_the_mart(spark, tmp_path):
    path = str(tmp_path / "mart")
    rows = [(*r[:7], f"b{r[0] % 2}", r[8]) for r in sales()[:900]]  # two brands, so no window's buckets change
    first = [r for r in rows if r[0] < 366 - 28] + [(337, 1, 1, 1, 1, "a", "p", "b0", "x"), (0, 1, 1, 1, 1, "a", "p", "b0", "x")]
    later = [*first, *(r for r in rows if r[0] >= 366 - 28), (365, 1, 1, 1, 1, "a", "p", "b0", "x")]
    bucketed = lambda r: mart.bucketed(mart.complete_windows(spark.createDataFrame(r, SALES), "4W"))
    assert len(mart.refresh_mart(bucketed(first), path)) == 12
    assert mart.refresh_mart(bucketed(first[::-1]), path) == []  # the order of sales is nothing new
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "mart").glob("*/*/*.parquet")}
    assert mart.refresh_mart(bucketed(later), path) == [("4W", 365)]
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "mart").glob("*/*/*.parquet")}
    assert {p.parent.name for p in after.keys() - times.keys()} == {"cal_date=365"} and all(after[p] == times[p] for p in times)
    assert stored(spark, path) == by_hand(later, ["4W"])
    shorter = [r for r in later if r[0] >= 100] + [(100, 1, 1, 1, 1, "a", "p", "b0", "x")]  # windows that fall out, and one that changes
    mart.refresh_mart(bucketed(shorter), path)
    assert stored(spark, path) == by_hand(shorter, ["4W"])


def test_loader_reads_once_and_names_all_faults(spark, tmp_path):
    from test_engine import COLUMNS, change, history_rows, write_csv

    from driftcube.sources import history

    rows = change(change(change(history_rows(), "gmv", "bad", 4), "tx", "inf", 5), "geo", "A × b", 6)
    rows = change(rows, "slice_depth", 3, 7)
    with pytest.raises(ValueError) as error:
        history.load_history_table(spark, write_csv(tmp_path / "h.csv", rows), period="1W")
    for part in ("gmv.*bad", "tx.*inf", "separator", "slice_depth is not"):
        assert error.match(part)
    many = [change(history_rows(), "gmv", f"x{i}", 4)[4] for i in range(9)]
    with pytest.raises(ValueError, match="x0.*x1.*x2.*x3.*x4'\\]"):
        history.load_history_table(spark, write_csv(tmp_path / "i.csv", history_rows() + many), period="1W")
    bad = history_rows() + change(history_rows(), "cal_date", 30)[4:5] + history_rows()[5:6]
    with pytest.raises(ValueError, match="duplicate.*without a total"):
        history.load_history_table(spark, write_csv(tmp_path / "j.csv", bad), period="1W")
    path = write_csv(tmp_path / "once.csv", history_rows(), COLUMNS)
    loaded, _, _ = history.load_history_table(spark, path, period="1W")
    (tmp_path / "once.csv").unlink()
    assert loaded.count() == len(history_rows()) and "__bad" not in loaded.columns  # nothing reads the input again


def test_descendants_by_rarest_atom(spark):
    from driftcube.operators import coverage as cov

    draw = random.Random(2)
    covers = {f"s{i}": (draw.randint(1, 3), {f"a{draw.randrange(8)}" for _ in range(draw.randint(1, 5))}) for i in range(40)}
    eligible = spark.createDataFrame([(s, f"k{s}", d, a) for s, (d, atoms) in covers.items() for a in atoms], "segment_id string, segment_key string, slice_depth int, atom_id string")
    want = {(p, c) for p, (d, a) in covers.items() for c, (e, b) in covers.items() if e > d and b <= a}
    got = [tuple(r) for r in cov.descendants(eligible).collect()]
    assert set(got) == want and len(got) == len(want)
    assert cov.descendants(eligible.limit(0)).count() == 0


def test_groups_by_recursion(spark):
    """Groups of a parent against the search and against all subsets, and the guards."""
    from driftcube.operators import groups, solver

    draw = random.Random(12)
    covers = {"p": (1, {f"a{i}" for i in range(7)})} | {f"c{i}": (2, {f"a{draw.randrange(7)}" for _ in range(draw.randint(1, 3))}) for i in range(9)}
    scores = {s: float(draw.randint(1, 5)) for s in covers}  # with ties
    eligible = spark.createDataFrame([(s, f"k{s}", d, a) for s, (d, atoms) in covers.items() for a in atoms], "segment_id string, segment_key string, slice_depth int, atom_id string")
    given = spark.createDataFrame(list(scores.items()), "segment_id string, anomaly_score double")
    found = groups.disjoint_groups(eligible, given).collect()
    assert [r["segment_id"] for r in found] == ["p"]
    children = sorted(c for c in covers if c != "p")
    sets = [()]
    for c in children:
        sets += [(*s, c) for s in sets if not any(covers[c][1] & covers[x][1] for x in s)]
    best = min(sets[1:], key=lambda s: (-sum(scores[x] for x in s), len(s), s))
    r = found[0]
    assert (r["descendant_count"], r["group_count"], r["group_score"], r["group_ids"]) == (9, len(sets) - 1, sum(scores[x] for x in best), list(best))
    bits = [sum(1 << int(a[1:]) for a in covers[c][1]) for c in children]
    assert solver.count_disjoint(bits) == r["group_count"]
    with pytest.raises(ValueError, match="exceed max_hierarchy_descendants=8"):
        groups.disjoint_groups(eligible, given, 8)
    with pytest.raises(Exception, match="RECURSION_ROW_LIMIT"):
        groups.disjoint_groups(eligible, given, most_rows=10)
    assert groups.disjoint_groups(eligible.limit(0), given).count() == 0


def test_reports_that_do_not_fit_are_refused(spark, tmp_path, monkeypatch):
    from driftcube.plans import pipeline, queries

    a = queries.analysis(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(pipeline, "MOST_ROWS", 20)
    monkeypatch.setattr(pipeline, "MOST_BOXES", 20)
    for write, name in ((pipeline.write_report, "r.xlsx"), (pipeline.write_tree, "t.svg")):
        with pytest.raises(ValueError, match="write_tables"):
            write(a, tmp_path / name)
        assert not (tmp_path / name).exists()
