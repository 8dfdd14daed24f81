"""The frontier against all subsets, and the analysis through it against the search."""

import random
from dataclasses import replace

import pytest

from driftcube.operators import frontier, packing

SEGMENTS = "component_id string, segment_id string, segment_key string, anomaly_score double"


def disjoint_sets(covers):
    sets = [()]
    for s in covers:
        sets += [(*c, s) for c in sets if not any(covers[s] & covers[x] for x in c)]
    return sets


def problems(n, seed):
    """``n`` components of 9 segments, with few different scores, so that many sets tie."""
    draw = random.Random(seed)
    for i in range(n):
        covers = {f"s{i:02}{j}": {f"a{i}-{draw.randrange(8)}" for _ in range(draw.randint(1, 4))} for j in range(9)}
        yield f"C{i:03}", covers, {s: float(draw.choice([1, 2, 2, 3, 5, 8])) for s in covers}


def tables(spark, given):
    rows = [(c, s, f"k{s}", x) for c, _, scores in given for s, x in scores.items()]
    return spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame([(s, a) for _, covers, _ in given for s, atoms in covers.items() for a in atoms], "segment_id string, atom_id string")


@pytest.mark.parametrize("width, step", [(4_000, 6), (2, 2)])
def test_frontier_against_all_subsets(spark, width, step):
    given = list(problems(12, 5))
    got = frontier.pack_frontier(*tables(spark, given), width=width, step=step).collect()
    assert len(got) == 12 * 9
    chosen = {r["segment_id"] for r in got if r["selected"]}
    for component, covers, scores in given:
        best = min(disjoint_sets(covers), key=lambda c: (-sum(scores[s] for s in c), len(c), sorted(c)))
        assert {s for s in covers if s in chosen} == set(best), component


def test_frontier_cases(spark, monkeypatch):
    odd = ("C001", {"x": {"a", "b"}, "y": {"b", "c"}, "z": {"c", "a"}}, {"x": 1.0, "y": 1.0, "z": 1.0})  # no prices prove it
    none = ("C002", {"n": {"d"}, "o": {"d"}, "p": {"d"}, "q": set()}, {"n": None, "o": -1.0, "p": 0.0, "q": 2.0})
    lone = ("C003", {"l": {"e"}}, {"l": 0.5})
    rows, coverage = tables(spark, [odd, none, lone])
    got = {r["segment_id"]: r["selected"] for r in frontier.pack_frontier(rows, coverage.union(coverage)).collect()}
    assert got == {"x": True, "y": False, "z": False, "n": False, "o": False, "p": False, "q": True, "l": True}
    assert frontier.pack_frontier(rows.limit(0), coverage).count() == 0
    monkeypatch.setattr(frontier, "PASSES", 0)
    with pytest.raises(RuntimeError, match="no optimum proven"):
        frontier.pack_frontier(rows, coverage)


def test_analysis_through_the_frontier(spark):
    """Components that no task holds whole: scores, groups and choice are those of the search."""
    from driftcube.plans import queries

    a = queries.analysis(spark, "/root/testdata/sf0.001")
    spread = packing.solve(a.candidates, a.coverage, replace(a.thresholds, max_group_size=1))
    assert spread.schema == a.solved.schema
    said = ("solver_name", "solve_time_sec", "best_bound", "objective_value", "absolute_gap", "relative_gap", "message")
    close = [f.name for f in a.solved.schema if f.dataType.typeName() == "double"]
    of = lambda df: {r["segment_id"]: r.asDict() for r in df.drop(*said).collect()}
    one, two = of(a.solved), of(spread)
    assert one.keys() == two.keys() and {r["solver_name"] for r in spread.collect()} <= {"FRONTIER", "TRIVIAL"}
    for s, row in one.items():
        for c, v in row.items():
            assert two[s][c] == (pytest.approx(v) if c in close and v is not None else v), (s, c)


def test_given_scores_through_the_frontier(spark):
    """The packing of given scores agrees with all subsets, and what it reports is accepted by the checks."""
    given = list(problems(2, 9))
    cells, coverage = tables(spark, given)
    rows = cells.selectExpr("segment_id", "segment_key", "1 as slice_depth", "true as passes_initial_anomaly_filter", "anomaly_score", "1.0D as wow_delta_gmv", "1.0D as abs_robust_z", "0.1D as materiality_share", "1.0D as reliability_factor")
    atoms = coverage.select("atom_id").distinct().selectExpr("atom_id as segment_id", "atom_id as segment_key", "2 as slice_depth", "false", "0.0D", "1.0D", "1.0D", "0.1D", "1.0D")
    own = coverage.select("atom_id").distinct().selectExpr("atom_id as segment_id", "atom_id")
    final, diagnosed, _ = packing.search_anomal(rows.union(atoms), replace(packing.AnomalyThresholds(), max_group_size=1), coverage.union(own), certify=True)
    want = set()
    for _, covers, scores in given:
        want |= set(min(disjoint_sets(covers), key=lambda c: (-sum(scores[s] for s in c), len(c), sorted(c))))
    assert {r["segment_id"] for r in final.collect()} == want
    assert {r[0] for r in diagnosed.where("is_eligible").select("set_packing_status").distinct().collect()} == {"SET_PACKING_SELECTED", "SET_PACKING_NOT_SELECTED"}
