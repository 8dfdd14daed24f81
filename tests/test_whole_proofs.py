"""Proofs of packings that take many rounds of prices, or that no prices give."""

import logging

import pytest

from driftcube.operators import certificate, frontier, packing

ROWS = "component_id string, segment_id string, segment_key string, anomaly_score double, selected boolean"


def problem(spark, *components):
    """Tables of (name, atoms by segment, scores, chosen)."""
    rows = [(c, s, f"k{s}", float(x), s in chosen) for c, _, scores, chosen in components for s, x in scores.items()]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame([(s, f"{c}-{a}") for c, covers, _, _ in components for s, atoms in covers.items() for a in atoms], "segment_id string, atom_id string")


def test_prices_are_moved_until_they_prove(spark):
    """A packing whose gap falls by a tenth or so in a round of Polyak's plain step, so that 40 rounds left it unproven."""
    covers = {"s0": "1256", "s1": "16", "s2": "0126", "s3": "0146", "s4": "12", "s5": "5", "s6": "016"}
    scores = {"s0": 30, "s1": 9, "s2": 20, "s3": 14, "s4": 22, "s5": 5, "s6": 21}
    best = certificate.price_bounds(*problem(spark, ("C", covers, scores, {"s0"}))).first()
    assert (best["certified"], best["objective"]) == (True, 30.0) and best["bound"] == pytest.approx(30)


@pytest.mark.parametrize("odd", [float("nan"), float("inf")])
def test_rounds_end_for_scores_without_a_number(spark, odd):
    found = certificate.price_bounds(*problem(spark, ("C", {"x": "ab", "y": "b"}, {"x": 1.0, "y": odd}, {"x"}))).first()
    assert not found["certified"]


def test_frontier_proves_what_prices_do_not(spark, monkeypatch, caplog):
    ring = {"x": "ab", "y": "bc", "z": "ca"}
    named = lambda p, d: {p + k: v for k, v in d.items()}
    best = ("C1", named("b", ring), {"bx": 1, "by": 1, "bz": 1}, {"bx"})  # any prices add up to 1.5
    worse = ("C2", named("w", ring), {"wx": 1, "wy": 2, "wz": 1}, {"wx"})
    plain = ("C3", {"p": "a", "q": "b"}, {"p": 1, "q": 2}, {"p", "q"})
    given = problem(spark, best, worse, plain)
    got = {r["component_id"]: (r["segment_count"], r["objective"], round(r["bound"], 9), round(r["gap"], 9), r["certified"]) for r in packing.certified(*given).collect()}
    assert got == {"C1": (3, 1.0, 1.0, 0.0, True), "C2": (3, 1.0, 2.0, 1.0, False), "C3": (2, 3.0, 3.0, 0.0, True)}
    monkeypatch.setattr(frontier, "PASSES", 0)  # without a proof the prices' bound stays, and says so
    with caplog.at_level(logging.WARNING):
        left = {r["component_id"]: r["certified"] for r in packing.certified(*given).collect()}
    assert left == {"C1": False, "C2": False, "C3": True} and "no optimum proven" in caplog.text
