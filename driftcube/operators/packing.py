"""Hierarchy adjustment and exact maximum-weight set packing, component by component."""

from __future__ import annotations

import logging

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftcube.config import AnomalyThresholds
from driftcube.operators import coverage as cov
from driftcube.operators.certificate import price_bounds
from driftcube.operators.frontier import NotProven, pack_frontier
from driftcube.operators.ranks import with_rank
from driftcube.operators.solver import UNADJUSTED, Node, adjust, adjust_hierarchy, pack
from driftcube.storage import ship, stage

_log = logging.getLogger(__name__)

_SOLVED = (
    "segment_id string, component_id string, anomaly_score double, hierarchy_factor double, hierarchy_descendant_count int, hierarchy_group_count long, "
    "hierarchy_best_group_ids array<string>, hierarchy_best_group_keys array<string>, hierarchy_best_group_score double, hierarchy_uncapped_score double, "
    "hierarchy_capture double, hierarchy_score_cap double, hierarchy_cap_applied boolean, hierarchy_same_direction boolean, hierarchy_dominant_child_id string, "
    "hierarchy_unidirectionality double, hierarchy_dominant_share double, hierarchy_balance_max double, hierarchy_balance_eff double, hierarchy_balance double, hierarchy_coherence double, "
    "selected boolean, solver_name string, solver_status string, objective_value double, best_bound double, absolute_gap double, relative_gap double, solve_time_sec double, "
    "variable_count int, constraint_count int, message string"
)
_FIELDS = (
    "score", "factor", "descendants", "groups", "group_ids", "group_keys", "group_score", "uncapped", "capture", "cap", "cap_applied", "same_direction", "dominant",
    "u", "dominant_share", "b_max", "b_eff", "balance", "coherence",
)
#: The part of these columns that adjusting sets.
_ADJUSTED = ", ".join(_SOLVED.split(", ")[: 2 + len(_FIELDS)])


def proven(tolerance: float) -> Column:
    """Whether a component's solver states an optimum and its gap bears it out."""
    near = F.least(F.col("relative_gap"), F.col("absolute_gap")) <= tolerance + 1e-12
    return F.coalesce((F.col("solver_status") == "OPTIMAL") & near, F.lit(False))


def solve(candidates: DataFrame, coverage: DataFrame, thresholds: AnomalyThresholds = AnomalyThresholds(), prescored: bool = False) -> DataFrame:
    """One row for each eligible segment: its adjusted score and whether the optimum holds it.

    A descendant shares atoms with its ancestor, so neither step leaves a
    conflict component.  Components of one segment need no search; those of at
    most ``max_group_size`` are solved in parallel, one group each, the larger
    ones by :func:`_spread`.  The components' number and the size of the
    largest are logged before.
    ``prescored`` takes ``anomaly_score`` as given and only packs.
    """
    thresholds.check()
    ship(candidates.sparkSession)
    rows = candidates.where("passes_initial_anomaly_filter").withColumn("is_atom", F.col("is_atom").cast("boolean"))
    eligible = stage(cov.eligible_coverage(candidates, coverage), "eligible")
    gross = cov.gross_movement(coverage, candidates)
    atoms = eligible.groupBy("segment_id").agg(F.sort_array(F.collect_list("atom_id")).alias("atoms"))
    score = F.col("anomaly_score") if prescored else F.col("base_anomaly_score")
    ready = rows.select("segment_id", "segment_key", "slice_depth", "is_atom", "wow_delta_gmv", score.alias("base"))
    ready = ready.join(gross, "segment_id").join(atoms, "segment_id").join(cov.components(eligible), "segment_id")
    ready = stage(ready.withColumn("members", F.count("*").over(Window.partitionBy("component_id"))), "components")
    found = ready.agg(F.count_distinct("component_id").alias("n"), F.max("members").alias("largest"), F.count_if(F.col("members") == 1).alias("alone")).first()
    _log.info("%s conflict components, %s of one segment, the largest of %s", found["n"], found["alone"], found["largest"])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        nodes = _nodes(group)
        if prescored:
            for n in nodes:
                n.result.update(UNADJUSTED, group_ids=[], group_keys=[], score=n.base, uncapped=n.base)
        else:
            adjust_hierarchy(nodes, thresholds)
        p = pack(nodes, thresholds)
        of = (p.solver, p.status, p.objective, p.bound, p.absolute_gap, p.relative_gap, p.seconds, p.variables, p.constraints, p.message)
        rows = [(n.segment_id, key[0], *(n.result[f] for f in _FIELDS), n.segment_id in p.chosen, *of) for n in nodes]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _SOLVED.split(", ")])

    most = thresholds.max_group_size
    together = ready.where((F.col("members") > 1) & (F.col("members") <= most)).drop("members").groupBy("component_id").applyInPandas(run, _SOLVED)
    parts = _alone(ready.where("members = 1"), prescored).unionByName(together)
    if (found["largest"] or 0) > max(most, 1):
        parts = parts.unionByName(_spread(ready.where((F.col("members") > most) & (F.col("members") > 1)), eligible, thresholds, prescored))
    return stage(parts, "solved")


def _nodes(group: pd.DataFrame) -> list[Node]:
    bit = {a: 1 << i for i, a in enumerate(sorted({a for atoms in group["atoms"] for a in atoms}))}
    return [
        Node(r.segment_id, r.segment_key, int(r.slice_depth), bool(r.is_atom), float(r.wow_delta_gmv), float(r.base), float(r.gross_atomic), sum(bit[a] for a in r.atoms))
        for r in group.itertuples()
    ]


def _spread(ready: DataFrame, eligible: DataFrame, thresholds: AnomalyThresholds, prescored: bool) -> DataFrame:
    """The solution of components that no task is to hold whole.

    Segments are adjusted depth by depth from the deepest, a task sees one
    segment and its descendants, whose scores are known by then; the frontier
    packs what comes of it.
    """
    eligible = eligible.join(ready.select("segment_id"), "segment_id", "left_semi")
    if prescored:
        plain = {"anomaly_score": F.col("base"), "hierarchy_uncapped_score": F.col("base"), "hierarchy_factor": F.lit(1.0), "hierarchy_cap_applied": F.lit(False)}
        plain |= {c: F.lit(0) for c in ("hierarchy_descendant_count", "hierarchy_group_count", "hierarchy_best_group_score")} | {c: F.array() for c in ("hierarchy_best_group_ids", "hierarchy_best_group_keys")}
        names = [c.split(" ") for c in _ADJUSTED.split(", ")]
        adjusted = ready.select(*((F.col(name) if name in ready.columns else plain.get(name, F.lit(None))).cast(kind).alias(name) for name, kind in names))
    else:
        adjusted = _adjusted_by_depth(ready, eligible, thresholds)
    chosen = pack_frontier(adjusted.join(ready.select("segment_id", "segment_key"), "segment_id"), eligible)
    rows = adjusted.join(chosen.select("segment_id", "selected"), "segment_id")
    limits = eligible.join(ready.select("segment_id", "component_id"), "segment_id").groupBy("component_id", "atom_id").count().where("count > 1")
    limits = limits.groupBy("component_id").agg(F.count("*").cast("int").alias("constraint_count"))
    total = F.coalesce(F.sum(F.when(F.col("selected"), F.col("anomaly_score"))), F.lit(0.0))
    sums = rows.groupBy("component_id").agg(total.alias("objective_value"), total.alias("best_bound"), F.count("*").cast("int").alias("variable_count"))
    same = {"solver_name": F.lit("FRONTIER"), "solver_status": F.lit("OPTIMAL"), "message": F.lit(""), **{c: F.lit(0.0) for c in ("absolute_gap", "relative_gap", "solve_time_sec")}}
    solved = rows.join(sums, "component_id").join(limits, "component_id").withColumns(same)
    return solved.select(*(c.split(" ")[0] for c in _SOLVED.split(", ")))


def _adjusted_by_depth(ready: DataFrame, eligible: DataFrame, thresholds: AnomalyThresholds) -> DataFrame:
    """The columns of ``_ADJUSTED`` of every segment, its descendants' scores first."""
    columns = ["segment_id", "segment_key", "slice_depth", "is_atom", "wow_delta_gmv", "base", "gross_atomic", "atoms", "component_id"]
    below = stage(cov.descendants(eligible), "below")
    none = F.lit(None).cast("double").alias("score")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        nodes = dict(zip(group["segment_id"], _nodes(group)))
        own = nodes.pop(key[0])
        for n, score in zip(group["segment_id"], group["score"]):
            if n != key[0]:
                nodes[n].result["score"] = float(score)
        adjust(own, list(nodes.values()), thresholds)
        return pd.DataFrame([(own.segment_id, group["component_id"].iloc[0], *(own.result[f] for f in _FIELDS))], columns=[c.split(" ")[0] for c in _ADJUSTED.split(", ")])

    done = None
    for (depth,) in sorted(ready.select("slice_depth").distinct().collect(), reverse=True):  # as many as the cube has dimensions
        own = ready.where(F.col("slice_depth") == depth).select(*columns)
        rows = own.select(F.col("segment_id").alias("parent"), *columns, none)
        if done is not None:
            scored = ready.select(*columns).join(done.select("segment_id", F.col("anomaly_score").alias("score")), "segment_id").withColumnRenamed("segment_id", "child_id")
            pairs = below.join(own.select("segment_id"), "segment_id", "left_semi").withColumnRenamed("segment_id", "parent").join(scored, "child_id")
            rows = rows.union(pairs.select("parent", F.col("child_id").alias("segment_id"), *columns[1:], "score"))
        found = stage(rows.groupBy("parent").applyInPandas(run, _ADJUSTED), "adjusted")
        done = found if done is None else done.union(found)
    return done


def _alone(ready: DataFrame, prescored: bool) -> DataFrame:
    """The solution of components of one segment, which has nothing to be adjusted by or to conflict with."""
    base, delta = F.col("base"), F.col("wow_delta_gmv")
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    says = F.concat(F.lit("segment "), F.col("segment_id"), F.lit(": an eligible segment needs a finite base score and a change"))
    score = base if prescored else F.when(finite(base) & finite(delta) & (delta != 0), base).otherwise(F.raise_error(says).cast("double"))
    value = {"segment_id": F.col("segment_id"), "component_id": F.col("component_id"), "anomaly_score": score, "hierarchy_uncapped_score": score, "selected": score > 0}
    value |= {"hierarchy_factor": F.lit(1.0), "hierarchy_best_group_ids": F.array(), "hierarchy_best_group_keys": F.array(), "solver_name": F.lit("TRIVIAL"), "solver_status": F.lit("OPTIMAL")}
    value |= {c: F.greatest(score, F.lit(0.0)) for c in ("objective_value", "best_bound")} | {"variable_count": F.lit(1), "hierarchy_cap_applied": F.lit(False), "message": F.lit("")}
    zero = ("hierarchy_descendant_count", "hierarchy_group_count", "hierarchy_best_group_score", "absolute_gap", "relative_gap", "solve_time_sec", "constraint_count")
    value |= dict.fromkeys(zero, F.lit(0))
    names = [c.split(" ") for c in _SOLVED.split(", ")]
    return ready.select(*(value.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in names))


def diagnostics(
    candidates: DataFrame, coverage: DataFrame, solved: DataFrame, thresholds: AnomalyThresholds = AnomalyThresholds(), source: str = "FACTUAL_ATOMIC_COVERAGE"
) -> DataFrame:
    """Every candidate with its packing status, coverage, conflicts, and its component's solution."""
    covered = coverage.groupBy("segment_id").agg(F.count("*").alias("covered_atomic_count"), F.sort_array(F.collect_list("atom_id")).alias("original_atomic_descendants"))
    pairs = cov.conflict_pairs(cov.eligible_coverage(candidates, coverage))
    other = F.struct(F.col("right_key").alias("key"), F.col("right_id").alias("id")), F.struct(F.col("left_key").alias("key"), F.col("left_id").alias("id"))
    ends = pairs.select(F.col("left_id").alias("segment_id"), other[0].alias("other")).union(pairs.select("right_id", other[1]))
    degree = ends.groupBy("segment_id").agg(F.count("*").alias("conflict_count"), F.sort_array(F.collect_list("other")).alias("others"))
    degree = degree.select("segment_id", "conflict_count", F.col("others.key").alias("conflict_segment_keys"), F.col("others.id").alias("conflict_segment_ids"))
    rows = candidates.join(covered, "segment_id", "left").join(degree, "segment_id", "left").join(solved, "segment_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("covered_atomic_count", "conflict_count")}
    rows = rows.withColumns({**zero, "is_resolved": proven(thresholds.set_packing_gap_tolerance), "original_atomic_count": zero["covered_atomic_count"]})
    passed, score = F.col("passes_initial_anomaly_filter"), F.col("anomaly_score")
    status = F.when((F.col("slice_depth") == 0) | ~passed, "NOT_IN_SET_PACKING_GRAPH").when(F.col("covered_atomic_count") == 0, "EMPTY_ATOMIC_COVERAGE")
    status = status.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "INVALID_SCORE").when(score <= 0, "NONPOSITIVE_SCORE")
    status = status.when(~F.col("is_resolved"), "SET_PACKING_NOT_PROVEN")
    status = status.when(F.col("selected"), "SET_PACKING_SELECTED").otherwise("SET_PACKING_NOT_SELECTED")
    by = F.format_string("component %s, solver %s, status %s", "component_id", "solver_name", "solver_status")
    reason = F.when(F.col("slice_depth") == 0, "the total takes no part").when(~passed, "below the initial thresholds")
    reason = reason.when(F.col("covered_atomic_count") == 0, "no atomic coverage").when(F.col("set_packing_status") == "INVALID_SCORE", "the score is not a finite number").when(score <= 0, "the score is not positive")
    reason = reason.when(~F.col("is_resolved"), F.concat(F.lit("no proven optimum: "), by)).when(F.col("selected"), F.concat(F.lit(f"part of the proven optimum (gap {thresholds.set_packing_gap_tolerance}): "), by))
    reason = reason.otherwise(F.concat(F.lit("lost to a disjoint set of at least the same score: "), by))
    rows = rows.withColumn("set_packing_status", status).withColumn("set_packing_reason", reason)
    chosen = F.coalesce("selected", F.lit(False))
    rows = rows.withColumns(
        {
            "selected": chosen,
            "is_eligible": passed & (F.col("slice_depth") > 0),
            "selection_score": score,
            "selected_atomic_count": F.when(chosen, F.col("covered_atomic_count")).otherwise(0),
            "selected_atomic_descendants": F.when(chosen, F.col("original_atomic_descendants")),
            "selection_exclusion_reason": F.when(chosen, "").otherwise(F.col("set_packing_reason")),
            "output_block": F.when(chosen, "optimal anomaly").otherwise("excluded"),
            "atomic_coverage_source": F.lit(source),
            "atomic_coverage_validation_status": F.when(F.col("covered_atomic_count") > 0, "OK").otherwise("EMPTY"),
        }
    )
    stats = component_stats(rows, coverage).select("component_id", *(F.col(c).alias(f"set_packing_component_{c}") for c in ("segment_count", "atom_count", "conflict_pair_count", "score_sum", "score_min", "score_max", "score_dynamic_range")))
    status = F.when(F.count_if("is_eligible") == 0, "EMPTY").when(F.count_if(F.col("is_eligible") & ~F.col("is_resolved")) == 0, "OPTIMAL").otherwise("NOT_OPTIMAL")
    overall = rows.agg(status.alias("set_packing_global_status"))  # one row
    return rows.join(stats, "component_id", "left").join(F.broadcast(overall))


def apply_hierarchy_score_adjustment(candidates: DataFrame, coverage: DataFrame, thresholds: AnomalyThresholds = AnomalyThresholds()) -> DataFrame:
    """``candidates`` with ``anomaly_score`` and the hierarchy columns; the base score where a segment is not eligible."""
    solved = solve(candidates, coverage, thresholds)
    kept = [c for c in solved.columns if c == "anomaly_score" or c.startswith("hierarchy_")]
    rows = candidates.drop(*kept).join(solved.select("segment_id", *kept), "segment_id", "left")
    return rows.withColumns({"anomaly_score": F.coalesce("anomaly_score", "base_anomaly_score"), "hierarchy_factor": F.coalesce("hierarchy_factor", F.lit(1.0))})


#: Columns that :func:`search_anomal` needs.
REQUIRED = ("segment_id", "segment_key", "slice_depth", "passes_initial_anomaly_filter", "anomaly_score", "wow_delta_gmv", "abs_robust_z", "materiality_share", "reliability_factor")


def search_anomal(
    candidates: DataFrame, thresholds: AnomalyThresholds = AnomalyThresholds(), coverage: DataFrame | None = None, allow_segment_key_fallback: bool = False, certify: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final, diagnostics, log): the optimal disjoint set for candidates that have their ``anomaly_score``.

    Coverage must be given, or taken from the keys on request.  A segment that
    passed the filter without a finite positive score is an error, not a loser.
    ``certify`` holds the solution to a bound of its own, see :func:`certified`.
    """
    if missing := sorted(set(REQUIRED) - set(candidates.columns)):
        raise ValueError(f"required columns are missing: {missing}")
    if coverage is None and not allow_segment_key_fallback:
        raise ValueError("atomic coverage is required; allow_segment_key_fallback takes it from the keys")
    deepest = F.broadcast(candidates.agg(F.max("slice_depth").alias("__deepest")))
    rows = candidates.drop("is_atom").join(deepest).withColumn("is_atom", F.col("slice_depth") == F.col("__deepest")).drop("__deepest")
    if coverage is None:
        coverage = cov.coverage_by_keys(rows)
    else:
        cov.check_coverage(rows, coverage)
    score = F.col("anomaly_score")
    bad = rows.where(F.col("passes_initial_anomaly_filter") & ~F.coalesce((score > 0) & (score < float("inf")), F.lit(False)))
    if some := [r["segment_id"] for r in bad.select("segment_id").limit(5).collect()]:
        raise ValueError(f"eligible segments without a finite positive score: {some}")
    solved = solve(rows, coverage, thresholds, prescored=True)
    source = "SEGMENT_KEY_FALLBACK" if allow_segment_key_fallback else "FACTUAL_ATOMIC_COVERAGE"
    found = stage(diagnostics(rows.drop("anomaly_score"), coverage, solved, thresholds, source), "diagnosed")
    best = stage(final(found), "final")
    validate(found, coverage, solved, best, thresholds, certified(found, coverage, thresholds) if certify else None)
    return best, found, decision_log(found, coverage)


def final(diagnosed: DataFrame) -> DataFrame:
    """The selected segments with their rank; keys are unique, so the order is total."""
    order = [F.col("anomaly_score").desc(), F.col("abs_robust_z").desc(), F.col("materiality_share").desc(), F.abs("wow_delta_gmv").desc(), F.col("reliability_factor").desc(), F.col("segment_key")]
    ranked = with_rank(diagnosed.where("selected"), order)
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def component_stats(diagnosed: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row a component: size, depths, scores, their dynamic range, objective."""
    rows = diagnosed.where("component_id is not null")
    atoms = rows.select("component_id", "segment_id").join(coverage, "segment_id").groupBy("component_id").agg(F.count_distinct("atom_id").alias("atom_count"))
    stats = rows.groupBy("component_id").agg(
        F.count("*").alias("segment_count"),
        (F.sum("conflict_count") / 2).cast("long").alias("conflict_pair_count"),
        F.min("slice_depth").alias("min_depth"),
        F.max("slice_depth").alias("max_depth"),
        F.sum("anomaly_score").alias("score_sum"),
        F.min("anomaly_score").alias("score_min"),
        F.max("anomaly_score").alias("score_max"),
        F.sum(F.when(F.col("selected"), F.col("anomaly_score")).otherwise(0.0)).alias("selected_score_sum"),
        *(F.first(c).alias(c) for c in ("solver_name", "solver_status", "objective_value", "best_bound", "absolute_gap", "relative_gap", "solve_time_sec", "variable_count", "constraint_count", "message")),
        F.sort_array(F.collect_list(F.when(F.col("selected"), F.col("segment_id")))).alias("selected_ids"),
    )
    span = F.when(F.col("score_min") > 0, F.col("score_max") / F.col("score_min")).otherwise(float("inf"))
    return stats.join(atoms, "component_id").withColumn("score_dynamic_range", span)


def decision_log(diagnosed: DataFrame, coverage: DataFrame) -> DataFrame:
    """Events of the optimization: summary, atoms, conflicts, components, decisions; absent fields are null."""
    eligible = cov.eligible_coverage(diagnosed, coverage)
    stats = component_stats(diagnosed, coverage)
    event = lambda name: F.lit(name).alias("event_type")
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("objective_value", "best_bound", "absolute_gap")]
    summary = stats.agg(F.count("*").alias("component_count"), F.coalesce(F.sum(F.size("selected_ids")), F.lit(0)).alias("selected_count"), *sums, F.coalesce(F.max("relative_gap"), F.lit(0.0)).alias("relative_gap"))
    overall = diagnosed.agg(F.coalesce(F.max("set_packing_global_status"), F.lit("EMPTY")).alias("global_status"))  # one row
    summary = summary.join(F.broadcast(overall)).select(event("GLOBAL_OPTIMIZATION_SUMMARY"), *summary.columns, "global_status", F.col("global_status").alias("solver_status"))
    listed = lambda c: F.array_join(F.col(c), " || ")
    atoms = eligible.groupBy("atom_id").agg(F.count("*").alias("segment_count"), F.sort_array(F.collect_list(F.struct("segment_key", "segment_id"))).alias("s"))
    atoms = atoms.select(event("ATOM_TO_SEGMENTS"), F.col("atom_id").alias("atomic_segment_id"), "segment_count", listed("s.segment_id").alias("segment_ids"), listed("s.segment_key").alias("segment_keys"))
    pairs = cov.conflict_pairs(eligible)
    names = {"left_id": "left_segment_id", "left_key": "left_segment_key", "right_id": "right_segment_id", "right_key": "right_segment_key"}
    pairs = pairs.select(event("CONFLICT_PAIR"), *(F.col(k).alias(v) for k, v in names.items()), "shared_atomic_count", listed("shared_atomic_ids").alias("shared_atomic_ids"))
    solves = stats.select(event("COMPONENT_SOLVE"), *(c for c in stats.columns if c not in ("selected_ids", "selected_score_sum")), listed("selected_ids").alias("selected_ids"))
    decisions = diagnosed.where("component_id is not null")
    decisions = decisions.select(event("SEGMENT_DECISION"), "component_id", "segment_id", "segment_key", "slice_depth", "anomaly_score", "selected", "solver_name", "solver_status", F.col("set_packing_global_status").alias("global_status"))
    log = summary
    for part in (atoms, pairs, solves, decisions):
        log = log.unionByName(part, allowMissingColumns=True)
    return log


def certified(diagnosed: DataFrame, coverage: DataFrame, thresholds: AnomalyThresholds = AnomalyThresholds()) -> DataFrame:
    """The bound of each component by prices of atoms, whatever its solver says; see :func:`driftcube.operators.certificate.price_bounds`.

    Prices alone may have no bound as low as the best set.  What they do not
    prove is packed anew by the frontier, which knows nothing of the solution at
    hand; the bound is then what it finds, to its TIE.  Where its widths end
    without a proof the prices' bound stays.
    """
    tolerance = thresholds.set_packing_gap_tolerance
    rows = diagnosed.where("component_id is not null")
    bounds = price_bounds(rows, coverage, tolerance)
    left = rows.join(bounds.where("not certified").select("component_id"), "component_id", "left_semi")
    if left.isEmpty():
        return bounds
    try:
        chosen = pack_frontier(left, coverage).where("selected")
    except NotProven as stopped:
        _log.warning("bounds by prices only: %s", stopped)
        return bounds
    found = left.select("segment_id", "anomaly_score").join(chosen, "segment_id").groupBy("component_id").agg(F.sum("anomaly_score").alias("best"))
    every = bounds.join(found, "component_id", "left").withColumn("bound", F.least("bound", F.greatest("objective", F.coalesce("best", F.col("bound")))))
    every = every.withColumn("gap", F.col("bound") - F.col("objective"))
    near = F.col("gap") <= tolerance * F.greatest(F.lit(1.0), F.abs("objective"))
    return stage(every.withColumn("certified", F.col("certified") | near).select(*bounds.columns), "bounds")


def _searched_anew(diagnosed: DataFrame, coverage: DataFrame, doubtful: DataFrame, thresholds: AnomalyThresholds) -> float:
    """What the ``doubtful`` components can be worth, by a search of their own that knows nothing of the solution at hand."""
    rows = diagnosed.join(doubtful.select("component_id"), "component_id", "left_semi").where("is_eligible")
    again = solve(rows.drop("component_id"), coverage, thresholds, prescored=True)
    return again.where("selected").agg(F.coalesce(F.sum("anomaly_score"), F.lit(0.0))).first()[0]


def validate(
    diagnosed: DataFrame, coverage: DataFrame, solved: DataFrame | None = None, best: DataFrame | None = None, thresholds: AnomalyThresholds = AnomalyThresholds(), bounds: DataFrame | None = None
) -> None:
    """Errors for what must hold of a solution.

    All eligible segments resolved with positive scores, every component proven,
    its objective the sum of its chosen scores, no atom twice and none missing,
    ids and keys unique; and, where given, the final rows exactly what the
    solver chose, with the same sum.  ``bounds`` are those of :func:`certified`:
    a component that its prices do not prove is searched anew, and a better
    set is an error, so neither the solver's word nor its figures count.
    """
    tolerance = max(1e-7, thresholds.set_packing_gap_tolerance + 1e-12)
    checks = diagnosed.agg(
        F.count_if(F.col("is_eligible") & ~F.col("is_resolved")).alias("unresolved"),
        F.count_if(F.col("is_eligible") & ~F.coalesce(F.col("anomaly_score") > 0, F.lit(False))).alias("without a positive score"),
        F.count_if(F.col("is_eligible") & ~F.col("set_packing_status").isin("SET_PACKING_SELECTED", "SET_PACKING_NOT_SELECTED")).alias("not decided"),
        F.count_if(F.col("set_packing_global_status") == "NOT_OPTIMAL").alias("not globally optimal"),
        F.count_if(F.col("selected") & (F.col("covered_atomic_count") == 0)).alias("selected without coverage"),
        (F.count("*") - F.count_distinct("segment_id")).alias("repeated ids"),
        (F.count("*") - F.count_distinct("segment_key")).alias("repeated keys"),
    ).first()
    twice = diagnosed.where("selected").join(coverage, "segment_id").groupBy("atom_id").count().where("count > 1").count()
    apart = lambda a, b: ~F.coalesce(F.abs(a - b) <= F.greatest(F.lit(tolerance), 1e-9 * F.greatest(F.abs(a), F.abs(b))), F.lit(False))
    stats = component_stats(diagnosed, coverage)
    sums = stats.where(apart(F.col("objective_value"), F.col("selected_score_sum")) | ~proven(thresholds.set_packing_gap_tolerance)).count()
    bad = {**checks.asDict(), "atoms selected twice": twice, "components whose objective is not proven or not the sum of their scores": sums}
    if solved is not None and best is not None:
        chosen = solved.where("selected").select("segment_id")
        bad["final segments that the solver did not choose"] = best.join(chosen, "segment_id", "left_anti").count()
        bad["chosen segments that are not final"] = chosen.join(best, "segment_id", "left_anti").count()
        total = stats.agg(F.coalesce(F.sum("objective_value"), F.lit(0.0)).alias("a")).join(best.agg(F.coalesce(F.sum("anomaly_score"), F.lit(0.0)).alias("b")))
        bad["final sums that are not the objective"] = total.where(apart(F.col("a"), F.col("b"))).count()
    if bounds is not None:
        doubtful = bounds.where("not certified")
        claimed = doubtful.agg(F.count("*").alias("n"), F.sum("objective").alias("objective")).first()
        if claimed["n"]:
            reached = _searched_anew(diagnosed, coverage, doubtful, thresholds)
            if reached > claimed["objective"] + max(tolerance, 1e-9 * abs(reached)):
                bad["score that a better set has above the components that no prices prove"] = reached - claimed["objective"]
    if bad := {k: v for k, v in bad.items() if v}:
        raise ValueError(f"set packing solution is not valid: {bad}")
