"""DuckDB SQL for the engine's queries: one chain of common table expressions, cut where a query needs it."""

from __future__ import annotations

import re

_DIMS = ("geo", "products", "merchants_type", "is_terminal_or_cpqr")
_D = ", ".join(_DIMS)
_METRICS = ("gmv", "tx", "au", "am", "aov", "tpm", "freq")


def _json(dims: tuple[str, ...] = _DIMS) -> str:
    return "'[' || " + " || ',' || ".join(f"""coalesce('"' || {d} || '"', 'null')""" for d in dims) + " || ']'"


_KEY = f"""coalesce(nullif(concat_ws(' × ', {", ".join(f"'{d}=' || {d}" for d in _DIMS)}), ''), 'ИТОГО')"""
_LEVEL = f"""concat_ws(' × ', {", ".join(f"CASE WHEN {d} IS NOT NULL THEN '{d}' END" for d in _DIMS)})"""
_DEPTH = " + ".join(f"({d} IS NOT NULL)::INT" for d in _DIMS)

#: Name and body of each table expression, in order.
_CTES = {
    "sales": """
        SELECT date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day,
               round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) AS amount,
               l_orderkey AS order_id, o_custkey AS user_id, l_suppkey AS merchant_id,
               coalesce(nullif(trim(r_name), ''), 'Unknown') AS geo, coalesce(nullif(trim(p_type), ''), 'Unknown') AS products,
               coalesce(nullif(trim(p_brand), ''), 'Unknown') AS brand, coalesce(nullif(trim(l_returnflag), ''), 'Unknown') AS is_terminal_or_cpqr
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "windows": """
        SELECT * FROM (SELECT s.*, (last - day) // 91 AS idx, last - 91 * ((last - day) // 91) AS cal_date, first
                       FROM sales s, (SELECT min(day) AS first, max(day) AS last FROM sales))
        WHERE idx < 13 AND cal_date - 90 >= first""",
    "top5": "SELECT brand AS b FROM windows WHERE idx >= 1 GROUP BY brand ORDER BY sum(amount) DESC, brand LIMIT 5",
    "bucketed": "SELECT w.*, coalesce(b, 'Other') AS merchants_type FROM windows w LEFT JOIN top5 ON brand = b",
    "cubed": f"""
        SELECT cal_date, {_D}, sum(amount)::BIGINT / 10000.0::DOUBLE AS gmv, count(DISTINCT order_id)::DOUBLE AS tx,
               count(DISTINCT user_id)::DOUBLE AS au, count(DISTINCT merchant_id)::DOUBLE AS am
        FROM bucketed GROUP BY cal_date, CUBE ({_D})""",
    "spans": "SELECT * FROM (VALUES ('1W', 7), ('4W', 28), ('13W', 91)) AS t(period, span)",
    "pwindows": """
        SELECT * FROM (SELECT s.*, period, span, (last - day) // span AS idx, last - span * ((last - day) // span) AS cal_date, first
                       FROM sales s, spans, (SELECT min(day) AS first, max(day) AS last FROM sales))
        WHERE idx < 13 AND cal_date - (span - 1) >= first""",
    "ptop": """
        SELECT period, brand AS b, amount, row_number() OVER (PARTITION BY period ORDER BY amount DESC, brand) AS rank
        FROM (SELECT period, brand, sum(amount) AS amount FROM pwindows WHERE idx >= 1 GROUP BY period, brand) QUALIFY rank <= 5""",
    "pcubed": f"""
        SELECT period, cal_date, {_D}, sum(amount)::BIGINT / 10000.0::DOUBLE AS gmv, count(DISTINCT order_id)::DOUBLE AS tx, count(DISTINCT user_id)::DOUBLE AS au, count(DISTINCT merchant_id)::DOUBLE AS am
        FROM (SELECT w.*, coalesce(t.b, 'Other') AS merchants_type FROM pwindows w LEFT JOIN ptop t ON w.brand = t.b AND w.period = t.period) GROUP BY period, cal_date, CUBE ({_D})""",
    "history": f"""
        SELECT *, gmv / tx AS aov, tx / am AS tpm, tx / au AS freq, {_DEPTH} AS slice_depth, {_json()} AS segment_id, {_KEY} AS segment_key, {_LEVEL} AS segment_level
        FROM cubed""",
    "dates": "SELECT DISTINCT cal_date FROM history WHERE slice_depth = 0",
    "bounds": "SELECT max(cal_date) AS cur, max(cal_date) - 91 AS prev, min(cal_date) AS first FROM dates",
    "segments": f"SELECT DISTINCT segment_id, segment_key, segment_level, slice_depth, {_D} FROM history",
    "panel": f"""
        SELECT s.*, d.cal_date, coalesce(h.gmv, 0) AS gmv, coalesce(h.tx, 0) AS tx, coalesce(h.au, 0) AS au, coalesce(h.am, 0) AS am,
               h.aov, h.tpm, h.freq, h.segment_id IS NULL AS row_missing_in_source
        FROM segments s CROSS JOIN dates d LEFT JOIN history h ON h.segment_id = s.segment_id AND h.cal_date = d.cal_date""",
    "moves": """
        SELECT p.*, CASE WHEN lag(gmv) OVER w > 0 THEN (gmv - lag(gmv) OVER w) / lag(gmv) OVER w END AS growth, cur, prev
        FROM panel p, bounds WINDOW w AS (PARTITION BY segment_id ORDER BY cal_date)""",
    "base": "SELECT segment_id, coalesce(median(growth) FILTER (cal_date < cur), 0) AS baseline_growth FROM moves GROUP BY segment_id",
    "mad": """
        SELECT segment_id, any_value(baseline_growth) AS baseline_growth,
               coalesce(median(abs(growth - baseline_growth)) FILTER (cal_date < cur), 0) AS mad_growth
        FROM moves JOIN base USING (segment_id) GROUP BY segment_id""",
    "wide": f"""
        SELECT segment_id, any_value(segment_key) AS segment_key, any_value(slice_depth) AS slice_depth, {", ".join(f"any_value({d}) AS {d}" for d in _DIMS)},
               max(growth) FILTER (cal_date = cur) AS relative_wow, count(*) FILTER (cal_date < cur AND gmv > 0) AS history_nonzero_weeks,
               {", ".join(f"max({m}) FILTER (cal_date = prev) AS {m}_previous, max({m}) FILTER (cal_date = cur) AS {m}_current" for m in _METRICS)}
        FROM moves GROUP BY segment_id""",
    "stated": """
        SELECT *, gmv_current - gmv_previous AS wow_delta_gmv,
               CASE WHEN gmv_current > 0 AND history_nonzero_weeks = 0 THEN 'new' WHEN gmv_current > 0 AND gmv_previous = 0 AND history_nonzero_weeks > 0 THEN 'resumed'
                    WHEN gmv_current = 0 AND gmv_previous > 0 THEN 'vanished' ELSE 'ordinary' END AS state,
               CASE WHEN history_nonzero_weeks >= 8 THEN 1.0 WHEN history_nonzero_weeks >= 4 THEN 0.7 WHEN history_nonzero_weeks >= 1 THEN 0.4 ELSE 0.1 END::DOUBLE AS reliability_factor
        FROM wide JOIN mad USING (segment_id)""",
    "metrics": """
        SELECT *, CASE WHEN relative_wow IS NULL THEN CASE WHEN state <> 'ordinary' AND wow_delta_gmv <> 0 THEN 6.0 ELSE 0.0 END
                       ELSE (relative_wow - baseline_growth) / greatest(mad_growth * 1.4826::DOUBLE, 0.00001::DOUBLE) END::DOUBLE AS robust_z,
               CASE WHEN mad_growth * 1.4826::DOUBLE < 0.00001::DOUBLE THEN 'SIGMA_FLOOR' ELSE 'MAD' END AS z_scale_source
        FROM stated""",
    "candidates": """
        SELECT *, CASE WHEN gross_atomic_movement > 0 THEN abs(wow_delta_gmv) / gross_atomic_movement ELSE 0 END AS materiality_share,
               slice_depth = atom_depth AS is_atom,
               slice_depth > 0 AND abs(robust_z) >= {least_z} AND CASE WHEN gross_atomic_movement > 0 THEN abs(wow_delta_gmv) / gross_atomic_movement ELSE 0 END >= {least_share} AS passes,
               abs(robust_z) * (abs(wow_delta_gmv) / gross_atomic_movement) * reliability_factor AS base_score
        FROM metrics, (SELECT max(slice_depth) AS atom_depth FROM metrics),
             (SELECT sum(abs(wow_delta_gmv)) AS gross_atomic_movement FROM metrics WHERE slice_depth = (SELECT max(slice_depth) FROM metrics))""",
    "coverage": f"""
        SELECT s.segment_id, a.segment_id AS atom_id FROM candidates s JOIN candidates a
        ON a.is_atom AND {" AND ".join(f"(s.{d} IS NULL OR s.{d} = a.{d})" for d in _DIMS)}""",
    "eligible": "SELECT c.*, segment_key, slice_depth FROM coverage c JOIN candidates USING (segment_id) WHERE passes",
    "sets": "SELECT segment_id, segment_key, slice_depth, list_sort(list(atom_id)) AS atoms FROM eligible GROUP BY ALL",
    "descendants": "SELECT p.segment_id, c.segment_id AS child_id FROM sets p JOIN sets c ON c.slice_depth > p.slice_depth AND list_has_all(p.atoms, c.atoms)",
    "pairs": """
        SELECT l.segment_id AS left_id, r.segment_id AS right_id, l.segment_key AS left_key, r.segment_key AS right_key, len(list_intersect(l.atoms, r.atoms)) AS shared_atomic_count
        FROM sets l JOIN sets r ON l.segment_key < r.segment_key AND list_has_any(l.atoms, r.atoms)""",
    "reach": """
        SELECT segment_key AS key, segment_key AS seen FROM sets
        UNION SELECT reach.key, CASE WHEN left_key = seen THEN right_key ELSE left_key END FROM reach JOIN pairs ON left_key = seen OR right_key = seen""",
    "parts": "SELECT key AS segment_key, format('C{:03d}', dense_rank() OVER (ORDER BY min(seen))) AS component_id FROM reach GROUP BY key",
    "gross": "SELECT c.segment_id, sum(abs(wow_delta_gmv)) AS gross FROM coverage c JOIN candidates a ON a.segment_id = c.atom_id GROUP BY c.segment_id",
    "own": """
        SELECT s.segment_id, s.segment_key, s.slice_depth, is_atom, atoms, base_score, wow_delta_gmv AS delta, gross, component_id
        FROM sets s JOIN candidates c USING (segment_id) JOIN gross USING (segment_id) JOIN parts ON parts.segment_key = s.segment_key""",
}


def _level(depth: int) -> dict[str, str]:
    """Scores of the eligible segments of one depth, given those of all deeper ones in ``adj{depth + 1}``."""
    n, deeper = depth, f"adj{depth + 1}"
    groups = f"""
        SELECT p.segment_id, [c.segment_id] AS ids, c.atoms, c.score, [c.delta] AS deltas, c.gross AS child_gross, c.segment_id AS last
        FROM own p JOIN descendants USING (segment_id) JOIN {deeper} c ON c.segment_id = child_id WHERE p.slice_depth = {n} AND NOT p.is_atom
        UNION ALL
        SELECT g.segment_id, list_append(g.ids, c.segment_id), list_concat(g.atoms, c.atoms), g.score + c.score, list_append(g.deltas, c.delta), g.child_gross, c.segment_id
        FROM groups{n} g JOIN descendants d ON d.segment_id = g.segment_id JOIN {deeper} c ON c.segment_id = d.child_id
        WHERE c.segment_id > g.last AND NOT list_has_any(g.atoms, c.atoms)"""
    best = f"""
        SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY segment_id) AS n_groups,
                              row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, len(ids), ids) AS r FROM groups{n}) WHERE r = 1"""
    parts = f"""
        SELECT o.*, b.ids, b.score AS best_score, b.n_groups, b.child_gross, b.deltas, len(b.ids) AS k, least(1.0, b.child_gross / o.gross) AS capture,
               list_sum(list_transform(b.deltas, lambda x: abs(x))) AS g, abs(list_sum(b.deltas)) AS net, list_max(list_transform(b.deltas, lambda x: abs(x))) AS top,
               list_sum(list_transform(b.deltas, lambda x: x * x)) AS squares,
               (SELECT count(*) FROM descendants d WHERE d.segment_id = o.segment_id) AS n_desc
        FROM own o LEFT JOIN best{n} b USING (segment_id) WHERE o.slice_depth = {n}"""
    scored = f"""
        SELECT *, k = 1 AND delta * deltas[1] > 0 AND capture >= 0.8 AS rule, CASE WHEN k = 1 THEN delta * deltas[1] > 0 END AS same_direction,
               CASE WHEN k > 1 THEN net / g END AS u, CASE WHEN k > 1 THEN top / g END AS dominant_share,
               CASE WHEN k > 1 THEN least(1, greatest(0, (1 - top / g) / (1 - 1.0 / k))) END AS b_max, CASE WHEN k > 1 THEN least(1, greatest(0, (g * g / squares - 1) / (k - 1))) END AS b_eff,
               CASE WHEN is_atom OR k IS NULL THEN base_score WHEN k = 1 THEN base_score * 0.85
                    ELSE base_score * (1 + 0.3 * (net / g * least(least(1, greatest(0, (1 - top / g) / (1 - 1.0 / k))), least(1, greatest(0, (g * g / squares - 1) / (k - 1)))) - 0.5)) END AS uncapped
        FROM parts{n}"""
    adj = f"""
        SELECT segment_id, segment_key, slice_depth, component_id, atoms, delta, gross, base_score, coalesce(n_desc, 0) AS n_desc, coalesce(n_groups, 0) AS n_groups,
               CASE WHEN rule THEN least(uncapped, best_score * 0.98) ELSE uncapped END AS score, coalesce(rule AND best_score * 0.98 < uncapped, false) AS cap_applied,
               coalesce(ids, []) AS ids, coalesce(best_score, 0) AS best_score, CASE WHEN k = 1 THEN capture END AS capture, CASE WHEN k = 1 THEN best_score * 0.98 END AS cap,
               coalesce(rule, false) AS rule, same_direction, u, dominant_share, b_max, b_eff, CASE WHEN k = 1 THEN uncapped END AS uncapped
        FROM scored{n} UNION ALL SELECT * FROM {deeper}"""
    return {f"groups{n}": groups, f"best{n}": best, f"parts{n}": parts, f"scored{n}": scored, f"adj{n}": adj}


_CTES["adj5"] = """
        SELECT segment_id, segment_key, slice_depth, component_id, atoms, delta, gross, base_score, 0::BIGINT AS n_desc, 0::BIGINT AS n_groups, base_score AS score, false AS cap_applied,
               []::VARCHAR[] AS ids, 0.0::DOUBLE AS best_score, NULL::DOUBLE AS capture, NULL::DOUBLE AS cap, false AS rule, NULL::BOOLEAN AS same_direction, NULL::DOUBLE AS u, NULL::DOUBLE AS dominant_share,
               NULL::DOUBLE AS b_max, NULL::DOUBLE AS b_eff, NULL::DOUBLE AS uncapped FROM own WHERE false"""
for _depth in (4, 3, 2, 1):
    _CTES |= _level(_depth)
_CTES |= {
    "nodes": "SELECT * FROM adj1",
    "choices": """
        SELECT component_id, [segment_key] AS keys, atoms, score, segment_key AS last FROM nodes
        UNION ALL
        SELECT n.component_id, list_append(c.keys, n.segment_key), list_concat(c.atoms, n.atoms), c.score + n.score, n.segment_key
        FROM choices c JOIN nodes n ON n.component_id = c.component_id AND n.segment_key > c.last AND NOT list_has_any(c.atoms, n.atoms)""",
    "chosen": """
        SELECT component_id, keys FROM (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY round(score, 11) DESC, len(keys), keys) AS r FROM choices) WHERE r = 1""",
    "solved": "SELECT n.*, list_contains(keys, n.segment_key) AS selected FROM nodes n JOIN chosen USING (component_id)",
    "clash": """
        SELECT key, count(*) AS n, string_agg(other, ' || ' ORDER BY other) AS others FROM (SELECT left_key AS key, right_key AS other FROM pairs UNION ALL SELECT right_key, left_key FROM pairs) GROUP BY key""",
    "stats": """
        SELECT component_id, count(*) AS segment_count, len(list_distinct(flatten(list(atoms)))) AS atom_count,
               (SELECT count(*) FROM pairs JOIN solved l ON l.segment_id = left_id WHERE l.component_id = s.component_id) AS conflict_pair_count,
               CASE WHEN sum(len(atoms)) = len(list_distinct(flatten(list(atoms)))) THEN 'TRIVIAL' ELSE 'BRANCH_AND_BOUND' END AS solver_name,
               min(slice_depth) AS min_depth, max(slice_depth) AS max_depth, sum(score) AS score_sum, min(score) AS score_min, max(score) AS score_max, sum(score) FILTER (selected) AS objective_value,
               -- a proof by all disjoint sets: the best of them
               (SELECT max(c.score) FROM choices c WHERE c.component_id = s.component_id) AS best_bound, max(score) / min(score) AS score_dynamic_range
        FROM solved s GROUP BY component_id""",
    "proof": """
        SELECT *, CASE WHEN abs(best_bound - objective_value) <= 1e-9 THEN 'OPTIMAL' ELSE 'NOT_OPTIMAL' END AS solver_status, greatest(0, round(best_bound - objective_value, 9)) AS absolute_gap,
               greatest(0, round(best_bound - objective_value, 9)) / abs(objective_value) AS relative_gap FROM stats""",
    "overall": "SELECT CASE WHEN count(*) = 0 THEN 'EMPTY' WHEN count(*) FILTER (solver_status <> 'OPTIMAL') = 0 THEN 'OPTIMAL' ELSE 'NOT_OPTIMAL' END AS global_status FROM proof",
    "final": """
        SELECT s.segment_id, s.segment_key, s.slice_depth, score, c.wow_delta_gmv,
               row_number() OVER (ORDER BY score DESC, abs(robust_z) DESC, materiality_share DESC, abs(wow_delta_gmv) DESC, reliability_factor DESC, s.segment_key) AS rank
        FROM solved s JOIN candidates c USING (segment_id) WHERE selected""",
    "structure": """
        SELECT row_number() OVER (ORDER BY CASE state WHEN 'new' THEN 0 WHEN 'resumed' THEN 1 ELSE 2 END, abs(wow_delta_gmv) DESC, slice_depth DESC, segment_key) AS row_no,
               state, segment_key, wow_delta_gmv
        FROM candidates WHERE state <> 'ordinary' AND slice_depth > 0""",
    "control": """
        SELECT unnest(['source_rows', 'panel_rows', 'filled_missing_rows', 'current_total_gmv', 'candidate_count', 'eligible_candidate_count', 'selected_count',
                       'set_packing_unresolved_count', 'set_packing_not_proven_count', 'atomic_count', 'set_packing_component_count', 'set_packing_non_optimal_component_count',
                       'set_packing_objective_value', 'set_packing_conflict_pair_count', 'selected_atomic_unique_count', 'double_count_violation_count',
                       'week_count', 'previous_cal_date', 'current_cal_date']) AS metric,
               unnest([(SELECT count(*) FROM history)::DOUBLE, (SELECT count(*) FROM panel), (SELECT count(*) FROM panel WHERE row_missing_in_source),
                       (SELECT sum(gmv) FROM panel, bounds WHERE slice_depth = 0 AND cal_date = cur), (SELECT count(*) FROM candidates), (SELECT count(*) FROM candidates WHERE passes),
                       (SELECT count(*) FROM final), (SELECT count(*) FROM candidates LEFT JOIN solved USING (segment_id) WHERE passes AND selected IS NULL),
                       (SELECT count(*) FROM solved JOIN proof USING (component_id) WHERE solver_status <> 'OPTIMAL'), (SELECT count(*) FROM candidates WHERE is_atom), (SELECT count(DISTINCT component_id) FROM solved),
                       (SELECT count(*) FROM proof WHERE solver_status <> 'OPTIMAL'),
                       (SELECT coalesce(sum(score), 0) FROM final), (SELECT count(*) FROM pairs),
                       (SELECT count(DISTINCT atom_id) FROM coverage JOIN final USING (segment_id)),
                       (SELECT count(*) - count(DISTINCT atom_id) FROM coverage JOIN final USING (segment_id)),
                       (SELECT count(*) FROM dates), (SELECT prev FROM bounds), (SELECT cur FROM bounds)]) AS value""",
}

_EDGES = " UNION ".join(
    f"""SELECT p.segment_key AS parent_key, c.segment_key AS child_key FROM candidates c JOIN candidates p
        ON c.passes AND p.passes AND p.slice_depth > 0 AND c.{gone} IS NOT NULL AND p.{gone} IS NULL AND {" AND ".join(f"p.{d} IS NOT DISTINCT FROM c.{d}" for d in _DIMS if d != gone)}"""
    for gone in _DIMS
)
_WOW = ", ".join(f"round(CASE WHEN {m}_previous <> 0 THEN ({m}_current - {m}_previous) / {m}_previous END, 6) AS {m}_wow_pct" for m in _METRICS)

#: The last step of each query.
_QUERIES = {
    "complete_windows": "SELECT idx, cal_date, count(*) AS rows, sum(amount)::BIGINT / 10000.0::DOUBLE AS gmv FROM windows GROUP BY ALL",
    "top_n_bucket": "SELECT merchants_type, cal_date, count(*) AS rows, sum(amount)::BIGINT / 10000.0::DOUBLE AS gmv FROM bucketed GROUP BY ALL",
    "cube_mart": f"SELECT cal_date, slice_depth, {_D}, gmv, tx, au, am FROM history",
    "mart_periods": f"SELECT period, cal_date, {_DEPTH} AS slice_depth, {_D}, gmv, tx, au, am, gmv / tx AS aov, tx / am AS tpm, tx / au AS freq FROM pcubed",
    "top_brands_by_period": "SELECT period, rank::INT AS rank, b AS brand, amount::BIGINT / 10000.0::DOUBLE AS gmv FROM ptop",
    "ratio_metrics": "SELECT segment_id, cal_date, aov, tpm, freq FROM history",
    "share_of_total": """
        SELECT segment_id, cal_date, round(gmv / total, 10) AS share_in_total_gmv FROM history JOIN (SELECT cal_date, gmv AS total FROM history WHERE slice_depth = 0) USING (cal_date)""",
    "coverage_by_keys": "SELECT c.segment_id, atom_id FROM coverage c JOIN candidates USING (segment_id) WHERE slice_depth > 0",
    "component_stats": """
        SELECT component_id, count(*) AS segment_count, len(list_distinct(flatten(list(atoms)))) AS atom_count,
               (SELECT count(*) FROM pairs JOIN parts l ON l.segment_key = left_key WHERE l.component_id = p.component_id) AS conflict_pair_count, min(slice_depth) AS min_depth, max(slice_depth) AS max_depth,
               count(*)::INT AS variable_count,
               (SELECT count(*) FROM (SELECT e.atom_id FROM eligible e JOIN parts q USING (segment_key) WHERE q.component_id = p.component_id GROUP BY e.atom_id HAVING count(*) > 1))::INT AS constraint_count
        FROM sets JOIN parts p USING (segment_key) GROUP BY component_id""",
    "component_stats_strict": """
        SELECT component_id, segment_count, atom_count, conflict_pair_count, min_depth, max_depth, solver_name, solver_status, round(score_sum, 6) AS score_sum, round(score_min, 6) AS score_min,
               round(score_max, 6) AS score_max, round(objective_value, 6) AS objective_value, round(best_bound, 6) AS best_bound, round(absolute_gap, 6) AS absolute_gap, round(relative_gap, 6) AS relative_gap,
               round(score_dynamic_range, 6) AS score_dynamic_range FROM proof""",
    # the best of all disjoint sets: what the prices must prove
    "packing_bound_strict": """
        SELECT component_id, segment_count, round(objective_value, 4) AS objective, round(best_bound, 4) AS bound, abs(best_bound - objective_value) <= 1e-9 * greatest(1, abs(objective_value)) AS certified FROM stats""",
    "segment_keys": "SELECT DISTINCT segment_id, segment_key, segment_level, slice_depth FROM history",
    "parse_segment_key": """
        SELECT segment_id, (i - 1)::INT AS part_no, split_part(part, '=', 1) AS dim, substr(part, instr(part, '=') + 1) AS value
        FROM (SELECT segment_id, unnest(string_split(segment_key, ' × ')) AS part, generate_subscripts(string_split(segment_key, ' × '), 1) AS i
              FROM segments WHERE slice_depth > 0)""",
    "week_grid": "SELECT segment_id, cal_date, gmv, tx, au, am, aov, row_missing_in_source FROM panel",
    "missing_zero_report": """
        SELECT segment_id, segment_key, segment_level, slice_depth, count(*) FILTER (row_missing_in_source) AS missing_week_count, count(*) FILTER (gmv = 0) AS zero_week_count,
               count(*) FILTER (gmv > 0) AS nonzero_week_count, max(gmv) FILTER (cal_date = prev) AS gmv_previous, bool_or(row_missing_in_source) FILTER (cal_date = prev) AS previous_row_missing,
               max(gmv) FILTER (cal_date = cur) AS gmv_current, bool_or(row_missing_in_source) FILTER (cal_date = cur) AS current_row_missing
        FROM panel, bounds GROUP BY ALL HAVING missing_week_count > 0 OR zero_week_count > 0""",
    "robust_z": """
        SELECT segment_id, round(baseline_growth, 6) AS baseline_growth, round(mad_growth, 6) AS mad_growth, round(relative_wow, 6) AS relative_wow, round(robust_z, 3) AS robust_z, z_scale_source FROM metrics""",
    "lifecycle_state": "SELECT segment_id, state, history_nonzero_weeks, reliability_factor, gmv_previous, gmv_current FROM metrics",
    "metric_wow": f"SELECT segment_id, {_WOW} FROM metrics",
    "materiality": """
        SELECT segment_id, round(wow_delta_gmv, 4) AS wow_delta_gmv, round(gross_atomic_movement, 4) AS gross_atomic_movement, round(materiality_share, 8) AS materiality_share FROM candidates""",
    "initial_filter": "SELECT segment_id, is_atom, passes AS passes_initial_anomaly_filter FROM candidates",
    "top_movers": "SELECT segment_key, slice_depth, state, round(base_score, 6) AS base_anomaly_score FROM candidates WHERE passes",
    "atomic_coverage": "SELECT segment_id, atom_id FROM coverage",
    "reconciliation": """
        SELECT p.segment_id, p.cal_date, round(any_value(p.gmv), 4) AS gmv, abs(any_value(p.gmv) - sum(a.gmv)) <= 0.0001 AS reconciled
        FROM panel p JOIN coverage c ON c.segment_id = p.segment_id AND c.atom_id <> p.segment_id JOIN panel a ON a.segment_id = c.atom_id AND a.cal_date = p.cal_date
        GROUP BY p.segment_id, p.cal_date""",
    "descendants": "SELECT * FROM descendants",
    "conflict_pairs": "SELECT left_key, right_key, shared_atomic_count FROM pairs",
    "components": "SELECT segment_id, component_id FROM sets JOIN parts USING (segment_key)",
    "hierarchy_adjust_strict": """
        SELECT segment_id, round(score, 6) AS anomaly_score, round(score / base_score, 6) AS hierarchy_factor, round(best_score, 6) AS hierarchy_best_group_score, round(capture, 6) AS hierarchy_capture,
               round(cap, 6) AS hierarchy_score_cap, round(u, 6) AS hierarchy_unidirectionality, round(dominant_share, 6) AS hierarchy_dominant_share, round(b_max, 6) AS hierarchy_balance_max,
               round(b_eff, 6) AS hierarchy_balance_eff, round(u * least(b_max, b_eff), 6) AS hierarchy_coherence, n_desc::INT AS hierarchy_descendant_count, n_groups AS hierarchy_group_count,
               to_json(ids)::VARCHAR AS hierarchy_best_group_ids, cap_applied AS hierarchy_cap_applied, same_direction AS hierarchy_same_direction FROM nodes""",
    "hierarchy_groups_strict": """
        SELECT segment_id, n_desc AS descendant_count, n_groups AS group_count, round(best_score, 6) AS group_score, to_json(ids)::VARCHAR AS group_ids FROM nodes WHERE n_desc > 0""",
    "set_packing_selected_strict": """
        SELECT segment_id, component_id, selected, CASE WHEN selected THEN 'SET_PACKING_SELECTED' ELSE 'SET_PACKING_NOT_SELECTED' END AS set_packing_status, global_status AS set_packing_global_status,
               CASE WHEN selected THEN len(atoms) ELSE 0 END AS selected_atomic_count FROM solved, overall""",
    "packing_frontier_strict": "SELECT component_id, segment_id, selected FROM solved",
    "final_ranked_strict": "SELECT rank::INT AS rank, segment_key, round(score, 6) AS anomaly_score FROM final",
    "decision_log_strict": """
        SELECT 'GLOBAL_OPTIMIZATION_SUMMARY' AS event_type, (SELECT count(*) FROM proof) AS component_count, (SELECT count(*) FROM final) AS selected_count, round((SELECT coalesce(sum(objective_value), 0) FROM proof), 6) AS objective_value,
               round((SELECT coalesce(sum(best_bound), 0) FROM proof), 6) AS best_bound, round((SELECT coalesce(sum(absolute_gap), 0) FROM proof), 6) AS absolute_gap, round((SELECT coalesce(max(relative_gap), 0) FROM proof), 6) AS relative_gap,
               global_status, global_status AS solver_status, NULL AS atomic_segment_id, NULL::BIGINT AS segment_count, NULL AS segment_keys, NULL AS left_segment_id, NULL AS left_segment_key, NULL AS right_segment_id,
               NULL AS right_segment_key, NULL::BIGINT AS shared_atomic_count, NULL AS component_id, NULL::BIGINT AS atom_count, NULL::BIGINT AS conflict_pair_count, NULL::INT AS min_depth, NULL::INT AS max_depth,
               NULL::DOUBLE AS score_sum, NULL::DOUBLE AS score_min, NULL::DOUBLE AS score_max, NULL::DOUBLE AS score_dynamic_range, NULL AS solver_name, NULL AS segment_id, NULL AS segment_key, NULL::INT AS slice_depth,
               NULL::DOUBLE AS anomaly_score, NULL::BOOLEAN AS selected FROM overall
        UNION ALL BY NAME SELECT 'ATOM_TO_SEGMENTS' AS event_type, atom_id AS atomic_segment_id, count(*) AS segment_count, string_agg(segment_key, ' || ' ORDER BY segment_key) AS segment_keys FROM eligible GROUP BY atom_id
        UNION ALL BY NAME SELECT 'CONFLICT_PAIR' AS event_type, left_id AS left_segment_id, left_key AS left_segment_key, right_id AS right_segment_id, right_key AS right_segment_key, shared_atomic_count FROM pairs
        UNION ALL BY NAME SELECT 'COMPONENT_SOLVE' AS event_type, component_id, segment_count, atom_count, conflict_pair_count, min_depth, max_depth, solver_name, solver_status, round(score_sum, 6) AS score_sum, round(score_min, 6) AS score_min,
               round(score_max, 6) AS score_max, round(objective_value, 6) AS objective_value, round(best_bound, 6) AS best_bound, round(absolute_gap, 6) AS absolute_gap, round(relative_gap, 6) AS relative_gap,
               round(score_dynamic_range, 6) AS score_dynamic_range FROM proof
        UNION ALL BY NAME SELECT 'SEGMENT_DECISION' AS event_type, component_id, segment_id, segment_key, slice_depth, round(score, 6) AS anomaly_score, selected, solver_name, solver_status, global_status
               FROM solved s JOIN (SELECT component_id, solver_name, solver_status FROM proof) USING (component_id), overall""",
    "history_selected_strict": """
        SELECT segment_id, segment_key, slice_depth, cal_date, round(gmv, 4) AS gmv, round(total_gmv, 4) AS total_gmv, round(gmv / total_gmv, 8) AS share_in_total,
               round(gmv / total_gmv - lag(gmv / total_gmv) OVER (PARTITION BY segment_id ORDER BY cal_date), 8) AS share_delta, row_missing_in_source
        FROM panel JOIN (SELECT cal_date, sum(gmv) AS total_gmv FROM panel WHERE slice_depth = 0 GROUP BY cal_date) USING (cal_date)
        WHERE segment_id IN (SELECT segment_id FROM final)""",
    "analysis_sheet_strict": """
        SELECT s.segment_key AS segment, s.slice_depth AS depth, round(c.robust_z, 2) AS z_scope, c.z_scale_source, c.z_scale_source = 'SIGMA_FLOOR' AS z_uses_sigma_floor, round(s.base_score, 6) AS base_anomaly_score,
               s.n_desc::INT AS hierarchy_eligible_descendant_count, s.n_groups AS hierarchy_group_count, len(s.ids)::INT AS hierarchy_best_group_size, to_json(s.ids)::VARCHAR AS hierarchy_best_group_ids_json,
               to_json(coalesce((SELECT list(k.segment_key ORDER BY k.segment_id) FROM sets k WHERE list_contains(s.ids, k.segment_id)), []))::VARCHAR AS hierarchy_best_group_segment_keys,
               round(s.best_score, 6) AS hierarchy_best_group_score, round(u, 6) AS hierarchy_direction_unity, round(dominant_share, 6) AS hierarchy_dominant_share, round(b_max, 6) AS hierarchy_balance_max,
               round(b_eff, 6) AS hierarchy_balance_effective, round(least(b_max, b_eff), 6) AS hierarchy_balance, round(u * least(b_max, b_eff), 6) AS hierarchy_coherence,
               round(0.3 * (u * least(b_max, b_eff) - 0.5), 6) AS hierarchy_coherence_adjustment, round(capture, 6) AS hierarchy_single_child_capture, same_direction AS hierarchy_single_child_direction_match,
               round(uncapped, 6) AS hierarchy_single_child_uncapped_score, round(cap, 6) AS hierarchy_dominance_cap_score, rule AS hierarchy_dominance_rule_matches, cap_applied AS hierarchy_dominance_cap_applied,
               CASE WHEN rule THEN (SELECT k.segment_key FROM sets k WHERE k.segment_id = s.ids[1]) ELSE '' END AS hierarchy_dominant_child_segment, round(s.score / s.base_score, 6) AS hierarchy_score_factor,
               round(s.score, 6) AS anomaly_score, selected, p.solver_status = 'OPTIMAL' AS is_resolved, CASE WHEN selected THEN 'SET_PACKING_SELECTED' ELSE 'SET_PACKING_NOT_SELECTED' END AS set_packing_status,
               CASE WHEN selected THEN 'part of the proven optimum (gap 1e-09): ' ELSE 'lost to a disjoint set of at least the same score: ' END || 'component ' || s.component_id || ', solver ' || p.solver_name || ', status ' || p.solver_status AS set_packing_reason,
               global_status AS set_packing_global_status, s.component_id AS set_packing_component_id, p.solver_name AS set_packing_solver, p.solver_status AS set_packing_solver_status,
               round(absolute_gap, 6) AS set_packing_abs_gap, round(relative_gap, 6) AS set_packing_rel_gap, round(score_min, 6) AS set_packing_component_score_min, round(score_max, 6) AS set_packing_component_score_max,
               round(score_dynamic_range, 6) AS set_packing_component_score_dynamic_range, coalesce(x.n, 0) AS conflict_count, coalesce(x.others, '') AS conflict_segment_keys,
               CASE WHEN selected THEN len(s.atoms) ELSE 0 END AS selected_atomic_count, CASE WHEN f.rank <= 10 THEN f.rank::INT END AS manager_rank,
               CASE WHEN f.rank <= 10 THEN 'shown to the manager' WHEN selected THEN 'selected, but below the 10 facts of the manager'
                    ELSE 'lost to a disjoint set of at least the same score: component ' || s.component_id || ', solver ' || p.solver_name || ', status ' || p.solver_status END AS manager_exclusion_reason,
               round_even(c.wow_delta_gmv, 0)::BIGINT AS delta_gmv
        FROM solved s JOIN candidates c USING (segment_id) JOIN proof p ON p.component_id = s.component_id LEFT JOIN clash x ON x.key = s.segment_key LEFT JOIN final f USING (segment_id), overall""",
    "manager_summary_strict": """
        SELECT '1 heading' AS section, 1 AS row_no, 'total' AS segment_key, round(sum(gmv), 4) AS wow_delta_gmv, '' AS direction,
               'total GMV of the current window: ' || replace(format('{:,}', round_even(sum(gmv), 0)::BIGINT), ',', ' ') AS interpretation FROM panel, bounds WHERE slice_depth = 0 AND cal_date = cur
        UNION ALL SELECT '2 brief', 1, segment_key, round(wow_delta_gmv, 4), CASE WHEN wow_delta_gmv > 0 THEN 'up' ELSE 'down' END,
               'GMV of the segment went ' || CASE WHEN wow_delta_gmv > 0 THEN 'up' ELSE 'down' END || ' against the window before' FROM final WHERE rank = 1
        UNION ALL SELECT '3 facts', rank::INT, segment_key, round(wow_delta_gmv, 4), CASE WHEN wow_delta_gmv > 0 THEN 'up' ELSE 'down' END,
               'GMV of the segment went ' || CASE WHEN wow_delta_gmv > 0 THEN 'up' ELSE 'down' END || ' against the window before' FROM final WHERE rank <= 10
        UNION ALL SELECT '4 structure', row_no::INT, segment_key, round(wow_delta_gmv, 4), state, state FROM structure""",
    "structure_changes": "SELECT row_no::INT AS row_no, state, segment_key, round(wow_delta_gmv, 4) AS wow_delta_gmv FROM structure",
    "control_table_strict": """
        SELECT metric, round(value, 4) AS value, NULL::VARCHAR AS text FROM control UNION ALL SELECT 'set_packing_global_status', NULL, global_status FROM overall""",
    "dag_edges": _EDGES,
}


def _needed(sql: str) -> list[str]:
    """Table expressions that a query reads, in order."""
    found, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & _CTES.keys() - found:
            found.add(name)
            todo.append(_CTES[name])
    return [name for name in _CTES if name in found]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in _QUERIES.items():
        strict = name.endswith("_strict")
        least = {"{least_z}": "3" if strict else "2", "{least_share}": "0.005" if strict else "0.0001"}
        # each expression that several others read is evaluated once
        ctes = ",\n".join(f"{n} AS {'' if n.startswith(('groups', 'reach', 'choices')) else 'MATERIALIZED '}({_CTES[n].strip()})" for n in _needed(sql))
        for mark, value in least.items():
            ctes = ctes.replace(mark, value)
        out[name] = f"WITH RECURSIVE {ctes}\n{sql.strip()}"
    return out
