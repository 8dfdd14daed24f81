"""Exact search over pairwise disjoint segments of one conflict component.  Atoms are bits."""

from __future__ import annotations

import math
import sys
import time
from dataclasses import dataclass, field

import numpy as np

from driftcube.config import AnomalyThresholds

#: Sums of scores closer than this count as equal, and the tie rules decide.
TIE = 1e-12


@dataclass
class Node:
    """A segment of the component."""

    segment_id: str
    segment_key: str
    depth: int
    is_atom: bool
    delta: float
    base: float
    gross: float
    bits: int
    result: dict = field(default_factory=dict)

    @property
    def order(self) -> tuple[str, int, str]:
        return self.segment_key, self.depth, self.segment_id


class SearchExhausted(RuntimeError):
    pass


def members(mask: int) -> list[int]:
    """Positions of the bits set, ascending."""
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def apart(mask: int, clash: list[int]) -> list[int]:
    """``mask`` by connected parts of the conflict graph."""
    out = []
    while mask:
        part = edge = mask & -mask
        while edge:
            edge = _union(clash[i] for i in members(edge)) & mask & ~part
            part |= edge
        out.append(part)
        mask &= ~part
    return out


def count_disjoint(bits: list[int]) -> int:
    """Number of non-empty sets of pairwise disjoint members: parts without conflicts between them multiply, the member with most conflicts is in or out."""
    clash = [sum(1 << j for j, b in enumerate(bits) if a & b and i != j) for i, a in enumerate(bits)]
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * len(bits) + 2000))
    known: dict[int, int] = {0: 1}

    def count(free: int) -> int:
        if free not in known:
            parts = apart(free, clash)
            if len(parts) > 1:
                known[free] = math.prod(map(count, parts))
            else:
                pick = max(members(free), key=lambda i: (clash[i] & free).bit_count())
                rest = free & ~(1 << pick)
                known[free] = count(rest) + count(rest & ~clash[pick])
        return known[free]

    return count((1 << len(bits)) - 1) - 1


def atom_prices(bits: list[int], scores: list[float], rounds: int = 400) -> dict[int, float]:
    """Prices of atoms by subgradient steps: no disjoint set is worth more than all prices and what scores have above the prices of their atoms."""
    atoms = sorted({b for x in bits for b in _bits(x)})
    if not atoms:
        return {}
    uses = np.array([[bool(x & a) for a in atoms] for x in bits], float)
    worth, price = np.array(scores), np.zeros(len(atoms))
    best, kept, step = float("inf"), price, 1.0
    floor = _greedy(list(range(len(bits))), bits, scores)
    for i in range(rounds):
        free = worth - uses @ price
        value = price.sum() + free[free > 0].sum()
        if value < best - 1e-15:
            best, kept = value, price
        elif i % 20 == 19:
            step /= 2
        slack = 1.0 - uses[free > 0].sum(axis=0)
        norm = (slack**2).sum()
        if norm == 0:
            break
        price = np.maximum(0.0, price - step * (value - floor) / norm * slack)
    return dict(zip(atoms, kept.tolist()))


def _greedy(order: list[int], bits: list[int], scores: list[float]) -> float:
    """Score of the disjoint set that takes what fits in this order."""
    taken, total = 0, 0.0
    for i in order:
        if not bits[i] & taken:
            taken |= bits[i]
            total += scores[i]
    return total


def best_disjoint(bits: list[int], scores: list[float], names: list, most_nodes: int) -> list[int]:
    """Positions of the disjoint set of the highest score; of ties the smallest, then the lowest sorted names.

    Only positive scores count.  Branches on the member with most conflicts,
    solves what falls apart separately, remembers subproblems, and leaves a
    branch whose bound is below what can be had otherwise.  There are two
    bounds, and the lower counts: members that share an atom form a clique,
    which adds at most its best; and the prices of :func:`atom_prices`.  Raises
    SearchExhausted rather than return a set that is not proven best.
    """
    order = sorted((i for i in range(len(bits)) if scores[i] > 0), key=lambda i: (-scores[i], names[i]))
    b, s = [bits[i] for i in order], [scores[i] for i in order]
    clash = [sum(1 << j for j, y in enumerate(b) if x & y and i != j) for i, x in enumerate(b)]
    price = atom_prices(b, s) if len(b) > 12 else {}
    above = [max(0.0, s[i] - sum(price[a] for a in _bits(x))) if price else 0.0 for i, x in enumerate(b)]
    dense = sorted(range(len(b)), key=lambda i: -s[i] / b[i].bit_count())
    known: dict[int, tuple] = {0: (0.0, 0, [])}
    slack = TIE * (1 + sum(s))  # no branch is left for what rounding may have taken from its bound
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * len(b) + 2000))

    def bound(mask: int) -> float:
        total, cliques, inside = 0.0, [], members(mask)
        for i in inside:  # highest score first
            for clique in cliques:
                if clique[0] & b[i]:
                    clique[0] &= b[i]
                    break
            else:
                cliques.append([b[i]])
                total += s[i]
        if not price:
            return total
        return min(total, sum(above[i] for i in inside) + sum(price[a] for a in _bits(_union(b[i] for i in inside))))

    def reached(mask: int) -> float:
        """A score that some disjoint set within ``mask`` has."""
        return max(_greedy(members(mask), b, s), _greedy([i for i in dense if mask >> i & 1], b, s))

    def best(mask: int) -> tuple:
        """(score, size, sorted names) of the best set within ``mask``; names carry their positions."""
        if mask in known:
            return known[mask]
        if len(known) > most_nodes:
            raise SearchExhausted(f"{len(b)} segments: no optimum proven within {most_nodes} nodes")
        parts = apart(mask, clash)
        if len(parts) > 1:
            found = [best(p) for p in parts]
            out = sum(f[0] for f in found), sum(f[1] for f in found), sorted(x for f in found for x in f[2])
        else:
            pick = max(members(mask), key=lambda i: ((clash[i] & mask).bit_count(), s[i]))
            rest = mask & ~(1 << pick)
            left = rest & ~clash[pick]
            if s[pick] + bound(left) < reached(rest) - slack:  # not a tie either
                out = best(rest)
            else:
                inner = best(left)
                out = inner[0] + s[pick], inner[1] + 1, sorted([*inner[2], (names[order[pick]], order[pick])])
                if bound(rest) >= out[0] - slack:
                    other = best(rest)
                    if other[0] > out[0] + TIE or (abs(other[0] - out[0]) <= TIE and other[1:] < out[1:]):
                        out = other
        known[mask] = out
        return out

    return [i for _, i in best((1 << len(b)) - 1)[2]]


def _union(masks) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


#: What a segment without a group of descendants has.
UNADJUSTED = {
    "descendants": 0, "groups": 0, "group_score": 0.0, "factor": 1.0, "capture": None, "cap": None, "cap_applied": False, "same_direction": None, "dominant": None,
    "u": None, "dominant_share": None, "b_max": None, "b_eff": None, "balance": None, "coherence": None,
}


def adjust_hierarchy(nodes: list[Node], t: AnomalyThresholds) -> None:
    """Set every node's ``result``: its score adjusted by its best disjoint descendants, deepest first."""
    for p in sorted(nodes, key=lambda n: (-n.depth, n.segment_id)):
        adjust(p, [n for n in nodes if n.depth > p.depth and n.bits & ~p.bits == 0], t)


def adjust(p: Node, below: list[Node], t: AnomalyThresholds) -> None:
    """Set the ``result`` of ``p`` from its descendants, whose results are known."""
    r = p.result
    if not math.isfinite(p.base) or not math.isfinite(p.delta) or not p.delta:
        raise ValueError(f"segment {p.segment_id}: an eligible segment needs a finite base score and a change, not {p.base} and {p.delta}")
    r.update(UNADJUSTED, group_ids=[], group_keys=[], score=p.base, uncapped=p.base)
    if p.is_atom or not below:
        return
    below = sorted(below, key=lambda n: n.segment_id)
    r["descendants"] = len(below)
    if len(below) > t.max_hierarchy_descendants:
        raise ValueError(f"segment {p.segment_id}: {len(below)} eligible descendants exceed max_hierarchy_descendants={t.max_hierarchy_descendants}")
    bits = [n.bits for n in below]
    r["groups"] = count_disjoint(bits)
    group = [below[i] for i in best_disjoint(bits, [n.result["score"] for n in below], [n.segment_id for n in below], t.max_search_nodes)]
    group.sort(key=lambda n: n.segment_id)
    r["group_ids"], r["group_keys"], r["group_score"] = [n.segment_id for n in group], [n.segment_key for n in group], sum(n.result["score"] for n in group)
    if len(group) == 1:
        _single_child(p, group[0], t)
    else:
        _coherence(p, [n.delta for n in group], t)


def _single_child(p: Node, child: Node, t: AnomalyThresholds) -> None:
    r = p.result
    uncapped = p.base * t.single_child_factor
    cap = child.result["score"] * (1 - t.dominant_child_score_margin)
    capture = min(1.0, child.gross / p.gross) if p.gross > 0 else 0.0
    same = p.delta * child.delta > 0
    rule = same and capture >= t.dominant_child_capture_threshold
    score = min(uncapped, cap) if rule else uncapped
    r.update(uncapped=uncapped, cap=cap, capture=capture, same_direction=same, cap_applied=rule and score < uncapped, score=score, factor=score / p.base if p.base else 1.0, dominant=child.segment_id if rule else None)


def _coherence(p: Node, deltas: list[float], t: AnomalyThresholds) -> None:
    gross, k = sum(map(abs, deltas)), len(deltas)
    shares = [abs(d) / gross for d in deltas]
    clamp = lambda x: max(0.0, min(1.0, x))
    u = abs(sum(deltas)) / gross
    b_max = clamp((1 - max(shares)) / (1 - 1 / k))
    b_eff = clamp((1 / sum(q * q for q in shares) - 1) / (k - 1))
    balance = min(b_max, b_eff)
    coherence = u * balance
    factor = 1 + t.aggregation_bonus_lambda * (coherence - 0.5)
    p.result.update(u=u, dominant_share=max(shares), b_max=b_max, b_eff=b_eff, balance=balance, coherence=coherence, factor=factor, score=p.base * factor, uncapped=p.base * factor)


def constraint_rows(bits: list[int]) -> list[list[int]]:
    """For each atom that two or more segments cover, their positions: at most one of them may be chosen."""
    atoms = sorted({b for x in bits for b in _bits(x)})
    rows = [[i for i, x in enumerate(bits) if x & a] for a in atoms]
    return [r for r in rows if len(r) > 1]


@dataclass(frozen=True)
class Packing:
    """A component's solution, and what proves it."""

    chosen: frozenset[str]
    solver: str
    status: str
    objective: float
    bound: float
    seconds: float
    variables: int
    constraints: int
    message: str = ""

    @property
    def absolute_gap(self) -> float:
        return max(0.0, self.bound - self.objective)

    @property
    def relative_gap(self) -> float:
        return self.absolute_gap / max(abs(self.objective), 1e-12)


def pack(nodes: list[Node], t: AnomalyThresholds) -> Packing:
    """The best set of pairwise disjoint segments by adjusted score."""
    began = time.perf_counter()
    nodes = sorted(nodes, key=lambda n: n.order)
    bits, scores = [n.bits for n in nodes], [n.result["score"] for n in nodes]
    rows, message, status = constraint_rows(bits), "", "OPTIMAL"
    if not rows:
        picked, solver = [i for i, s in enumerate(scores) if s > 0], "TRIVIAL"
        bound = sum(scores[i] for i in picked)
    else:
        most = t.max_search_nodes if len(nodes) > t.max_exact_fallback_size else 1 << 60  # small components are always searched to the end
        try:
            picked, solver = best_disjoint(bits, scores, [n.order for n in nodes], most), "BRANCH_AND_BOUND"
            bound = sum(scores[i] for i in picked)  # the search ends with no branch left above what it found
        except SearchExhausted as stopped:
            if (found := milp(rows, scores, t.set_packing_gap_tolerance)) is None:
                raise
            (picked, bound, status), solver, message = found, "SCIPY_HIGHS", str(stopped)
    objective = sum(scores[i] for i in picked)
    return Packing(frozenset(nodes[i].segment_id for i in picked), solver, status, objective, bound, time.perf_counter() - began, len(nodes), len(rows), message)


def milp(rows: list[list[int]], scores: list[float], gap: float) -> tuple[list[int], float, str] | None:
    """(positions, bound, status) by SciPy's mixed-integer solver, where it is installed and finds a solution; else None."""
    try:
        from scipy.optimize import Bounds, LinearConstraint, milp as solve
    except ImportError:
        return None
    uses = np.zeros((len(rows), len(scores)))
    for i, members in enumerate(rows):
        uses[i, members] = 1.0
    found = solve(-np.array(scores), constraints=LinearConstraint(uses, ub=1.0), integrality=np.ones(len(scores)), bounds=Bounds(0, 1), options={"mip_rel_gap": gap})
    if found.x is None:
        return None
    picked = [i for i, v in enumerate(found.x) if v >= 0.5 and scores[i] > 0]
    return picked, -float(found.mip_dual_bound), "OPTIMAL" if found.status == 0 else "NOT_OPTIMAL"


def _bits(bits: int):
    while bits:
        low = bits & -bits
        yield low
        bits ^= low
