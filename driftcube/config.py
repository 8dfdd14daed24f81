"""Dimensions of the cube and the thresholds of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

#: The cube's ordered dimensions and its additive and ratio measures.
DIMENSIONS = ("geo", "products", "merchants_type", "is_terminal_or_cpqr")
ADDITIVE = ("gmv", "tx", "au", "am")
RATIOS = {"aov": ("gmv", "tx"), "tpm": ("tx", "am"), "freq": ("tx", "au")}
KEY_SEPARATOR, TOTAL_KEY = " × ", "ИТОГО"


@dataclass(frozen=True)
class AnomalyThresholds:
    min_anomaly_abs: float = 200_000.0
    min_z_score: float = 2.0
    min_materiality_share: float = 1e-4
    sigma_floor: float = 1e-5
    lifecycle_z_score: float = 6.0
    hierarchy_reconciliation_abs_tolerance: float = 1e-4
    aggregation_bonus_lambda: float = 0.3
    single_child_factor: float = 0.85
    max_hierarchy_descendants: int = 25
    dominant_child_capture_threshold: float = 0.80
    dominant_child_score_margin: float = 0.02
    set_packing_gap_tolerance: float = 1e-9
    max_exact_fallback_size: int = 25
    max_manager_facts: int = 10
    #: nodes of the search for one component before it gives up with an error
    max_search_nodes: int = 2_000_000
    #: segments of a component up to which one task holds it; larger ones are adjusted a parent a task and packed by a frontier
    max_group_size: int = 1_000

    def check(self) -> "AnomalyThresholds":
        rules = {
            "sigma_floor": 0 < self.sigma_floor < float("inf"),
            "aggregation_bonus_lambda": 0 <= self.aggregation_bonus_lambda < 2,
            "single_child_factor": 0 < self.single_child_factor <= 1,
            "dominant_child_capture_threshold": 0 <= self.dominant_child_capture_threshold <= 1,
            "dominant_child_score_margin": 0 <= self.dominant_child_score_margin < 1,
            "hierarchy_reconciliation_abs_tolerance": 0 <= self.hierarchy_reconciliation_abs_tolerance < float("inf"),
            "max_manager_facts": self.max_manager_facts >= 1,
        }
        if bad := [name for name, good in rules.items() if not good]:
            raise ValueError(f"thresholds out of range: {', '.join(bad)}")
        return self
