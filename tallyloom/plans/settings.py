"""Settings of the queries: what an item is, and thresholds that leave something on the order tables."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Setting:
    item: str = "p_brand"
    min_support: float = 0.003
    min_confidence: float = 0.10
    min_lift: float = 1.0
    thin: int = 30


T1 = Setting()
T2 = Setting(min_confidence=0.01)
T3 = Setting("p_type", 0.02, 0.10, 0.9)
T4 = Setting("p_name", 0.0005, 0.02, 0.9)
SEED, WINDOWS, FOLDS, TRAIN, TOP_K, TOP_N, CLUSTERS = 42, 4, 3, 0.7, 5, 20, 3
