"""Order lines from tables, files, plain lists and a seeded generator."""

from .lines import baskets_from_lists, from_table, from_tpch, normalise
from .synth import Shop, planted_pairs, synthetic_lines

__all__ = ["Shop", "baskets_from_lists", "from_table", "from_tpch", "normalise", "planted_pairs", "synthetic_lines"]
