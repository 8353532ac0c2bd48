"""Schemas of the engine's tables; none is ever inferred."""

from __future__ import annotations

EDGES = "src int, dst int"
PARSED_EDGES = "src int, dst int, line long"
VERTICES = "vid int, idx int"
COMPACT_EDGES = "dst_idx int, src_idx int"
DEGREES = "idx int, degree long"
#: tag 1: a = first destination, b = destinations, c = 0; tag 2: a = destination, b = slice, c = slices
TASKS = "tag int, a long, b long, c long, edge_begin long, edge_count long"
STATE = "idx int, out_degree long, rank double"
RANKS = "vertex int, rank double"
TRACE = "iteration int, raw_mass double, delta_l1 double, true_residual_l1 double"
