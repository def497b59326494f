"""Relational operators that Spark has no method for, composed of those it has."""

from .asof import asof_join
from .fixpoint import fixpoint, reachable
from .hints import join_by
from .hotkeys import hot_key_join
from .inequalities import Inequality, inequality_join
from .membership import not_in
from .ordered import ranks_in_order, row_numbers, running_totals_in_order
from .overlaps import overlap_join
from .percentiles import exact_percentile, exact_percentiles
from .ranges import range_join
from .ranks import global_rank
from .sessions import sessionize
from .theta import theta_join
from .topk import top_k_per_group
from .vectors import exact_nearest, nearest_join

__all__ = [
    "Inequality", "asof_join", "exact_nearest", "exact_percentile", "exact_percentiles", "fixpoint", "global_rank", "hot_key_join", "inequality_join", "join_by", "nearest_join", "not_in",
    "overlap_join", "range_join",
    "ranks_in_order", "reachable", "row_numbers", "running_totals_in_order", "sessionize", "theta_join", "top_k_per_group",
]
