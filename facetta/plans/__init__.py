"""Search strategies and experiments."""

from .experiment import best_step, recovery_count, subset_search, sweep, validate_trace
from .strategy import Frontier, beam, exhaustive, greedy, frontier, initial_frontier, trace_frame, write_trace

__all__ = [
    "Frontier", "beam", "best_step", "exhaustive", "frontier", "greedy", "initial_frontier", "recovery_count", "subset_search", "sweep", "trace_frame", "validate_trace", "write_trace",
]
