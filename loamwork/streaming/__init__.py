"""Streaming forms of windowed aggregates, and totals kept in state."""

from .alerts import JOIN_STATE, followed_by, silence_alerts
from .replay import arriving, last_of_each, replay
from .state import first_of_each, longest_gaps, running_totals, smoothed_levels
from .windows import events_stream, rate_stream, session_totals, windowed_totals

__all__ = [
    "JOIN_STATE", "arriving", "events_stream", "first_of_each", "followed_by", "last_of_each", "longest_gaps", "rate_stream", "replay", "running_totals", "session_totals", "silence_alerts",
    "smoothed_levels", "windowed_totals",
]
