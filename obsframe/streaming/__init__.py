"""Structured Streaming versions of the order-driven flows."""

from obsframe.streaming.flows import (
    complete_stages,
    event_periods,
    ingest,
    prequential_scores,
    replay,
    run_to_table,
)

__all__ = ["complete_stages", "event_periods", "ingest", "prequential_scores", "replay", "run_to_table"]
