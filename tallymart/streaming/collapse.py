"""Collapse of repeated requests for the same entity in a stream.

A request becomes due when no further request for its entity came for ``quiet`` seconds, or ``longest`` seconds after the first
one. State is kept for each entity, with processing-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET, LONGEST = 10.0, 60.0


def collapse_stream(requests: DataFrame, quiet: float = QUIET, longest: float = LONGEST) -> DataFrame:
    """(entity_id, multiplicity) of streaming ``requests`` (entity_id), each group of requests once when it is due."""

    def collect(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() / 1000
        if state.hasTimedOut:
            _, n = state.get
            state.remove()
            yield pd.DataFrame({"entity_id": [key[0]], "multiplicity": [n]})
            return
        first, n = state.get if state.exists else (now, 0)
        n += sum(len(b) for b in batches)
        if now - first >= longest:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"entity_id": [key[0]], "multiplicity": [n]})
            return
        state.update((first, n))
        state.setTimeoutDuration(max(1, int(1000 * min(quiet, first + longest - now))))

    grouped = requests.select("entity_id").groupBy("entity_id")
    return grouped.applyInPandasWithState(collect, "entity_id long, multiplicity long", "first double, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
