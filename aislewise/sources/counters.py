"""Counts of what a pass keeps and drops, made by that pass itself."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

LINES = "lines"


class PassCounters:
    """Rows counted by condition while a job reads them; nothing is read a second time.

    Each watched frame has a name and the counter ``lines``, all of its rows, beside its own.  The counts of a
    task are summed with those of the others as it ends.  A map stage that Spark runs again for a lost executor
    counts its rows again; a stage that only writes, as the conversion of a log, counts each row once.
    """

    def __init__(self) -> None:
        self._watched: dict[str, tuple[Observation, tuple[str, ...]]] = {}

    def watch(self, name: str, rows: DataFrame, **conditions: Column) -> DataFrame:
        """``rows`` as they are; those that meet a condition are counted under its name, a row perhaps under several."""
        if name in self._watched:
            raise ValueError(f"{name} is watched already")
        observation = Observation(f"{name}-{uuid.uuid4().hex}")
        self._watched[name] = observation, (LINES, *conditions)
        counters = [F.count_if(condition).alias(counter) for counter, condition in conditions.items()]
        return rows.observe(observation, F.count(F.lit(1)).alias(LINES), *counters)

    def counts(self) -> dict[str, dict[str, int]]:
        """Counts by frame and counter, once the job that reads the frames has run; before that, this waits for it."""
        # What the optimizer knows to be empty is not run at all and has no counts.
        found = {name: (observation.get, counters) for name, (observation, counters) in self._watched.items()}
        return {name: {counter: values.get(counter, 0) for counter in counters} for name, (values, counters) in found.items()}
