"""What queries and ledger runs tell of themselves: rows, durations, amounts, successes."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Metrics:
    """Counters and histograms of one driver. Rows are counted where they flow by, in the query's own
    job (``observe``); durations are those of the action, which the caller times."""

    def __init__(self) -> None:
        self.counters: dict[str, int] = defaultdict(int)
        self.histograms: dict[str, list[float]] = defaultdict(list)
        self._observed: list[tuple[str, Observation]] = []

    def observed(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, whose rows are counted as ``name`` by the first action on it."""
        seen = Observation()
        self._observed.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> dict[str, int]:
        """Rows by name of all observed queries; each must have run, as this waits for it."""
        for name, seen in self._observed:
            self.counters[f"{name}.rows"] += seen.get["rows"]
        self._observed = []
        return {k: n for k, n in self.counters.items() if k.endswith(".rows")}

    def count(self, name: str, n: int = 1) -> None:
        self.counters[name] += n

    def record(self, name: str, value: float) -> None:
        self.histograms[name].append(value)

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        """Put the milliseconds of what stands inside into the histogram ``name.duration_ms``."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record(f"{name}.duration_ms", 1000 * (time.perf_counter() - began))
