"""Counts of events in windows of time, and first-seen locators, for streams and tables alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of events(ts, event_type, value) by windows of time; in a stream, a window is given once the watermark has passed it, and rows later than `late` behind the newest are left out."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def without_repeats(units: DataFrame, late: str = "2 hours") -> DataFrame:
    """The rows of a stream units(ts, document_id, fingerprint, ...) whose fingerprint its document has not shown within `late`; rows later than that are left out. The state holds the fingerprints of that time alone."""
    return units.withWatermark("ts", late).dropDuplicatesWithinWatermark(["document_id", "fingerprint"])


class Locators(StatefulProcessor):
    """Numbers the fingerprints of a document on. Each is an entry of its own in a map of the state store, and the next number a value: a batch reads and writes what it brings, whatever the document has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "fingerprint string", "number long")
        self.next = handle.getValueState("next", "number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [f for f in sorted({f for batch in rows for f in batch["fingerprint"]}) if not self.known.containsKey((f,))]
        first = self.next.get()[0] if self.next.exists() else 0
        for n, f in enumerate(new, first):
            self.known.updateValue((f,), (n,))
        if new:
            self.next.update((first + len(new),))
        yield pd.DataFrame({"document_id": [key[0]] * len(new), "fingerprint": new, "locator": [f"u{n:04d}" for n in range(first, first + len(new))]}, dtype=object)

    def close(self) -> None:
        pass


def first_seen(units: DataFrame) -> DataFrame:
    """(document_id, fingerprint, locator) for each fingerprint of a stream units(document_id, fingerprint) when it is first seen: numbered on in its document, in the order of fingerprints within a batch. Needs the RocksDB state store."""
    schema = "document_id string, fingerprint string, locator string"
    return units.select("document_id", "fingerprint").groupBy("document_id").transformWithStateInPandas(Locators(), schema, "append", "none")
