"""The last write of each key over a stream, as arbitrary state: one value a key, in a state store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, TimestampType

#: The state store that values of this kind need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Last(StatefulProcessor):
    """Keeps the order and the value of a key's last event. What comes late, or again, changes nothing and gives no row."""

    def __init__(self, key: str, value: str, order: list[str], schema: StructType) -> None:
        self.key, self.value, self.order = key, value, order
        self.held = StructType([schema[c] for c in (*order, value)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.held)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = self.last.get() if self.last.exists() else None
        before = best = tuple(best) if best is not None else None
        rank = lambda t: tuple((x is not None, x) for x in t[: len(self.order)])  # noqa: E731  nulls are least
        for row in rows:
            seen = tuple(row[c] for c in (*self.order, self.value))
            if seen[-1] is not None and (best is None or rank(seen) > rank(best)):
                best = seen
        if best is not None and best != before:
            self.last.update(best)
            yield Row(**{self.key: key[0], **dict(zip((*self.order, self.value), best))})

    def close(self) -> None:
        pass


def last_writes(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key, order and value of each key whose last event has changed, for output mode update: a stream of what review.fold() holds.

    Of events of a key the greatest by order counts; null values are no writes. A null key is a key. The session's state store must
    be PROVIDER. State is a row a key, whatever the number of events.
    """
    # moments are numbers in the state: it gives them back in another form than rows have
    moments = [c for c in order if isinstance(events.schema[c].dataType, TimestampType)]
    rows = events.select(key, *(F.unix_micros(c).alias(c) if c in moments else F.col(c) for c in order), value)
    found = rows.groupBy(F.col(key)).transformWithState(_Last(key, value, order, rows.schema), rows.schema, "Update", "None")
    return found.select(*(F.timestamp_micros(c).alias(c) if c in moments else F.col(c) for c in found.columns))
