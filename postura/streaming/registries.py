"""Registries that are kept by streams: runs, rules, comparisons, inventories and observations.

Each batch of a stream becomes one version of a keyed table.  The version also
records the batch, in one step with its rows, so a batch that Spark repeats
after a failure changes nothing; a change by somebody else in between is seen
and the batch is worked out anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.identity import upsert
from ..operators.inventory import imported
from ..operators.observations import dedupe_ladder
from ..operators.tables import ConcurrentChange, KeyedTable

#: Times that a batch is worked out anew when others change the table meanwhile.
TRIES = 5


def once(table: KeyedTable, stream: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the table becomes change(table, batch), once for each batch of the stream of that name."""

    def apply(batch: DataFrame, number: int) -> None:
        for left in range(TRIES, 0, -1):
            n, folder = table._newest()
            done = table.batches()
            if done.get(stream, -1) >= number:
                return
            try:
                return table.write(change(table._rows(folder), batch), n, done | {stream: number})
            except ConcurrentChange:
                if left == 1:
                    raise

    return apply


def start(rows: DataFrame, table: KeyedTable, stream: str, change: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a table by a stream of rows."""
    return rows.writeStream.foreachBatch(once(table, stream, change)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def first_writer(key: list[str], order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows of a key that is new; the first of a batch (runs by their combined hash, rules and comparisons by their key)."""

    def change(held: DataFrame, batch: DataFrame) -> DataFrame:
        first = batch.groupBy(*key).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        return held.unionByName(first.join(held.select(*key), key, "left_anti").select(*held.columns))

    return change


def last_writer(key: list[str], order: str, keep: tuple[str, ...] = ()) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The newest row of each key; columns in keep stay as they were first (responses, titles and notes, rules)."""
    return lambda held, batch: upsert(held, batch, key, order, keep)


def observations(held: DataFrame, batch: DataFrame) -> DataFrame:
    """Observations that are new by content hash, then by source run, then by id; batch has ord beside the table's columns."""
    keys = ["content_hash", "source_run_uid", "observation_id"]
    new = dedupe_ladder(batch.select("ord", *keys), held.select(*keys)).select("ord")
    return held.unionByName(batch.join(new, "ord", "left_semi").select(*held.columns))


def inventory(now: Column) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Lists of devices, row by row, by MAC, else address."""
    return lambda held, batch: imported(held, batch, now)
