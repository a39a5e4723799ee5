"""Incremental batches and progress as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sheetwright.operators import records


def run_available(spark: SparkSession, source: str, schema: str, verify: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "Record") -> None:
    """Verify the files that are new in ``source`` and append the results to ``target``, once, and stop.

    A batch is written to a folder of its own number, so a batch that is run
    again after a failure replaces what it wrote.  A row that can't be verified
    carries its error and stops nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        verify(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress_stream(events: DataFrame, key: str, order: str, attributes: list[str]) -> DataFrame:
    """The merged progress of each key after each micro-batch: a later update replaces what it names and keeps the rest.

    State per key is one row.  ``order`` is a number; an update older than the
    one that set an attribute does not replace it.
    """
    value_types = {a: events.schema[a].dataType.simpleString() for a in attributes}
    key_type = events.schema[key].dataType.simpleString()
    out = f"`{key}` {key_type}, " + ", ".join(f"`{a}` {t}" for a, t in value_types.items())
    state = ", ".join(f"`{a}` {t}, `{a}_at` double" for a, t in value_types.items())

    def merge(keys, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = list(held.get) if held.exists else [None] * (2 * len(attributes))
        for rows in batches:
            for row in rows.sort_values(order, kind="stable").to_dict("records"):
                for i, a in enumerate(attributes):
                    if not pd.isna(row[a]) and (now[2 * i + 1] is None or row[order] >= now[2 * i + 1]):
                        now[2 * i : 2 * i + 2] = [row[a], float(row[order])]
        held.update(tuple(now))
        yield pd.DataFrame([[keys[0], *now[::2]]], columns=[key, *attributes])

    return events.groupBy(key).applyInPandasWithState(merge, out, state, "update", GroupStateTimeout.NoTimeout)


def queue_progress(records_: DataFrame, events: DataFrame, key: str = "Record") -> DataFrame:
    """Records with their latest progress; pending where there is none."""
    latest = records.latest_progress(events, key, ["updated_at"], ["status", "percent", "message"])
    return records_.join(latest, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))
