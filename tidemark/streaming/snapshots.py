"""Snapshots as they arrive: each micro-batch of records is diffed against the stored snapshot."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import snapshot
from ..schema import PROBLEM
from ..sources import files

#: The property under which Spark tells a batch its query's id, which its checkpoint keeps.
_QUERY = "sql.streaming.queryId"


def _states(spark: SparkSession, root: str) -> list[dict]:
    """The two stored states, oldest first: slot, how manieth state it is, and query and batch that made it."""
    out = []
    for slot in (0, 1):
        said = files.read_text(spark, f"{root}/state-{slot}/_made.json") if files.exists(spark, f"{root}/state-{slot}") else None
        out.append({"slot": slot, "number": 0, "query": None, "batch": None} | json.loads(said or "{}"))
    return sorted(out, key=lambda s: s["number"])


def follow(records: DataFrame, root: str, checkpoint: str, today) -> StreamingQuery:
    """Apply each batch of a stream of whole snapshots(PROBLEM) to root, once.

    today(batch number) gives the date of a batch. A state is kept with the query and the batch that
    made it, in one folder that is swapped in as a whole: a batch that is replayed after a failure
    starts from the state before its own and replaces what it wrote; one of a new checkpoint goes
    on from the newest state, whatever its number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty(_QUERY)
        older, newer = _states(spark, root)
        again = (newer["query"], newer["batch"]) == (query, number)
        last, to = (older, newer) if again else (newer, older)
        previous = files.table_or_empty(spark, f"{root}/state-{last['slot']}", PROBLEM)
        if batch.isEmpty():  # nothing arrived: the state stays as it is
            return
        d = snapshot.diff(previous, batch, today(number))
        staged = f"{root}/state.staged-{uuid.uuid4().hex}"
        d.snapshot.write.parquet(staged)
        files.write_text(spark, f"{staged}/_made.json", json.dumps({"number": last["number"] + 1, "query": query, "batch": number}))
        d.changes.write.mode("overwrite").parquet(f"{root}/changes/run={query}/batch={number}")
        files.swap(spark, staged, f"{root}/state-{to['slot']}")

    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
