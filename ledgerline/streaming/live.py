"""The superseding layer over a stream: windows are written when a later value closes them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.scratch import scratch_path

CLOSED = "key long, value string, valid_from timestamp, valid_to timestamp"
#: A key's state: its open value (null: none) and since when, and the newest fact seen. Times are microseconds.
STATE = "value string, since long, newest long, newest_tie long"
#: Keeps states on disk and writes only those that a batch changes.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The windows of a key that a micro-batch closes; what it holds is the key's facts of this batch."""
    facts = pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable")
    value, since, newest, newest_tie = state.get if state.exists else (None, None, None, None)
    closed = []
    for stated, at, tie in zip(facts["value"].tolist(), facts["at"].tolist(), facts["tie"].tolist()):
        if newest is not None and (at, tie) <= (newest, newest_tie):
            raise ValueError(f"key {key[0]}: a fact of {pd.Timestamp(at, unit='us')} came after one of {pd.Timestamp(newest, unit='us')}")
        newest, newest_tie = at, tie
        stated = None if pd.isna(stated) else stated
        if stated != value:
            if value is not None:
                closed.append((key[0], value, since, at))
            value, since = stated, at
    state.update((value, since, newest, newest_tie))
    yield pd.DataFrame(closed, columns=["key", "value", "valid_from", "valid_to"])


def live_windows(facts: DataFrame) -> DataFrame:
    """Windows that a stream of ``key``, ``value`` (null: withdrawn), ``at`` and ``tie`` closes, as a stream.

    Spark keeps a state for each key, and a micro-batch touches the keys that it has facts of. A fact that is older than the newest of its
    key fails the query: history that arrives out of order is refused, as in a live run. Facts of one batch are put in order.
    """
    rows = facts.select("key", "value", F.unix_micros("at").alias("at"), "tie")
    out = rows.groupBy("key").applyInPandasWithState(_advance, "key long, value string, valid_from long, valid_to long", STATE, "append", GroupStateTimeout.NoTimeout)
    return out.select("key", "value", F.timestamp_micros("valid_from").alias("valid_from"), F.timestamp_micros("valid_to").alias("valid_to"))


def closed_windows(stream: DataFrame, label: str) -> DataFrame:
    """Runs a stream of facts over what there is and reads the windows that it closed; all it writes lies in the shared folder."""
    spark: SparkSession = stream.sparkSession
    path = scratch_path(spark, label)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        query = live_windows(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is not None:
            spark.conf.set(name, before)
        else:
            spark.conf.unset(name)
    if query.lastProgress is None:
        return spark.createDataFrame([], CLOSED)
    return spark.read.schema(CLOSED).parquet(f"{path}/out")
