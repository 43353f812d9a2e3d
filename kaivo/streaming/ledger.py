"""The ledger as a stream: calendar rollups with a watermark, and per-token caps with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kaivo.operators.ledger import HOURS, PER_TOKEN


def events(spark: SparkSession, folder: str, schema: object) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """day, queries, cost, in tumbling days; rows later than ``late`` don't count."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("queries"), F.round(F.sum("value"), 4).alias("cost"))
    return days.select(F.to_date("w.start").alias("day"), "queries", "cost")


def caps(stream: DataFrame, per_token: int = PER_TOKEN, hours: int = HOURS) -> DataFrame:
    """user_id, event_id, decision as each batch comes; a batch is put in order, events of later batches count as later."""
    life = pd.Timedelta(hours=hours)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, issued = state.get if state.exists else (0, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        issued = pd.Timestamp(issued) if issued else rows["ts"].iloc[0]
        out = []
        for ts in rows["ts"]:
            used += 1
            out.append("expired" if ts >= issued + life else "over_cap" if used > per_token else "accepted")
        state.update((used, str(issued)))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "decision": out})

    return stream.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, decision string", "used long, issued string", "append", GroupStateTimeout.NoTimeout)
