"""The spend ledger from its event log: rollups, running budgets, and a replay of what the caps let pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a token, hours that it is valid from its first event, queries a day over all, cost a month over all.
PER_TOKEN, HOURS, PER_DAY, PER_MONTH = 10, 24, 200, 10.0


def daily(events: DataFrame) -> DataFrame:
    return events.where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("queries"), F.round(F.sum("value"), 4).alias("cost"))


def monthly(events: DataFrame) -> DataFrame:
    return events.where("ts is not null").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("queries"), F.round(F.sum("value"), 4).alias("cost"))


def tokens(events: DataFrame, per_token: int = PER_TOKEN, hours: int = HOURS) -> DataFrame:
    """One row per token: issued, expires, used (capped), spent."""
    return events.groupBy("user_id").agg(F.min("ts").alias("issued_at"), F.count("*").alias("asked"), F.round(F.sum("value"), 4).alias("cost")).select("user_id", "issued_at", (F.col("issued_at") + F.expr(f"interval {hours} hours")).alias("expires_at"), F.least("asked", F.lit(per_token)).cast("long").alias("used"), "asked", "cost")


def first_over(events: DataFrame, ceiling: float) -> DataFrame:
    """Each token's running cost and its first event beyond the ceiling: user_id, event_id, total."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    running = events.select("user_id", "event_id", "ts", F.sum("value").over(order).alias("total"))
    return running.where(F.col("total") > ceiling).groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "total")).alias("x")).select("user_id", "x.event_id", F.round("x.total", 4).alias("total"))


def replay(events: DataFrame, per_token: int = PER_TOKEN, hours: int = HOURS) -> DataFrame:
    """user_id, event_id, decision of each event by its token's own limits, in order of time (ties: event_id).

    These limits count events of one token from its first, accepted or not beyond the cap, so they are windows. ``accepted``,
    ``expired`` (at or after the end of validity) or ``over_cap``.
    """
    own = Window.partitionBy("user_id")
    order = own.orderBy("ts", "event_id")
    rows = events.select("user_id", "event_id", "ts", F.min("ts").over(own).alias("issued"), F.row_number().over(order).alias("n"))
    return rows.select("user_id", "event_id", F.when(F.col("ts") >= F.col("issued") + F.expr(f"interval {hours} hours"), "expired").when(F.col("n") > per_token, "over_cap").otherwise("accepted").alias("decision"))


def replay_all(events: DataFrame, per_token: int = PER_TOKEN, hours: int = HOURS, per_day: int = PER_DAY, per_month: float = PER_MONTH) -> DataFrame:
    """The whole gate: token limits, then the day's cap, then the month's cost, in order of blame. user_id, event_id, decision.

    A cap on a day or month depends on what was accepted before in that month, so each month is one ordered pass, with the events
    that the token limits refuse left out first. This state crosses tokens by nature; months are independent.
    """
    mine = replay(events, per_token, hours)
    passing = events.join(mine.where("decision = 'accepted'").select("event_id"), "event_id").select("user_id", "event_id", "ts", "value", F.date_format("ts", "yyyy-MM").alias("month"), F.to_date("ts").cast("string").alias("day"))

    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        used: dict[str, int] = {}
        spent, out = 0.0, []
        for day, cost in zip(rows["day"], rows["value"], strict=True):
            if used.get(day, 0) >= per_day:
                out.append("day_cap")
            elif spent >= per_month:
                out.append("month_cap")
            else:
                used[day] = used.get(day, 0) + 1
                spent += 0.0 if pd.isna(cost) else float(cost)
                out.append("accepted")
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "decision": out})

    gate = passing.groupBy("month").applyInPandas(lambda key, pdf: next(run(key, iter([pdf]))), "user_id long, event_id long, decision string")
    return mine.where("decision <> 'accepted'").unionByName(gate)


def gate(requests: DataFrame, issued: DataFrame, per_token: int = PER_TOKEN) -> DataFrame:
    """token, seq, decision of requests (token, seq, ts, refund) in order of time, by tokens (token, expires_at, revoked_at).

    In order of blame: unknown, revoked, expired, over_cap, accepted. A refund gives one query back, never below none, and is
    ``refunded`` or ``nothing to refund``. What is left of a token depends on all that came before, so each token is one ordered pass;
    it is read as a sorted stream with one counter, however many requests a token has, and only what the first three let pass gets there.
    """
    known = issued.select("token", "expires_at", "revoked_at").withColumn("there", F.lit(True))
    x = requests.select("token", "seq", "ts", "refund").join(known, "token", "left")
    asks = ~F.col("refund")
    blame = F.when(F.col("there").isNull(), "unknown").when(asks & (F.col("revoked_at") <= F.col("ts")), "revoked").when(asks & (F.col("expires_at") <= F.col("ts")), "expired")
    x = x.withColumn("decision", blame)
    open_ = x.where("decision is null").select("token", "seq", "ts", "refund").repartition("token").sortWithinPartitions("token", "ts", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, used = None, 0
        for batch in batches:
            out = []
            for t, refund in zip(batch["token"], batch["refund"], strict=True):
                if t != token:
                    token, used = t, 0
                if refund:
                    out.append("refunded" if used else "nothing to refund")
                    used = max(used - 1, 0)
                else:
                    out.append("accepted" if used < per_token else "over_cap")
                    used = min(used + 1, per_token)
            yield pd.DataFrame({"token": batch["token"], "seq": batch["seq"], "decision": out})

    return x.where("decision is not null").select("token", "seq", "decision").unionByName(open_.mapInPandas(run, "token long, seq long, decision string"))


def newest(issued: DataFrame, n: int) -> DataFrame:
    """The n tokens (token, issued_at) issued last, newest first; ties by token."""
    return issued.orderBy(F.desc("issued_at"), "token").limit(n)
