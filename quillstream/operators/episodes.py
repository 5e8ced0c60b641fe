"""Ordered context of events and turns: sessions, as-of joins, tails, pairs, deduplicated boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970; a time without a zone counts in the session's."""
    return F.unix_micros(ts.cast("timestamp"))


def idle_sessions(events: DataFrame, who: str, ts: str, order: str, gap_seconds: int) -> DataFrame:
    """Adds session (from 1): a new one after a gap. Event order is ts, then the id."""
    w = Window.partitionBy(who).orderBy(ts, order)
    gap = micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w)
    return events.withColumn("_new", F.coalesce((gap > gap_seconds * 1_000_000).cast("int"), F.lit(1))).withColumn("session", F.sum("_new").over(w).cast("long")).drop("_new")


def previous(rows: DataFrame, part: str, order: str, flag, value: str, name: str) -> DataFrame:
    """As-of join backward: the value of the last earlier row with the flag."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(flag, F.col(value)), ignorenulls=True).over(w))


def following(rows: DataFrame, part: str, order: str, flag, value: str, name: str) -> DataFrame:
    """As-of join forward: the value of the first later row with the flag. In descending order that is the last one
    before a row, so a running frame does and no frame to the end is looked through again for every row."""
    w = Window.partitionBy(part).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(flag, F.col(value)), ignorenulls=True).over(w))


def range_latest(probes: DataFrame, points: DataFrame, part: str, ts: str, before: int, value: str) -> DataFrame:
    """For each probe its newest point of the last `before` seconds (strictly earlier): an equi-join on (part, bucket of
    `before` seconds), each point in its own and the next bucket, then the condition; no range product."""
    bucket = lambda c: F.floor(micros(c) / (before * 1_000_000))
    p = points.select(F.col(part).alias("_p"), F.col(ts).alias("_ts"), F.col(value).alias("_v"), F.explode(F.array(bucket(F.col(ts)), bucket(F.col(ts)) + 1)).alias("_b"))
    hit = (F.col(part) == F.col("_p")) & (bucket(F.col(ts)) == F.col("_b")) & (F.col("_ts") < F.col(ts)) & (micros(F.col("_ts")) >= micros(F.col(ts)) - before * 1_000_000)
    return probes.join(p, hit).groupBy(*probes.columns).agg(F.max_by("_v", F.struct("_ts", "_v")).alias("latest"))


def boundaries(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by a map-side combined min_by."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_e")).select(*keys, "_e.*")


def new_tail(messages: DataFrame, part: str, order: str) -> DataFrame:
    """Messages from the last user message on, without system messages."""
    last = F.max(F.when(F.col("role") == "user", F.col(order))).over(Window.partitionBy(part))
    return messages.withColumn("_last", last).where((F.col(order) >= F.col("_last")) & (F.col("role") != "system")).drop("_last")


def turn_pairs(messages: DataFrame, part: str, order: str) -> DataFrame:
    """A user message and the assistant message that follows it at once."""
    w = Window.partitionBy(part).orderBy(order)
    nxt = messages.withColumns({"_role": F.lead("role").over(w), "assistant_text": F.lead("text").over(w)})
    return nxt.where("role = 'user' and _role = 'assistant'").withColumnRenamed("text", "user_text").drop("_role", "role")
