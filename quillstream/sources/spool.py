"""The event spool: an append-only table of events with a queue status, as transitions of DataFrames.

Rows: id, session_id, status (new, processing, done, dead), attempts, claimed_by, claimed_at (epoch seconds), and
whatever else an event carries. Order is the order of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream import session
from quillstream.functions import capture

STATUSES = ("new", "processing", "done", "dead")


def append(spool: DataFrame, events: DataFrame, most: int | None = None) -> DataFrame:
    """Adds events whose id is not there yet, as new. With `most`, a JSON content of more bytes is cut to them, and the
    event's source_refs name its session, where the whole is."""
    if most:
        session.ship(events.sparkSession)
        large = F.octet_length("content") > most
        ref = F.concat(F.lit("session:"), F.coalesce("session_id", F.lit("")))
        refs = F.array_union(F.coalesce("source_refs", F.array().cast("array<string>")), F.array(ref)) if "source_refs" in events.columns else F.array(ref)
        old = F.col("source_refs") if "source_refs" in events.columns else F.array().cast("array<string>")
        events = events.withColumns({"source_refs": F.when(large, refs).otherwise(old), "content": F.when(large, capture.truncated(F.col("content"), F.lit(most))).otherwise(F.col("content"))})
    return _added(spool, events, "new")


def append_claimed(spool: DataFrame, events: DataFrame, worker: str, now: float) -> DataFrame:
    """Adds events whose id is not there yet as processing, for a worker that handles them itself."""
    return _added(spool, events.withColumns({"claimed_by": F.lit(worker), "claimed_at": F.lit(now)}), "processing")


def _added(spool: DataFrame, events: DataFrame, status: str) -> DataFrame:
    fresh = events.dropDuplicates(["id"]).join(spool.select("id"), "id", "left_anti")
    return spool.unionByName(fresh.withColumns({"status": F.lit(status), "attempts": F.lit(0)}), allowMissingColumns=True)


def get(spool: DataFrame, id: str, schema: str | None = None) -> DataFrame:
    """The event of an id; with a schema its JSON content is read as a struct."""
    row = spool.where(F.col("id") == id)
    return row.withColumn("content", F.from_json("content", schema)) if schema else row


def list_rows(spool: DataFrame, limit: int, session_id: str | None = None, status: str | None = None) -> DataFrame:
    """The newest `limit` events of a session or status, the oldest of them first."""
    rows = spool if session_id is None else spool.where(F.col("session_id") == session_id)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("id")).limit(limit).orderBy("id")


def claim(spool: DataFrame, limit: int, worker: str, now: float, reclaim_after: float = 300.0, max_attempts: int = 3) -> DataFrame:
    """Expired claims go back (or die), then the oldest new rows are processing."""
    stale = (F.col("status") == "processing") & (F.col("claimed_at") < now - reclaim_after)
    tries = F.when(stale, F.col("attempts") + 1).otherwise(F.col("attempts"))
    status = F.when(stale & (F.col("attempts") + 1 >= max_attempts), "dead").when(stale, "new").otherwise(F.col("status"))
    rows = spool.withColumns({"attempts": tries, "status": status})
    oldest = rows.where("status = 'new'").select("id").orderBy("id").limit(limit).withColumn("_mine", F.lit(True))
    mine = F.coalesce(F.col("_mine"), F.lit(False))
    got = rows.join(oldest, "id", "left")
    return got.withColumns({"status": F.when(mine, "processing").otherwise(F.col("status")), "claimed_by": F.when(mine, worker).otherwise(F.col("claimed_by")), "claimed_at": F.when(mine, now).otherwise(F.col("claimed_at"))}).drop("_mine")


def _move(spool: DataFrame, ids: DataFrame, change: dict) -> DataFrame:
    hit = spool.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in change.items()}).drop("_hit")


def mark_done(spool: DataFrame, ids: DataFrame) -> DataFrame:
    return _move(spool, ids, {"status": F.lit("done")})


def mark_failed(spool: DataFrame, ids: DataFrame, max_attempts: int = 3) -> DataFrame:
    return _move(spool, ids, {"status": F.when(F.col("attempts") + 1 >= max_attempts, "dead").otherwise("new"), "attempts": F.col("attempts") + 1})


def release(spool: DataFrame, ids: DataFrame) -> DataFrame:
    return _move(spool, ids, {"status": F.lit("new")})


def stats(spool: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Rows per status, 0 where there are none. A count per status by one partial aggregate."""
    counts = spool.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).cast("long").alias("n")) for s in statuses])).alias("s")).select("s.*")


def history(spool: DataFrame, n: int, session: str = "session_id", order: str = "id") -> DataFrame:
    """The last n rows of every session; WindowGroupLimit cuts before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return spool.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def events_after(spool: DataFrame, after, limit: int, order: str = "id") -> DataFrame:
    return spool.where(F.col(order) > after).orderBy(order).limit(limit)


def last_event(spool: DataFrame, session: str = "session_id", order: str = "id") -> DataFrame:
    """The newest row of every session, as columns of a map-side combined max_by."""
    rest = [c for c in spool.columns if c != session]
    return spool.groupBy(session).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_e")).select(session, "_e.*")


def prune(spool: DataFrame, finished: str, cutoff) -> DataFrame:
    """Without done rows that finished before the cutoff; dead rows stay."""
    return spool.where(~((F.col("status") == "done") & (F.col(finished) < cutoff)))


def dead_letters(spool: DataFrame) -> DataFrame:
    return spool.where("status = 'dead'")
