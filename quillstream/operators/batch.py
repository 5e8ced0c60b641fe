"""One batch of the queue from claim to commit: episodes, candidates, curation, new versions of pages, a log.

All steps are DataFrame plans. What later steps read more than once (the claimed events, the decisions, the versions) is
written to a folder of the batch and read back, so that a lost executor reruns one step, and a batch that is run again
replaces its own files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstream import session
from quillstream.functions import capture, facts
from quillstream.functions import text as T
from quillstream.operators import audit, classify, curation, gate, retrieval, writing
from quillstream.sources import spool as S
from quillstream.sources import versions, wiki
from quillstream.streaming import episodes as E

LEAST_SCORE = 0.45
INACTIVE = ("superseded", "deprecated", "rejected", "archived")
#: Kinds of pages that hold facts, and what a type of memory may update.
FACTS = ("learning", "incident", "operations", "procedure", "system", "environment", "configuration", "project", "architecture")
MAY_UPDATE = {"user_preference": ("user_preference",), "decision": ("decision",), **{t: FACTS for t in ("learning", "environment", "configuration", "project_fact", "architecture", "procedure", "incident")}}


class Batch(NamedTuple):
    """A batch's results: the queue after it, the new versions of pages, the log of its decisions, and dead events."""

    spool: DataFrame
    written: DataFrame
    log: DataFrame
    dead: DataFrame


@F.pandas_udf(StringType())
def _subject(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(facts.subject_of)


def turns(events: DataFrame, done: DataFrame) -> DataFrame:
    """Complete episodes (session_id, episode_id, events) as turns: session_id, id, user_text, assistant_text, recalled,
    tool_text, failed, recovered. A call that failed is recovered from by a later one of the same program that is ok."""
    json = lambda path: F.get_json_object("content", path)
    each = done.select("session_id", F.col("episode_id").alias("episode"), F.explode("events").alias("id")).join(events.select("id", "event_type", "content"), "id")
    run = F.concat_ws(" ", json("$.tool"), capture.program(json("$.args.command")))
    status = capture.call_status(json("$.status"))
    each = each.withColumns({"_call": F.when(F.col("event_type") == "tool_call", run), "_status": status, "_out": json("$.result_excerpt")})
    tools = each.where("_call is not null").groupBy("episode", "_call").agg(F.min(F.when(F.col("_status") == "failed", F.col("id"))).alias("_bad"), F.max(F.when(F.col("_status") == "ok", F.col("id"))).alias("_good"))
    tools = tools.groupBy("episode").agg(F.max(F.col("_bad").isNotNull()).alias("failed"), F.max(F.coalesce(F.col("_good") > F.col("_bad"), F.lit(False))).alias("recovered"))
    turn = F.col("event_type") == "turn"
    said = each.groupBy("session_id", "episode").agg(*[F.max(F.when(turn, json(f"$.{f}"))).alias(n) for f, n in (("user", "user_text"), ("assistant", "assistant_text"), ("recall", "recalled"))], F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_out").isNotNull(), F.struct("id", "_out")))), lambda x: x["_out"]), "\n").alias("tool_text"))
    return said.join(tools, "episode", "left").withColumnRenamed("episode", "id").withColumns({"failed": F.coalesce("failed", F.lit(False)), "recovered": F.coalesce("recovered", F.lit(False))})


def proposals(told: DataFrame) -> DataFrame:
    """episode_id, session_id, type, destination, ord, text, evidence: the sentences behind each type that the rules find.
    A confirmed proposal is the sentence of the turn before that proposes; what was learnt is what the assistant says."""
    kinds = classify.classify(told).where("remember").select("id", "type", "destination")
    before = F.lag("assistant_text").over(Window.partitionBy("session_id").orderBy("id"))
    rows = told.withColumn("_before", before).join(kinds, "id")
    pick = lambda text, p: F.filter(T.sentences(F.coalesce(text, F.lit(""))), lambda s: s.rlike(p) & ~s.endswith("?"))
    own = {"user_preference": classify.PREFERENCE, "decision": classify.DECIDE, "environment": classify.FACT}
    user = F.array().cast("array<string>")
    for kind, p in own.items():
        user = F.when(F.col("type") == kind, pick(F.col("user_text"), p)).otherwise(user)
    confirmed = F.when((F.col("type") == "decision") & (F.size(user) == 0), F.slice(pick(F.col("_before"), classify.PROPOSE), 1, 1))
    learnt = F.when(F.col("type") == "learning", F.slice(T.sentences(F.coalesce("assistant_text", F.lit(""))), 1, 2))
    mark = lambda texts, evidence: F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda s: F.struct(s.alias("text"), F.lit(evidence).alias("evidence")))
    every = F.concat(mark(user, "user_stated"), mark(confirmed, "user_confirmed"), mark(learnt, "assistant_inferred"))
    return rows.select(F.col("id").alias("episode_id"), "session_id", "type", "destination", F.posexplode(every).alias("ord", "c")).select("episode_id", "session_id", "type", "destination", "ord", "c.*")


def candidates(told: DataFrame) -> DataFrame:
    """Candidates as writing.write takes them (candidate_id is episode and type), with episode_id and refused; a claim that
    the gate refuses is left out, and a candidate without any has no claims. Secrets are masked."""
    session.ship(told.sparkSession)
    claims = proposals(told)
    texts = F.array(*[F.struct(F.lit(k).alias("evidence"), F.col(c).alias("text")) for k, c in (("user_stated", "user_text"), ("tool_observed", "tool_text"), ("shown", "recalled"))])
    sources = told.select(F.col("id").alias("episode_id"), F.explode(texts).alias("s")).select("episode_id", "s.*").where("text is not null")
    # a confirmed proposal is the assistant's sentence, so it is not held against the user's words
    held = gate.attributed(claims.where("evidence <> 'user_confirmed'"), sources).unionByName(claims.where("evidence = 'user_confirmed'").withColumn("refused", F.lit("")))
    label = F.when(F.col("evidence") == "assistant_inferred", "inferred").otherwise("observed")
    claim = F.when(F.col("refused") == "", F.struct("ord", T.shorten(T.redact(F.col("text")), gate.MOST_CHARS).alias("text"), label.alias("label")))
    grouped = held.groupBy("episode_id", "session_id", "type", "destination").agg(F.array_sort(F.collect_list(claim)).alias("_c"), F.array_sort(F.collect_set(F.nullif("refused", F.lit("")))).alias("refused"))
    made = F.slice(F.transform("_c", lambda c: F.struct(c["text"].alias("text"), c["label"].alias("label"))), 1, gate.MOST_CLAIMS)
    rows = grouped.select(F.concat("episode_id", F.lit("/"), "type").alias("candidate_id"), "episode_id", "session_id", "type", "destination", "refused", made.alias("claims"))
    subject = _subject(F.try_element_at(F.col("claims.text"), F.lit(1)))
    none = F.array().cast("array<string>")
    return rows.withColumns({"subject": F.nullif(subject, F.lit("")), "title": F.lit(None).cast("string"), "context": F.lit(None).cast("string"), "tags": none, "refs": F.array(F.concat(F.lit("episode:"), "episode_id"))})


def targets_of(found: DataFrame, pages: DataFrame) -> DataFrame:
    """candidate_id, page_id: an active page of a type that a candidate may update: the one of its subject, else the best
    hit of its claims from LEAST_SCORE on."""
    spark = pages.sparkSession
    allowed = spark.createDataFrame([(t, p) for t, ps in MAY_UPDATE.items() for p in ps], "type string, _may string")
    live = pages.where(~F.coalesce("status", F.lit("")).isin(*INACTIVE))
    may = found.select("candidate_id", "type").join(F.broadcast(allowed), "type").select("candidate_id", "_may")  # 60 rows
    fits = lambda hits: hits.join(live.select("page_id", F.col("type").alias("_may")), "page_id").join(may, ["candidate_id", "_may"], "left_semi").select("candidate_id", "page_id", "score")
    named = audit.by_subject(found.where("subject is not null"), live).withColumn("score", F.lit(1.0))
    asked = found.where("size(claims) > 0").select(F.col("candidate_id").alias("query_id"), F.array_join(F.col("claims.text"), " ").alias("query"))
    text = live.select(F.col("page_id").alias("page"), "title", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ").alias("tags"), F.coalesce("body", F.lit("")).alias("body"))
    hits = retrieval.search(asked, text, 5).where(F.col("score") >= LEAST_SCORE).select(F.col("query_id").alias("candidate_id"), F.col("page").alias("page_id"), "score")
    return curation.targets(found, [fits(named), fits(hits)])


def decided(found: DataFrame, pages: DataFrame, batch: str, day: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(decisions, olds): candidates with page_id, action (create, update, ignore, drop) and the claims that are new to
    their page; and the bullets (page_id, line, note) that their observed claims contradict. `keep` stores a table that both
    need under a name."""
    wish = F.when(F.col("type") == "user_preference", F.lit(writing.PREFERENCES[0]))
    to = found.join(targets_of(found.where("type <> 'user_preference'"), pages), "candidate_id", "left")
    known = pages.select("page_id").where(F.col("page_id") == writing.PREFERENCES[0]).withColumnRenamed("page_id", "_wishes")
    to = to.join(F.broadcast(known), wish == F.col("_wishes"), "left").withColumn("page_id", F.coalesce("_wishes", "page_id")).drop("_wishes")  # one row
    to = keep(to, "targets")
    claim = to.select("candidate_id", "page_id", "session_id", F.posexplode("claims").alias("ord", "c")).select("candidate_id", "page_id", "session_id", "ord", "c.*")
    claim = claim.withColumn("claim_id", F.xxhash64("candidate_id", "ord"))
    there = curation.present_in_text(claim.where("page_id is not null").select("claim_id", "page_id", "text"), pages.select("page_id", wiki.live_body(F.col("body")).alias("body")))
    fresh = keep(claim.join(there, "claim_id", "left_anti"), "fresh")
    new = fresh.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "label"))).alias("_new"))
    bullets = wiki.bullets(pages, "page_id", "body").where("live").select("page_id", F.xxhash64("page_id", "line").alias("claim_id"), "line", "text", F.lit(None).cast("date").alias("superseded_on"))
    sure = fresh.where("label = 'observed' and page_id is not null")
    struck = curation.changes(sure.select("claim_id", "page_id", "text"), bullets).where("kind in ('retracted', 'value')")
    note = F.concat(F.lit(f"superseded {day} by session:"), F.coalesce("session_id", F.lit("?")))
    olds = struck.join(sure.select("claim_id", "session_id"), "claim_id").join(bullets.select(F.col("claim_id").alias("old_id"), "page_id", "line"), "old_id").select("page_id", "line", note.alias("note"))
    rows = to.join(new, "candidate_id", "left")
    action = F.when(F.col("destination").isNull() | (F.col("destination") == "none") | (F.size("claims") == 0), "drop").when(F.col("_new").isNull(), "ignore").when(F.col("page_id").isNotNull(), "update").otherwise("create")
    kept = F.transform(F.coalesce("_new", F.array().cast("array<struct<ord:int,text:string,label:string>>")), lambda c: F.struct(c["text"].alias("text"), c["label"].alias("label")))
    return rows.withColumns({"action": action, "claims": kept, "batch": F.lit(batch)}).drop("_new"), olds


def run(spool: DataFrame, pages: DataFrame, folder: str, batch: str, day: str, now: float, worker: str, limit: int = 200, max_attempts: int = 3, flush: bool = False, find: Callable[[DataFrame], DataFrame] = candidates) -> Batch:
    """Takes the oldest `limit` new events (id, session_id, event_type, ts, content, status, attempts, claimed_by, claimed_at),
    and gives what becomes of them; pages are current versions. `find` makes candidates of turns, by rules or by a model.

    Events of open episodes go back to the queue untouched; those of an episode whose page is refused are tried again and
    die at max_attempts; all others are done. Events outside of any episode are done too. Nothing is stored but under
    `folder`: commit() stores the versions."""
    spark = spool.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/batch={batch}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    queue = kept(S.claim(spool, limit, worker, now, max_attempts=max_attempts), "queue")
    mine = queue.where((F.col("status") == "processing") & (F.col("claimed_by") == worker) & (F.col("claimed_at") == now))
    found = kept(E.episodes(mine.withColumn("kind", F.get_json_object("content", "$.kind")), now, flush), "episodes")
    done, pending = found.where("closed_by <> 'pending'"), found.where("closed_by = 'pending'")
    picked, olds = decided(kept(find(turns(mine, done)), "candidates"), pages, batch, day, kept)
    decisions = kept(picked, "decisions")
    writes = decisions.where("action in ('create', 'update')")
    written = kept(writing.write(pages, writes.drop("page_id"), writes.where("page_id is not null").select("candidate_id", "page_id"), day, worker, kept(olds, "olds")), "written")
    bad = writing.refused(written).select(F.col("page_id").alias("_refused"))
    refs = lambda rows: rows.select("page_id", F.explode("sources").alias("_ref"))
    mark = F.concat(F.lit("episode:"), F.col("episode_id"))
    place = writes.select("candidate_id", "type", mark.alias("_ref")).join(refs(written), "_ref").join(written.select("page_id", F.col("type").alias("_kind")), "page_id")
    kind = F.lit("learning")
    for t, p in writing.PAGE_TYPES.items():
        kind = F.when(F.col("type") == t, p).otherwise(kind)
    made = place.where(F.col("_kind") == kind).groupBy("candidate_id").agg(F.min("page_id").alias("_made"))
    rows = decisions.join(made, "candidate_id", "left").withColumn("page_id", F.coalesce("page_id", "_made")).join(bad, F.col("page_id") == F.col("_refused"), "left")
    stored = F.col("action").isin("create", "update")
    outcome = F.when(stored & F.col("_refused").isNotNull(), "failed").when(F.col("action") == "create", "created").when(F.col("action") == "update", "updated").when(F.col("action") == "ignore", "ignored").otherwise("dropped")
    log = kept(rows.withColumn("outcome", outcome).join(done.select("episode_id", F.col("events").alias("event_ids")), "episode_id").select("batch", "candidate_id", "episode_id", "session_id", "type", "action", "page_id", "claims", "refused", "outcome", "event_ids"), "log")
    failed = log.where("outcome = 'failed'").select(F.explode("event_ids").alias("id")).distinct()
    back = pending.select(F.explode("events").alias("id"))
    after = S.mark_done(queue, mine.select("id").join(failed, "id", "left_anti").join(back, "id", "left_anti"))
    after = S.release(S.mark_failed(after, failed, max_attempts), back)
    after = kept(after, "after")
    ok = written.join(bad, F.col("page_id") == F.col("_refused"), "left_anti")
    return Batch(after, ok, log, S.dead_letters(after).join(queue.where("status = 'dead'").select("id"), "id", "left_anti"))


def commit(pages: DataFrame, result: Batch, folder: str, batch: str) -> None:
    """Stores the pages with the batch's versions in place of their old ones as the current snapshot of a folder."""
    versions.commit(wiki.update_index(pages.select(*writing.PAGE), result.written.select(*writing.PAGE), result.written.limit(0), "page_id"), folder, batch)
