"""What a batch of curation did and what it may do next: outcomes, deferrals, numbers, drafts, targets, preferences, edits.

All are DataFrame plans on keys; null keys group as keys of their own, and empty tables give no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions import text as X

#: Outcomes that finish an event, and those that leave it for another try.
FINISHED, RETRIED = ("created", "updated", "ignored", "duplicate", "dropped", "added"), ("deferred", "failed")


def outcomes(log: DataFrame) -> DataFrame:
    """batch, outcome, n, done, failed: how a batch's decisions ended; done and failed are of the whole batch."""
    each = log.groupBy("batch", "outcome").agg(F.count("*").alias("n"))
    whole = log.groupBy("batch").agg(F.count_if(F.col("outcome").isin(*FINISHED)).alias("done"), F.count_if(F.col("outcome").isin(*RETRIED)).alias("failed"))
    return each.join(whole.withColumnRenamed("batch", "_b"), F.col("batch").eqNullSafe(F.col("_b"))).select("batch", "outcome", "n", "done", "failed")


def first_deferral(log: DataFrame) -> DataFrame:
    """The first record of every event that was deferred, by ts, then batch: later tries are not logged again."""
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy("ts", "batch"))
    return log.where("outcome = 'deferred'").withColumn("_n", nth).where("_n = 1").drop("_n")


def next_number(pages: DataFrame, name: str, prefix: str) -> DataFrame:
    """next: one more than the largest number of the names `<prefix>-<number>...`; 1 where there is none. Numbers beyond a
    long are none."""
    found = F.regexp_extract(F.coalesce(name, F.lit("")), rf"^{re.escape(prefix)}-([0-9]+)(?:\D|$)", 1).try_cast("long")
    return pages.agg((F.coalesce(F.max(found), F.lit(0)) + 1).alias("next"))


def merged_drafts(drafts: DataFrame) -> DataFrame:
    """drafts (episode_id, ord, type, subject, claims) of one episode, type and normalised subject as one: the smallest ord,
    the first subject as written, and the claims in order, each text once."""
    rows = drafts.withColumn("_s", X.normalize(F.col("subject")))
    got = rows.groupBy("episode_id", "type", "_s").agg(F.min("ord").alias("ord"), F.min_by("subject", "ord").alias("subject"), F.array_sort(F.collect_list(F.struct("ord", "claims"))).alias("_c"))
    return got.select("episode_id", "ord", "type", "subject", F.array_distinct(F.flatten(F.col("_c.claims"))).alias("claims"))


def chosen_calls(calls: DataFrame, most: int = 8) -> DataFrame:
    """calls (episode_id, id, status): at most `most` of an episode, failures first, then by id; shown in order of ids."""
    nth = F.row_number().over(Window.partitionBy("episode_id").orderBy(F.when(F.col("status") == "failed", 0).otherwise(1), "id"))
    return calls.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def carried_offset(turns: DataFrame, session: str, order: str, offset: str) -> DataFrame:
    """offset of the last turn up to here that has one: a session keeps the date it was told."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn(offset, F.last(offset, ignorenulls=True).over(w))


def by_subject(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidate_id, page_id: the first page by path whose subject or title is a candidate's subject, as keys."""
    key = lambda c: F.btrim(F.regexp_replace(X.normalize(F.col(c)), r"\b(?:the|a|an|our|my|der|die|das)\b\s*", ""))
    names = pages.select("page_id", "path", F.explode(F.array_distinct(F.array(key("subject"), key("title")))).alias("_k")).where("_k <> ''")
    hits = candidates.select("candidate_id", key("subject").alias("_key")).join(names, F.col("_key") == F.col("_k"))
    return hits.groupBy("candidate_id").agg(F.min_by("page_id", F.struct("path", "page_id")).alias("page_id"))


def by_tags(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidate_id, page_id, n: pages that share tags with a candidate (tags arrays), by the tags' counts in the rows of an id.

    n depends on the two sets of tags alone: it is counted once for each pair of different sets, and members of the sets
    are paired by blocks, which are dealt out before they are expanded. So result rows are neither shuffled nor grouped."""
    ours, theirs = _sets(candidates, "candidate_id"), _sets(pages, "page_id")
    left, right = (_sizes(x).select(F.col("of").alias(of), F.explode("set").alias("_x")).select(of, "_x.tag", F.col("_x.m").alias(m)) for x, of, m in ((ours, "_c", "_m"), (theirs, "_p", "_k")))
    shared = left.join(right, "tag").groupBy("_c", "_p").agg(F.sum(F.col("_m") * F.col("_k")).alias("n"))
    blocks = shared.join(_blocks(ours, "candidate_id", "_c", "_a"), "_c").join(_blocks(theirs, "page_id", "_p", "_b"), "_p")
    parts = max(64, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a stated number, as the blocks' size doesn't tell that of the result
    dealt = blocks.repartition(parts, "_c", "_a", "_p", "_b")
    return dealt.select(F.explode("candidate_id").alias("candidate_id"), "page_id", "n").select("candidate_id", F.explode("page_id").alias("page_id"), "n")


def _sets(rows: DataFrame, key: str) -> DataFrame:
    """key, set: of every key its tags with their counts, sorted."""
    each = rows.select(key, F.explode(F.array_distinct("tags")).alias("tag")).where("tag is not null").groupBy(key, "tag").agg(F.count("*").alias("m"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tag", "m"))).alias("set")).withColumnRenamed(key, "key")


def _sizes(sets: DataFrame) -> DataFrame:
    """set, of, size: every set once, its smallest key (in a struct, as a key may be null) and how many have it."""
    return sets.groupBy("set").agg(F.min(F.struct("key")).alias("of"), F.count("*").alias("size"))


def _blocks(sets: DataFrame, key: str, of: str, nth: str, most: int = 4096) -> DataFrame:
    """of, nth, key: the keys of every set in arrays of about `most`."""
    rows = sets.join(_sizes(sets), "set").select(F.col("of").alias(of), F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / most)).alias(nth), "key")
    null = F.array_repeat(F.lit(None).cast(sets.schema["key"].dataType), F.count_if(F.col("key").isNull()).cast("int"))  # collect_list leaves it out
    return rows.groupBy(of, nth).agg(F.concat(F.collect_list("key"), null).alias(key))


def written_after(entries: DataFrame, writes: DataFrame) -> DataFrame:
    """entries (text, event_id) that a later write (id, text) put there again."""
    return entries.join(writes.select(F.col("id").alias("_id"), F.col("text").alias("_t")), (F.col("text") == F.col("_t")) & (F.col("_id") > F.col("event_id")), "left_semi")


def own_rewrites(log: DataFrame) -> DataFrame:
    """text, event_id: of every text that the engine itself wrote to a profile, the newest event behind it."""
    return log.select(F.explode("l1").alias("w"), "event_ids").select(F.col("w.replacement").alias("text"), F.array_max("event_ids").alias("event_id")).where("text is not null").groupBy("text").agg(F.max("event_id").alias("event_id"))


def edited_pages(changes: DataFrame, dirty: DataFrame) -> DataFrame:
    """path, session_id, op: pages that changed outside of curation and that an agent's file_change names; the last one."""
    return changes.join(dirty.select("path").distinct(), "path").groupBy("path").agg(F.max_by(F.struct("session_id", "op"), "id").alias("_e")).select("path", "_e.*")


def preferences(entries: DataFrame, queries: DataFrame, style: str = r"(?i)\b(?:tone|style|language|short|answer|repl)", most: int = 5, share: float = 0.8) -> DataFrame:
    """query_id, ord, entry, rank: a profile's preferences (ord, entry), those that repeat an earlier one left out (its
    tokens hold `share` of theirs, with the same polarity), in order of the words shared with a query and half a word for
    matters of style, then by ord. Profiles are short by their limit; pairs share a token."""
    rows = entries.withColumn("_t", F.array_distinct(X.tokens(F.col("entry")))).withColumn("_n", F.col("entry").rlike(r"(?i)\b(?:not|never|don't|no|nicht|kein|keine|nie)\b"))
    words = rows.select("ord", "_n", F.size("_t").alias("_size"), F.explode("_t").alias("_w"))
    earlier = words.select(F.col("ord").alias("_o"), F.col("_n").alias("_m"), F.col("_w").alias("_v"))
    again = words.join(earlier, (F.col("_w") == F.col("_v")) & (F.col("_o") < F.col("ord")) & (F.col("_n") == F.col("_m"))).groupBy("ord", "_o").agg(F.count("*").alias("_k"), F.max("_size").alias("_size"))
    fresh = rows.join(again.where(F.col("_k") >= share * F.col("_size")).select("ord").distinct(), "ord", "left_anti")
    asked = queries.select("query_id", F.array_distinct(X.tokens(F.col("query"))).alias("_q"))
    word = fresh.select("ord", F.explode("_t").alias("_w")).join(asked.select("query_id", F.explode("_q").alias("_w")), "_w").groupBy("query_id", "ord").agg(F.count("*").alias("_k"))
    every = fresh.withColumn("_one", F.lit(1)).join(asked.select("query_id").withColumn("_one", F.lit(1)), "_one").join(word, ["query_id", "ord"], "left")
    score = F.coalesce("_k", F.lit(0)) + F.when(F.col("entry").rlike(style), 0.5).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_score"), "ord"))
    return every.withColumn("_score", score).withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "ord", "entry", "rank")


def echoes(claims: DataFrame, shown: DataFrame, share: float = 0.6) -> DataFrame:
    """claim_id: claims (claim_id, episode_id, text) that only repeat what the episode was shown (episode_id, text): all
    tokens with digits and `share` of all are there."""
    have = shown.groupBy("episode_id").agg(F.array_distinct(F.flatten(F.collect_list(X.tokens(F.col("text"))))).alias("_have"))
    want = F.array_distinct(X.tokens(F.col("text")))
    rows = claims.join(have, "episode_id").withColumn("_want", want)
    digits = F.filter("_want", lambda t: t.rlike("[0-9]"))
    return rows.where((F.size("_want") > 0) & X.contains_all(F.col("_have"), digits) & (F.size(F.array_intersect("_want", "_have")) >= share * F.size("_want"))).select("claim_id")


def route(destination: Column, status: Column) -> Column:
    """Where a candidate goes: dropped, the profile, or the wiki; what a full profile can't take goes to the wiki."""
    profile = destination.isin("user", "core")
    return F.when(destination.isNull() | (destination == "none"), "dropped").when(profile & (status == "full"), "wiki").when(profile, "profile").otherwise("wiki")


# -- a model's answers ----------------------------------------------------------------------------------------------

_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "life", "subject")] + [T.StructField("claims", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "ev", "old")])))])
DECISION = T.StructType([T.StructField("record", T.BooleanType()), T.StructField("conf", T.DoubleType()), T.StructField("why", T.StringType()), T.StructField("items", T.ArrayType(_ITEM))])


def decision(answer: Column) -> Column:
    """A model's answer as a struct: thoughts and fences go, and what stands between the first and the last brace is read;
    null where that is no JSON."""
    bare = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?(?:</think>|\z)|```\w*", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")), DECISION)


def call_issue(name: Column, arguments: Column, known: list[str]) -> Column:
    """The first reason why a tool call is no valid one, or null: no name, an unknown one, markup in it, or arguments that
    are no JSON object."""
    return F.coalesce(
        F.when(F.coalesce(F.btrim(name), F.lit("")) == "", "no name"),
        F.when(name.rlike(r"[<>{}|\s]"), "markup in the name"),
        F.when(~name.isin(*known), "unknown tool"),
        F.when(arguments.rlike(r"<\|?/?(?:tool_call|function|parameter)"), "markup in the arguments"),
        F.when(F.coalesce(F.btrim(arguments), F.lit("")).rlike(r"(?s)^\{.*\}$") & F.try_parse_json(arguments).isNotNull(), F.lit(None)).otherwise("arguments are no object"),
    )


# -- claims in prose and files --------------------------------------------------------------------------------------

_EACH = re.compile(r"^(?P<what>[^,;]+?)\s+(?P<link>on|at|is|=|:|uses|auf|nutzt)\s+(?P<value>[\w./:-]*[0-9/.][\w./:-]*)$", re.I)


def split_enumeration(sentence: str | None) -> list[str]:
    """`a on 1, b on 2 and c on 3` as a statement each; a sentence that is no such list stays one."""
    text = (sentence or "").strip().rstrip(".")
    parts = [p.strip() for p in re.split(r",\s*(?:and\s+|und\s+)?|\s+(?:and|und)\s+", text) if p.strip()]
    if len(parts) > 1 and all(_EACH.match(p) for p in parts):
        return [f"{p}." for p in parts]
    return [sentence.strip()] if sentence and sentence.strip() else []


def file_claims(path: str | None, content: str | None) -> list[str]:
    """`key = value` and `key: value` lines of a settings file as claims; comments, nested and secret values are left out."""
    if not re.search(r"\.(?:toml|ini|cfg|conf|env|ya?ml|properties)$", path or ""):
        return []
    out = []
    for line in (content or "").split("\n"):
        m = re.match(r"([A-Za-z_][\w.-]*)\s*[:=]\s*[\"']?([^\"'#{}\[\]]+?)[\"']?\s*(?:#.*)?$", line)
        if m and not re.search(r"(?i)pass|secret|token|key$", m[1]):
            out.append(f"In {path} {m[1]} = {m[2].strip()}.")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def enumerated(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(split_enumeration)


@F.pandas_udf(T.ArrayType(T.StringType()))
def claims_of_files(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for path, content in rows:
        yield pd.Series([file_claims(p, c) for p, c in zip(path, content)], dtype=object)


def log_records(decisions: DataFrame, folder: str) -> None:
    """Appends decisions to the log as JSON lines."""
    decisions.write.mode("append").json(folder)


def read_log(spark, folder: str, schema: str, session: str | None = None, last: int | None = None) -> DataFrame:
    """The log's records of a session, the last of them by ts if a number is given, the oldest first."""
    rows = spark.read.schema(schema).json(folder)
    rows = rows if session is None else rows.where(F.col("session_id") == session)
    return rows.orderBy("ts") if last is None else rows.orderBy(F.desc("ts")).limit(last).orderBy("ts")


def dead_letters_to(spool: DataFrame, folder: str) -> None:
    """A copy of every dead event, as JSON lines, by session."""
    spool.where("status = 'dead'").write.mode("append").json(folder)
