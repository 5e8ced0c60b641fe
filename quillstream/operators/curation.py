"""Curation of claims as joins: presence, contradiction, targets, and history with validity.

Pages are claim rows (page_id, claim_id, text, label, stated_on, superseded_on, superseded_by); superseded claims stay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream import session
from quillstream.functions import facts, updates
from quillstream.functions import text as T
from quillstream.sources import wiki

PRESENT, SAME = 0.75, 0.6
NEGATION = r"\b(?:not|no longer|never|without|kein|keine|nicht|nie)\b"


def present(claims: DataFrame, bullets: DataFrame) -> DataFrame:
    """Claims (claim_id, page_id, text) that their page already states: a bullet has all tokens with digits and PRESENT of
    all tokens. Blocked on the page and a shared token; claims without tokens are present."""
    c = claims.select("claim_id", "page_id", F.array_distinct(T.tokens(F.col("text"))).alias("want"))
    b = bullets.where("superseded_on is null").select(F.col("page_id").alias("_p"), F.col("claim_id").alias("_c"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("_t"))
    pairs = c.select("claim_id", "page_id", F.size("want").alias("n"), F.size(F.filter("want", lambda t: t.rlike("[0-9]"))).alias("digits"), F.explode("want").alias("t")).join(b, (F.col("page_id") == F.col("_p")) & (F.col("t") == F.col("_t")))
    hit = pairs.groupBy("claim_id", "_c").agg(F.count("*").alias("hit"), F.max("n").alias("n"), F.max("digits").alias("digits"), F.count_if(F.col("t").rlike("[0-9]")).alias("digit_hit"))
    found = hit.where((F.col("hit") >= PRESENT * F.col("n")) & (F.col("digit_hit") == F.col("digits"))).select("claim_id").distinct()
    return found.unionByName(c.where(F.size("want") == 0).select("claim_id")).distinct()


def present_in_text(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Claims (claim_id, page_id, text) that the text of their page (page_id, body) states: word for word once normalised,
    or in a run of up to three sentences that has all tokens with digits and PRESENT of all tokens."""
    runs = wiki.sentence_windows(pages, "page_id", "body").select("page_id", F.col("ord").alias("claim_id"), "text", F.lit(None).cast("date").alias("superseded_on"))
    runs = runs.withColumn("claim_id", F.xxhash64("page_id", "claim_id"))
    whole = claims.join(pages.select(F.col("page_id").alias("_p"), T.normalize(F.col("body")).alias("_b")), F.col("page_id") == F.col("_p"))
    literal = whole.where(F.contains("_b", T.normalize(F.col("text"))) & (T.normalize(F.col("text")) != "")).select("claim_id")
    return present(claims, runs).unionByName(literal).distinct()


def explicit(claims: DataFrame, bullets: DataFrame) -> DataFrame:
    """claim_id, old_id: live bullets of a claim's page that it names as superseded (supersedes array<string>): statements
    that hold most of each other's subject. Pairs share the page and a token."""
    session.ship(claims.sparkSession)
    named = claims.select("page_id", "claim_id", F.explode("supersedes").alias("_old")).where("_old is not null")
    live = bullets.where("superseded_on is null and text is not null").select(F.col("page_id").alias("_p"), F.col("claim_id").alias("old_id"), F.col("text").alias("_text"))
    said = named.withColumn("_w", F.explode(F.array_distinct(T.tokens(F.col("_old")))))
    told = live.withColumn("_t", F.explode(F.array_distinct(T.tokens(F.col("_text")))))
    pairs = said.join(told, (F.col("page_id") == F.col("_p")) & (F.col("_w") == F.col("_t"))).select("claim_id", "old_id", "_old", "_text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [updates.contains_both_ways(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "claim_id long, old_id long").distinct()


def missing(claims: DataFrame, bullets: DataFrame) -> DataFrame:
    return claims.join(present(claims, bullets), "claim_id", "left_anti")


def contradictions(claims: DataFrame, bullets: DataFrame) -> DataFrame:
    """claim_id, old_id, slot, old_value, new_value: a live bullet of the same page with other values in a common slot,
    of the same polarity and subject. Blocked on page and slot."""

    def sides(rows: DataFrame, p: str) -> DataFrame:
        v = facts.typed_values(rows, "claim_id", "text").groupBy("claim_id", "slot").agg(F.array_sort(F.collect_set("value")).alias("values"))
        mask = v.groupBy("claim_id").agg(F.flatten(F.collect_list("values")).alias("all"))
        about = rows.select("claim_id", "page_id", "text", F.array_distinct(T.tokens(F.col("text"))).alias("tokens")).join(mask, "claim_id", "left")
        about = about.select("claim_id", "page_id", F.col("text").rlike(f"(?i){NEGATION}").alias("negated"), F.filter("tokens", lambda t: ~t.rlike("[0-9]") & ~t.isin(*facts.NOUNS)).alias("subject"))
        both = v.join(about, "claim_id")
        return both.select(*[F.col(c).alias(p + c) for c in ("claim_id", "page_id", "slot", "values", "negated", "subject")])

    new, old = sides(claims, "n_"), sides(bullets.where("superseded_on is null"), "o_")
    pair = new.join(old, (F.col("n_page_id") == F.col("o_page_id")) & (F.col("n_slot") == F.col("o_slot")))
    hit = pair.where(~F.arrays_overlap("n_values", "o_values") & (F.col("n_negated") == F.col("o_negated")) & (T.jaccard(F.col("n_subject"), F.col("o_subject")) >= SAME))
    return hit.select(F.col("n_claim_id").alias("claim_id"), F.col("o_claim_id").alias("old_id"), F.col("n_slot").alias("slot"), F.array_join("o_values", ",").alias("old_value"), F.array_join("n_values", ",").alias("new_value"))


def supersede(bullets: DataFrame, claims: DataFrame, on: str) -> DataFrame:
    """The next version: missing claims are added, and live bullets that they contradict get superseded_on and _by."""
    new = missing(claims, bullets)
    by = contradictions(new, bullets).groupBy("old_id").agg(F.min("claim_id").alias("_by"))
    old = bullets.join(by, F.col("claim_id") == F.col("old_id"), "left")
    old = old.withColumns({"superseded_on": F.when(F.col("_by").isNotNull(), F.lit(on).cast("date")).otherwise(F.col("superseded_on")), "superseded_by": F.coalesce("superseded_by", "_by")}).drop("_by", "old_id")
    fresh = new.select("page_id", "claim_id", "text", "label", F.lit(on).cast("date").alias("stated_on"), F.lit(None).cast("date").alias("superseded_on"), F.lit(None).cast("long").alias("superseded_by"))
    return old.select(*fresh.columns).unionByName(fresh)


def targets(candidates: DataFrame, rules: list[DataFrame]) -> DataFrame:
    """candidate_id, page_id: the page of the first rule that names one (rules: candidate_id, page_id, score), the best
    score of that rule, then the smallest page; no row where none does (the candidate becomes a page of its own)."""
    every = None
    for k, r in enumerate(rules):
        part = r.select("candidate_id", "page_id", F.lit(k).alias("_k"), "score")
        every = part if every is None else every.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("candidate_id").orderBy("_k", F.desc("score"), "page_id"))
    return every.join(candidates.select("candidate_id"), "candidate_id", "left_semi").withColumn("_r", rank).where("_r = 1").select("candidate_id", "page_id")


def evidence(labels: Column) -> Column:
    kinds = F.collect_set(labels)
    return F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("mixed")


def profile_add(entries: DataFrame, new: DataFrame, limit: int) -> DataFrame:
    """New entries (target, ord, entry) with a status: duplicate, full (with all kept before it over the limit), added."""
    known = entries.select("target", T.normalize(F.col("entry")).alias("_e")).distinct().withColumn("_known", F.lit(True))
    used = entries.groupBy("target").agg(F.sum(F.length("entry") + 3).alias("_used"))
    rows = new.withColumn("_e", T.normalize(F.col("entry"))).join(known, ["target", "_e"], "left").join(used, "target", "left")
    first = F.row_number().over(Window.partitionBy("target", "_e").orderBy("ord")) == 1
    rows = rows.withColumn("_dup", F.coalesce("_known", F.lit(False)) | ~first)
    size = F.when(F.col("_dup"), 0).otherwise(F.length("entry") + 3)
    upto = F.sum(size).over(Window.partitionBy("target").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("status", F.when(F.col("_dup"), "duplicate").when(F.coalesce("_used", F.lit(0)) + upto > limit, "full").otherwise("added")).select("target", "ord", "entry", "status")


def changes(claims: DataFrame, bullets: DataFrame) -> DataFrame:
    """claim_id, old_id, kind (retracted, value, shape), rewritten: how claims change live bullets of their page.

    Pairs share the page and a token (every kind of change needs a shared word), so they are as many as a page's bullets
    at most for each claim. Each pair is compared once; null texts change nothing."""
    session.ship(claims.sparkSession)
    word = lambda c: F.explode(F.array_distinct(T.tokens(F.col(c))))
    live = bullets.where("superseded_on is null and text is not null")
    told = live.select(F.col("page_id").alias("_p"), F.col("claim_id").alias("old_id"), word("text").alias("_t"))
    said = claims.where("text is not null").select("page_id", "claim_id", word("text").alias("_w"))
    pairs = said.join(told, (F.col("page_id") == F.col("_p")) & (F.col("_w") == F.col("_t"))).select("claim_id", "old_id").distinct()
    texts = pairs.join(claims.select("claim_id", F.col("text").alias("_new")), "claim_id").join(live.select(F.col("claim_id").alias("old_id"), F.col("text").alias("_old")), "old_id")
    return texts.select("claim_id", "old_id", "_new", "_old").mapInArrow(_changed, "claim_id long, old_id long, kind string, rewritten string")


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(c, o, updates.change(new, old)) for c, o, new, old in zip(*(b.column(k).to_pylist() for k in range(4)))]
        rows = [(c, o, *x) for c, o, x in found if x]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["claim_id", "old_id", "kind", "rewritten"])


#: Stems and words of entries on how someone wants to be served, which observations never replace.
WISHES = ("prefer", "wish", "want", "like", "dislik", "lov", "hat", "enjoy", "favo[u]?rit", "avoid", "always", "never", "please", "don't", "do not", "can't stand", "tone", "style", "language", "answer", "repl(?:y|ies)", "respon[sd]")
WISH = r"(?i)\b(?:" + "|".join(f"{w}[a-z]*" if w.isalpha() else w for w in WISHES) + r")\b"


def reconcile(entries: DataFrame, claims: DataFrame, limit: int) -> DataFrame:
    """Profile entries (target, ord, entry, written_at) that claims (target, claim_id, text, seen_at) contradict, with a
    status and the replacement: kept_newer if written after the claim was seen; removed if another entry of the
    target says the new text already; full if all replacements up to it would pass the limit; else superseded.

    Wishes stay. Of several claims the latest seen counts, then the largest id. Profiles are short by their limit."""
    rows = entries.where(~F.coalesce("entry", F.lit("")).rlike(WISH)).withColumn("_id", F.xxhash64("target", "ord"))
    old = rows.select(F.col("target").alias("page_id"), F.col("_id").alias("claim_id"), F.col("entry").alias("text"), F.lit(None).cast("date").alias("superseded_on"))
    hits = changes(claims.select(F.col("target").alias("page_id"), "claim_id", "text"), old).where("kind <> 'shape'")
    best = hits.join(claims.select("claim_id", "text", "seen_at"), "claim_id").groupBy("old_id").agg(F.max_by(F.struct("seen_at", F.coalesce("rewritten", "text").alias("new")), F.struct("seen_at", "claim_id")).alias("_b"))
    at = rows.join(best, F.col("_id") == F.col("old_id")).select("target", "ord", "entry", "written_at", "_b.seen_at", F.col("_b.new").alias("replacement"))
    known = entries.select(F.col("target").alias("_t"), F.col("ord").alias("_o"), T.normalize(F.col("entry")).alias("_e"))
    twice = at.join(known, (F.col("target") == F.col("_t")) & (F.col("ord") != F.col("_o")) & (T.normalize(F.col("replacement")) == F.col("_e")), "left_semi").select("target", "ord").withColumn("_twice", F.lit(True))
    used = entries.groupBy("target").agg(F.sum(F.coalesce(F.length("entry"), F.lit(0)) + 3).alias("_used"))
    at = at.join(twice, ["target", "ord"], "left").join(used, "target")
    newer, gone = F.coalesce(F.col("written_at") > F.col("seen_at"), F.lit(False)), F.coalesce("_twice", F.lit(False))
    grown = F.when(newer, 0).when(gone, -F.length("entry") - 3).otherwise(F.length("replacement") - F.length("entry"))
    upto = F.sum(grown).over(Window.partitionBy("target").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    status = F.when(newer, "kept_newer").when(gone, "removed").when(F.col("_used") + upto > limit, "full").otherwise("superseded")
    return at.withColumn("status", status).select("target", "ord", "entry", "status", F.when(F.col("status") == "superseded", F.col("replacement")).alias("replacement"))
