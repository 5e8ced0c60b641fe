"""Writing pages: what a candidate adds to its page, what it strikes there, and new pages, as versions of rows.

pages: page_id, path, type, title, subject, status, confidence, created, updated (dates as yyyy-MM-dd), tags, sources
(array<string>), body, version (int). candidates: candidate_id, session_id, type, title, subject, context, tags, refs
(array<string>: where it comes from), claims (array<struct<text, label>>). A page's text is one value, so the blocks that a
batch adds to one page meet in one row; all else is a join on page_id. Null arrays are empty, null texts are empty;
candidates without claims write nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.sources import wiki

#: Kinds of memory and the pages they go to, the first section of a page, folders that are not the type.
PAGE_TYPES = {"user_preference": "user_preference", "project_fact": "project", "architecture": "architecture", "decision": "decision", "learning": "learning", "procedure": "procedure", "incident": "incident", "environment": "environment", "configuration": "configuration"}
SECTIONS = {"environment": "Facts", "configuration": "Setting", "system": "Overview", "operations": "Procedure", "procedure": "Steps", "architecture": "Overview", "project": "Summary", "user_preference": "Preference", "incident": "Symptoms"}
UPDATES = "## Updates"
PREFERENCES = ("preferences.user-preferences", "preferences/user-preferences.md", "User preferences")
NUMBERED = "ADR"
PAGE = ("page_id", "path", "type", "title", "subject", "status", "confidence", "created", "updated", "tags", "sources", "body", "version")


def _lines(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda c: F.concat(F.lit("- "), F.coalesce(c["text"], F.lit("")), F.lit(" ("), F.coalesce(c["label"], F.lit("observed")), F.lit(")"))), "\n")


def _refs() -> Column:
    own = F.array_compact(F.array(F.concat(F.lit("session:"), F.col("session_id"))))
    return F.array_distinct(F.concat(own, F.coalesce("refs", F.array().cast("array<string>"))))


def provenance(writer: str, day: str) -> Column:
    return F.concat(F.lit(f"_Provenance: {writer}, {day} · "), F.array_join(_refs(), ", "), F.lit("_"))


def struck(pages: DataFrame, olds: DataFrame) -> DataFrame:
    """Pages whose bullets at (page_id, line) of olds are struck through, with a note in their bracket; a line that is no
    live bullet stays as it is. Of several notes for a line the smallest counts."""
    notes = olds.groupBy("page_id", "line").agg(F.min("note").alias("note")).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("line").cast("int"), "note"))).alias("_notes"))
    item, mark = r"^(\s*[-*+]\s+)(?!~~)(.+?)(?:\s*\((observed|inferred|reported|mixed)\))?\s*$", F.lit("; ")

    def line(text: Column, k: Column) -> Column:
        note = F.try_element_at(F.col("_notes"), k)
        label = F.regexp_extract(text, item, 3)
        inside = F.when(label != "", F.concat(label, mark, note)).otherwise(note)
        new = F.concat(F.regexp_extract(text, item, 1), F.lit("~~"), F.regexp_extract(text, item, 2), F.lit("~~ ("), inside, F.lit(")"))
        return F.when(note.isNotNull() & text.rlike(item), new).otherwise(text)

    rows = pages.join(notes, "page_id", "left")
    body = F.array_join(F.transform(F.split("body", "\n"), line), "\n")
    return rows.withColumn("body", F.when(F.col("_notes").isNull(), F.col("body")).otherwise(body)).select(*pages.columns)


def appended(body: Column, block: Column) -> Column:
    """The block at the end of the updates section, before the next heading of level 1 or 2; a section of its own, last,
    where there is none."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"\n+\z", "")
    parts = r"(?s)\A(.*?(?:^|\n)(?i:## updates)[ \t]*(?=\n|\z))(.*?)((?:\n#{1,2}[ \t].*)?)\z"
    own = F.btrim(F.regexp_extract(text, parts, 2), F.lit("\n"))
    inside = F.concat(F.regexp_extract(text, parts, 1), F.lit("\n\n"), F.when(own != "", F.concat(own, F.lit("\n\n"))).otherwise(""), block)
    tail = F.btrim(F.regexp_extract(text, parts, 3), F.lit("\n"))
    with_tail = F.concat(inside, F.when(tail != "", F.concat(F.lit("\n\n"), tail)).otherwise(""), F.lit("\n"))
    return F.when(text.rlike(parts), with_tail).otherwise(F.concat(text, F.lit(f"\n\n{UPDATES}\n\n"), block, F.lit("\n")))


def _with_claims(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.size(F.coalesce("claims", F.array())) > 0)


def updated(pages: DataFrame, candidates: DataFrame, day: str, writer: str, olds: DataFrame | None = None) -> DataFrame:
    """The next version of every page that candidates (with page_id) name: olds (page_id, line, note) are struck, a block
    for each candidate, by candidate_id, ends the updates, its references join the sources. Pages that no candidate names
    and no old is struck on give no row; candidates of unknown pages neither."""
    block = F.concat(F.lit(f"### {day}"), F.coalesce(F.concat(F.lit(" · session:"), F.col("session_id")), F.lit("")), F.lit("\n\n"), _lines(F.col("claims")), F.lit("\n\n"), provenance(writer, day))
    new = _with_claims(candidates).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", block.alias("block"), _refs().alias("refs")))).alias("_new"))
    if olds is not None:
        touched = new.join(olds.select("page_id").distinct(), "page_id", "full")
        rows = struck(pages, olds).join(touched, "page_id")
    else:
        rows = pages.join(new, "page_id")
    body = F.when(F.col("_new").isNull(), F.col("body")).otherwise(appended(F.col("body"), F.array_join(F.col("_new.block"), "\n\n")))
    sources = F.array_distinct(F.concat(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce(F.flatten("_new.refs"), F.array().cast("array<string>"))))
    when = F.when(F.coalesce("created", F.lit("")) <= day, F.lit(day)).otherwise(F.col("updated"))
    return rows.withColumns({"body": body, "sources": sources, "updated": when, "version": F.col("version") + 1}).select(*PAGE)


def _body(kind: Column, title: Column) -> Column:
    context = F.btrim(F.coalesce("context", F.lit("")))
    said = F.when(context != "", context).otherwise("_Not recorded._")
    lead = F.when(context != "", F.concat(context, F.lit("\n\n"))).otherwise("")
    first, rest = _lines(F.slice("claims", 1, 1)), F.when(F.size("claims") > 1, _lines(F.slice("claims", 2, F.greatest(F.size("claims"), F.lit(1))))).otherwise("_Not recorded yet._")
    heading = F.lit("Facts")
    for t, name in SECTIONS.items():
        heading = F.when(kind == t, name).otherwise(heading)
    text = (
        F.when(kind == "decision", F.concat(F.lit("## Context\n\n"), said, F.lit("\n\n## Decision\n\n"), _lines(F.col("claims")), F.lit("\n\n## Consequences\n\n_Not recorded yet._")))
        .when(kind == "learning", F.concat(F.lit("## Observation\n\n"), lead, first, F.lit("\n\n## Fix\n\n"), rest, F.lit(f"\n\n{UPDATES}")))
        .otherwise(F.concat(lead, F.lit("## "), heading, F.lit("\n\n"), _lines(F.col("claims")), F.lit(f"\n\n{UPDATES}")))
    )
    return F.concat(F.lit("# "), title, F.lit("\n\n"), text, F.lit("\n\n"), F.col("_prov"), F.lit("\n"))


def created(pages: DataFrame, candidates: DataFrame, day: str, writer: str) -> DataFrame:
    """New pages for candidates: decisions are numbered on from the largest number there is, other pages of a name that is
    taken get -2, -3 and so on, past the largest in use. All preferences of a batch share the one page of preferences
    (the first, by candidate_id, founds it, the others follow as updates); where it exists they belong to updated(). Unknown
    types make learning pages."""
    kind = F.lit("learning")
    for t, p in PAGE_TYPES.items():
        kind = F.when(F.col("type") == t, p).otherwise(kind)
    claim = F.try_element_at("claims", F.lit(1))["text"]
    named = F.btrim(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("subject"), F.lit("")), claim, F.lit("untitled")))
    rows = _with_claims(candidates).withColumns({"_kind": kind, "_named": named, "_prov": provenance(writer, day)})
    wish, numbered = F.col("_kind") == "user_preference", F.col("_kind") == "decision"
    slug = F.coalesce(F.nullif(T.slugify(F.col("_named")), F.lit("")), F.lit("untitled"))
    rows = rows.withColumns({"_stem": F.when(wish, PREFERENCES[0]).when(numbered, "decision").otherwise(F.concat("_kind", F.lit("."), slug)), "_slug": slug})
    # names in use, with their number: "a.b" is 1, "a.b-3" is 3; a decision's number follows its prefix
    number = F.try_to_number(F.nullif(F.regexp_extract("page_id", r"-([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("long")
    ids = pages.select("page_id", F.when(F.col("type") == "decision", F.lit("decision")).otherwise(F.col("page_id")).alias("_whole"), F.regexp_replace("page_id", r"-[0-9]{1,9}$", "").alias("_cut"), number.alias("_n"), "type")
    plain = ids.where("type is null or type <> 'decision'")
    used = plain.select(F.col("_whole").alias("_stem"), F.lit(1).cast("long").alias("_n")).unionByName(plain.where("_n is not null").select(F.col("_cut").alias("_stem"), "_n")).unionByName(ids.where("type = 'decision'").select(F.lit("decision").alias("_stem"), F.coalesce("_n", F.lit(0).cast("long")).alias("_n")))
    most = used.groupBy("_stem").agg(F.max("_n").alias("_most"))
    nth = F.row_number().over(Window.partitionBy("_stem").orderBy("candidate_id"))
    rows = rows.join(most, "_stem", "left").withColumn("_k", F.coalesce("_most", F.lit(0)) + nth)
    label = F.format_string(f"{NUMBERED}-%04d", F.col("_k"))
    title = F.when(wish, PREFERENCES[2]).when(numbered, F.concat(label, F.lit(": "), F.col("_named"))).otherwise(F.col("_named"))
    tail = F.when(F.col("_k") > 1, F.concat(F.lit("-"), F.col("_k").cast("string"))).otherwise("")
    page_id = F.when(wish, F.lit(PREFERENCES[0])).when(numbered, F.concat(F.lit("decision."), F.lower(label))).otherwise(F.concat("_stem", tail))
    path = F.when(wish, F.lit(PREFERENCES[1])).when(numbered, F.concat(F.lit("decision/"), F.lower(label), F.lit("-"), F.col("_slug"), F.lit(".md"))).otherwise(F.concat("_kind", F.lit("/"), "_slug", tail, F.lit(".md")))
    sure = F.exists("claims", lambda c: F.coalesce(c["label"], F.lit("observed")) == "observed")
    status = F.when(numbered, "accepted").when(wish | sure, "active").otherwise("draft")
    made = rows.withColumns({"page_id": page_id, "_path": path, "_title": title, "_status": status, "_conf": F.when(sure, "medium").otherwise("low"), "_nth": nth})
    first = made.where((F.col("_kind") != "user_preference") | (F.col("_nth") == 1))
    out = first.select("page_id", F.col("_path").alias("path"), F.col("_kind").alias("type"), F.col("_title").alias("title"), "subject", F.col("_status").alias("status"), F.col("_conf").alias("confidence"), F.lit(day).alias("created"), F.lit(day).alias("updated"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), _refs().alias("sources"), _body(F.col("_kind"), F.col("_title")).alias("body"), F.lit(1).alias("version"))
    later = made.where((F.col("_kind") == "user_preference") & (F.col("_nth") > 1))
    more = updated(out.where(F.col("page_id") == PREFERENCES[0]).withColumn("version", F.lit(0)), later, day, writer)
    return out.join(more.select("page_id"), "page_id", "left_anti").select(*PAGE).unionByName(more)


def write(pages: DataFrame, candidates: DataFrame, targets: DataFrame, day: str, writer: str, olds: DataFrame | None = None) -> DataFrame:
    """The rows of all new versions: candidates with a target (candidate_id, page_id) update it, the others found pages.
    Preferences go to the page of preferences where there is one. No row has the version of another row of its page."""
    wishes = pages.where(F.col("page_id") == PREFERENCES[0]).select(F.col("page_id").alias("_wishes")).limit(1)
    rows = candidates.drop("page_id").join(targets.select("candidate_id", "page_id").dropDuplicates(["candidate_id"]), "candidate_id", "left")
    rows = rows.join(F.broadcast(wishes), F.col("type") == "user_preference", "left")  # one row
    rows = rows.withColumn("page_id", F.coalesce("_wishes", "page_id")).drop("_wishes")
    return updated(pages, rows.where("page_id is not null"), day, writer, olds).unionByName(created(pages, rows.where("page_id is null").drop("page_id"), day, writer))


def current(versions: DataFrame) -> DataFrame:
    """The newest version of every page, as columns of a map-side combined max_by."""
    rest = [c for c in versions.columns if c != "page_id"]
    return versions.groupBy("page_id").agg(F.max_by(F.struct(*rest), F.col("version")).alias("_v")).select("page_id", "_v.*")


def refused(written: DataFrame) -> DataFrame:
    """Versions that may not be stored, with why: no id, path or title, a text without heading, an update before its making,
    or a path that leaves the folder."""
    why = [
        F.when(F.coalesce("page_id", F.lit("")) == "", "no id"),
        F.when(F.coalesce("title", F.lit("")) == "", "no title"),
        F.when(F.coalesce("path", F.lit("")) == "", "no path"),
        F.when(F.col("path").rlike(r"^/|(?:^|/)\.\.(?:/|$)"), "path leaves the folder"),
        F.when(~F.coalesce("body", F.lit("")).rlike(r"(?m)^# \S"), "no heading"),
        F.when(F.col("updated") < F.col("created"), "updated before created"),
    ]
    return written.withColumn("issues", F.array_compact(F.array(*why))).where("size(issues) > 0")


def as_file(page: DataFrame) -> DataFrame:
    """path and text, with front matter, of pages."""
    meta = {"id": F.col("page_id"), "type": F.col("type"), "status": F.col("status"), "created": F.col("created"), "updated": F.col("updated"), "confidence": F.col("confidence"), "subject": F.col("subject"), "sources": F.col("sources"), "tags": F.col("tags")}
    return page.select("path", wiki.serialize(meta, F.col("body")).alias("text"))
