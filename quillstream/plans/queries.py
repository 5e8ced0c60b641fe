"""The engine's queries on the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream import session
from quillstream.functions import capture, commands, dates, facts
from quillstream.functions import text as T
from quillstream.operators import audit as A
from quillstream.operators import classify as K
from quillstream.operators import curation as C
from quillstream.operators import episodes as E
from quillstream.operators import gate as G
from quillstream.operators import pages as P
from quillstream.operators import render
from quillstream.operators import retrieval as R
from quillstream.sources import spool as S
from quillstream.sources import wiki as W
from quillstream.streaming import episodes as streaming

ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ASKED = ("the thing of tion zzunknown", "der schen und ber", "la ment que eau")
_ASK = ", ".join(f"({i}::bigint, '{q}')" for i, q in enumerate(ASKED))
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_QSTOP = ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS)
_W = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
_TOK = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'), lambda w: w not in (" + _STOP + "))"
_STEM = """list_transform({}, lambda w: case when len(w) <= 4 or regexp_matches(w, '[0-9]') then w else
 regexp_replace(case when w like '%ies' and len(w) >= 6 then w[:-4] || 'i' when w like '%ing' and len(w) >= 6 then w[:-4] when w like '%ed' and len(w) >= 5 then w[:-3]
 when w like '%es' and len(w) >= 5 then w[:-3] when w like '%s' and len(w) >= 4 then w[:-2] else w end, '^(.{{4,}})e$', '\\1') end)"""
_TERMS = f"asked(query_id, query) as (values {_ASK}), terms as (select query_id, unnest(list_distinct(list_filter({_W.format('query')}, lambda w: w not in ({_QSTOP})))) as term from asked)"


def query(sql: str | None = None):
    def add(f):
        ALL[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tab(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def asked(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}L, '{q}')" for i, q in enumerate(ASKED))
    return spark.sql(f"select * from values {rows} as t(query_id, query)")


def _coverage_sql(where: str) -> str:
    return f"""with {_TERMS}, docs as (select * from documents {where}),
p as (select doc_id, unnest(list_distinct({_W.format('text')})) as term from docs),
h as (select query_id, doc_id, term from p join terms using (term)),
n as (select count(*) as pages from docs), f as (select query_id, term, count(*) as df from h group by all),
w as (select query_id, term, ln(1 + (pages - coalesce(df, 0) + 0.5::double) / (coalesce(df, 0) + 0.5::double)) as idf, df is not null as known from terms left join f using (query_id, term), n),
t as (select query_id, sum(case when known then idf else idf * {R.UNKNOWN}::double end) as whole from w group by query_id),
s as (select query_id, doc_id, round(least(1.0, sum(idf * {R.BODY_WEIGHT}::double) / any_value(whole)), 4) as score from h join w using (query_id, term) join t using (query_id) group by query_id, doc_id)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s qualify rank <= 20"""


@query(_coverage_sql(""))
def fts_idf_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.idf_coverage(asked(spark), tab(spark, d, "documents"), "doc_id", "text", 20)


@query(_coverage_sql("where lang = 'de'"))
def fts_type_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.idf_coverage(asked(spark), tab(spark, d, "documents").where("lang = 'de'"), "doc_id", "text", 20)


@query(f"with p as (select doc_id, unnest(list_distinct({_W.format('text')})) as term from documents) select term, count(*)::bigint as df from p group by term")
def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return R.document_frequency(tab(spark, d, "documents"), "doc_id", "text")


_BM25 = f"""with {_TERMS}, x as materialized (select doc_id, {_W.format('text')} as w from documents), p as (select doc_id, len(w) as n, unnest(w) as term from x),
h as (select query_id, doc_id, term, count(*) as tf, max(n) as n from p join terms using (term) group by all),
c as (select count(*) as pages, avg(len(w)) as mean from x), f as (select query_id, term, count(*) as df from h group by all),
s as (select query_id, doc_id, round(sum(ln(1 + (pages - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / mean))), 6) as score from h join f using (query_id, term), c group by query_id, doc_id)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s qualify rank <= 20"""


@query(_BM25)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(asked(spark), tab(spark, d, "documents"), "doc_id", "text", 20)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector as a query, and all of them as units of pages."""
    e = tab(spark, d, "embeddings").where("embedding is not null")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return q, e.select(F.col("vec_id").alias("unit"), F.col("label").cast("long").alias("page"), F.col("embedding").alias("vec"))


_SIMS = """s as (select q.vec_id as query_id, e.label::bigint as page, e.vec_id as unit, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::double * x[2]::double)), 6) as sim
from embeddings e, embeddings q where q.vec_id % 100 = 0 and e.embedding is not null)"""
_TOP10 = f"with {_SIMS} select query_id, unit, sim, row_number() over (partition by query_id order by sim desc, unit)::int as rank from s qualify rank <= 10"


@query(_TOP10)
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_topk(*_vectors(spark, d), 10)


@query(f"with {_SIMS}, r as (select *, row_number() over (partition by query_id, page order by sim desc, unit) as r from s qualify r <= 3) select query_id, page, max(sim) as score, string_agg(unit::varchar, ',' order by r) as units from r group by query_id, page")
def dense_best_unit_per_page(spark: SparkSession, d: str) -> DataFrame:
    return R.best_units(R.dense(*_vectors(spark, d), 3, by_page=True), "page")


@query(f"select query_id, unit, round(greatest(0.0, least(1.0, (sim - 0.1::double) / (0.8::double - 0.1::double))), 4) as score from ({_TOP10})")
def score_calibrate(spark: SparkSession, d: str) -> DataFrame:
    return dense_topk(spark, d).select("query_id", "unit", R.calibrate(F.col("sim"), 0.1, 0.8).alias("score"))


@query(f"""with a as ({_coverage_sql('')}), b as ({_BM25}),
u as (select query_id, doc_id, score, 1.0::double / (60 + rank) as rr from a union all select query_id, doc_id, score, 0.5::double / (60 + rank) from b),
f as (select query_id, doc_id, round(sum(rr), 9) as rrf, max(score) as best from u group by query_id, doc_id)
select *, row_number() over (partition by query_id order by rrf desc, best desc, doc_id)::int as rank from f qualify rank <= 10""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse([(fts_idf_topk(spark, d), 1.0), (bm25_topk(spark, d), 0.5)], "doc_id", 10)


FIELD_ASKED = ("the de web thing", "ber fr books", "tion zzunknown")
_FIELD_TERMS = "asked(query_id, query) as (values " + ", ".join(f"({i}::bigint, '{q}')" for i, q in enumerate(FIELD_ASKED)) + f"), terms as (select query_id, unnest(list_distinct(list_filter({_W.format('query')}, lambda w: w not in ({_QSTOP})))) as term from asked)"
_FIELDS = f"""{_FIELD_TERMS}, x as materialized (select doc_id as page, {_W.format('source')} as a, {_W.format('lang')} as b, {_W.format('text')} as c from documents),
p as (select page, len(a) + len(b) + len(c) as n, unnest(a) as term, 8.0::double as w, true as s from x union all select page, len(a) + len(b) + len(c), unnest(b), 4.0::double, true from x union all select page, len(a) + len(b) + len(c), unnest(c), 1.0::double, false from x),
h as (select query_id, page, term, sum(w) as tf, max(n) as n, bool_or(s) as strong from p join terms using (term) group by all),
m as (select count(*) as pages, avg(len(a) + len(b) + len(c)) as mean from x), f as (select query_id, term, count(*) as df from h group by all),
w as (select query_id, term, ln(1 + (pages - coalesce(df, 0) + 0.5::double) / (coalesce(df, 0) + 0.5::double)) as idf, df is not null as known, mean from terms left join f using (query_id, term), m),
t as (select query_id, sum(case when known then idf else idf * {R.UNKNOWN}::double end) as whole from w group by query_id),
g as (select query_id, page, round(sum(idf * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / mean))), 6) as bm25, sum(idf * case when strong then 1.0::double else 0.7::double end) as got from h join w using (query_id, term) group by query_id, page),
o as (select * from g qualify row_number() over (partition by query_id order by bm25 desc, page) <= 100),
r as (select query_id, page, round(least(1.0, got / whole), 4) as score, bm25 from o join t using (query_id)),
hits as (select *, row_number() over (partition by query_id order by score desc, bm25 desc, page)::int as rank from r qualify rank <= 20)"""


def _fielded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = ", ".join(f"({i}L, '{q}')" for i, q in enumerate(FIELD_ASKED))
    pages = tab(spark, d, "documents").select(F.col("doc_id").alias("page"), F.col("source").alias("title"), F.col("lang").alias("tags"), F.col("text").alias("body"))
    return spark.sql(f"select * from values {rows} as t(query_id, query)"), pages


@query(f"with {_FIELDS} select * from hits")
def field_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search(*_fielded(spark, d), 20)


@query(f"""with {_FIELDS}, l as (select query_id, page, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos, coalesce(text, '') as body from hits join documents on doc_id = page),
q as (select query_id, list(term) as want from terms group by query_id),
n as (select *, len(list_intersect(list_distinct({_W.format('line')}), want)) as n from l join q using (query_id)),
b as (select query_id, page, pos, trim(line) as line from n where n > 0 qualify row_number() over (partition by query_id, page order by n desc, pos desc) <= 2),
s as (select query_id, page, string_agg(line, ' … ' order by pos) as s from b group by query_id, page)
select query_id, page, rank, md5(case when s is not null then s[1:420] else coalesce(text, '')[1:200] end) as snippet from hits join documents on doc_id = page left join s using (query_id, page)""")
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    asked_, pages = _fielded(spark, d)
    return R.snippets(R.search(asked_, pages, 20), asked_, pages).select("query_id", "page", "rank", F.md5(F.col("snippet").cast("binary")).alias("snippet"))


@query(f"""with {_FIELDS}, q as (select query_id, list_distinct({_W.format('query')}) as want from asked),
s as (select query_id, page, score as prior, rank as before, len(list_intersect(want, list_distinct({_W.format('coalesce(text, chr(32))[1:2000]')}))) / len(want)::double as score from hits join documents on doc_id = page join q using (query_id)),
v as (select *, row_number() over (partition by query_id order by score desc, before)::int as rank, max(score) over (partition by query_id) as best from s qualify rank <= 10),
u as (select *, max(score) over (partition by query_id) as top from v)
select query_id, page, round(score, 9) as score, prior, rank from u where rank <= 10 and (score >= greatest(0.002, 0.01 * top) or prior >= 0.4)""")
def rerank_accepted(spark: SparkSession, d: str) -> DataFrame:
    asked_, pages = _fielded(spark, d)
    hits = R.rerank(R.search(asked_, pages, 20), asked_, pages.select("page", F.col("body").alias("text")), 10)
    return R.accepted(hits).select("query_id", "page", F.round("score", 9).alias("score"), "prior", "rank")


@query("select * from (select event_id, user_id, event_type from events where event_type = 'error' order by event_id desc limit 25)")
def list_rows_newest(spark: SparkSession, d: str) -> DataFrame:
    e = tab(spark, d, "events").select("event_id", "user_id", F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    return S.list_rows(e, 25, status="error").select("event_id", "user_id", F.col("status").alias("event_type"))


@query("""select conv_id, turn, md5(case when turn % 3 = 0 then trim(coalesce(text, ''), chr(10) || ' ' || chr(9) || chr(13)) else coalesce(text, '') end) as clean, turn % 3 = 0 as found from conversations""")
def printed_calls(spark: SparkSession, d: str) -> DataFrame:
    session.ship(spark)
    planted = F.when(F.col("turn") % 3 == 0, '\nmemory_search(query="x", limit=3)\n{"name": "terminal", "arguments": {"command": "ls"}}').otherwise("")
    rows = tab(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), planted).alias("t"))
    none = F.struct(F.col("t").alias("text"), F.lit(False).alias("found"))
    out = rows.withColumn("_c", F.when(capture.mentions_call(F.col("t")), capture.stripped(F.col("t"))).otherwise(none))
    return out.select("conv_id", "turn", F.md5(F.col("_c.text").cast("binary")).alias("clean"), F.col("_c.found").alias("found"))


@query("select event_id, case event_id % 4 when 0 then 'notes/' || user_id || '.md' when 1 then 'src/' || event_id || '.py' when 2 then 'b' || user_id end as path, case event_id % 4 when 0 then 'write' when 1 then 'update' when 2 then 'move' end as op from events where event_id % 4 <> 3")
def file_change_rows(spark: SparkSession, d: str) -> DataFrame:
    who, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    patch = F.when(k == 1, F.concat(F.lit("*** Update File: src/"), F.col("event_id").cast("string"), F.lit(".py\n@@\n+x"))).otherwise(F.concat(F.lit("*** Move File: a"), who, F.lit(" -> b"), who))
    args = F.when(k == 0, F.to_json(F.struct(F.concat(F.lit("notes/"), who, F.lit(".md")).alias("path")))).otherwise(F.to_json(F.struct(F.lit("patch").alias("mode"), patch.alias("patch"))))
    rows = tab(spark, d, "events").select("event_id", F.when(k == 0, "write_file").when(k == 3, "terminal").otherwise("patch").alias("tool"), args.alias("args"))
    return rows.select("event_id", F.explode(capture.file_changes(F.col("tool"), F.col("args"))).alias("c")).select("event_id", "c.path", "c.op")


_KINDS = ("click", "view", "purchase", "signup", "error", "refund")


@query("with k(status) as (values " + ", ".join(f"('{k}')" for k in _KINDS) + ") select status, count(event_id)::bigint as n from k left join events on event_type = status group by status")
def queue_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.stats(tab(spark, d, "events").withColumnRenamed("event_type", "status"), _KINDS)


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) <= 5")
def history_last_n(spark: SparkSession, d: str) -> DataFrame:
    return S.history(tab(spark, d, "events").select("user_id", "event_id", "event_type"), 5, "user_id", "event_id")


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def last_event_per_session(spark: SparkSession, d: str) -> DataFrame:
    return S.last_event(tab(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("select event_id, user_id, event_type from events where event_id > 100 order by event_id limit 50")
def events_after(spark: SparkSession, d: str) -> DataFrame:
    return S.events_after(tab(spark, d, "events").select("event_id", "user_id", "event_type"), 100, 50, "event_id")


@query("select event_id, event_type from events where not (event_type = 'view' and ts < (select max(ts) from events) - interval 7 day)")
def retention_prune(spark: SparkSession, d: str) -> DataFrame:
    e = tab(spark, d, "events").select("event_id", "event_type", "ts")
    last = e.agg((F.max("ts") - F.expr("interval 7 days")).alias("_cut"))
    status = e.crossJoin(last).withColumn("status", F.when(F.col("event_type") == "view", "done").otherwise("new"))
    return S.prune(status, "ts", F.col("_cut")).select("event_id", "event_type")


@query("""with g as (select *, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as n from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from g)
select user_id, session, count(*)::bigint as n_events, min(event_id) as first_event, max(event_id) as last_event from s group by user_id, session""")
def idle_sessions_30m(spark: SparkSession, d: str) -> DataFrame:
    e = E.idle_sessions(tab(spark, d, "events"), "user_id", "ts", "event_id", 1800)
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as previous_turn from conversations")
def previous_turn_asof(spark: SparkSession, d: str) -> DataFrame:
    return E.previous(tab(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user", "turn", "previous_turn")


@query("select event_id, user_id, first_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by event_id rows between 1 following and unbounded following) as owner_event from events")
def owner_turn_forward_asof(spark: SparkSession, d: str) -> DataFrame:
    return E.following(tab(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", F.col("event_type") == "purchase", "event_id", "owner_event").select("event_id", "user_id", "owner_event")


@query("""select a.event_id, arg_max(b.event_id, (b.ts, b.event_id)) as latest from events a join events b on a.user_id = b.user_id and a.event_type = 'error' and b.event_type = 'click'
and b.ts < a.ts and b.ts >= a.ts - interval 1 hour group by a.event_id""")
def range_backfill_join(spark: SparkSession, d: str) -> DataFrame:
    e = tab(spark, d, "events")
    errors, clicks = e.where("event_type = 'error'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return E.range_latest(errors, clicks, "user_id", "ts", 3600, "event_id").select("event_id", "latest")


@query("select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type")
def session_boundary_dedup(spark: SparkSession, d: str) -> DataFrame:
    return E.boundaries(tab(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("select conv_id, turn, text as user_text, a as assistant_text from (select *, lead(role) over w as r, lead(text) over w as a from conversations window w as (partition by conv_id order by turn)) where role = 'user' and r = 'assistant'")
def user_assistant_turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.turn_pairs(tab(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")


@query("select conv_id, turn, role from (select *, max(case when role = 'user' then turn end) over (partition by conv_id) as m from conversations) where turn >= m and role <> 'system'")
def new_messages_tail(spark: SparkSession, d: str) -> DataFrame:
    return E.new_tail(tab(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


_TOKENS = _STEM.format(_TOK.format("text"))


@query(f"""with i as (select item_id, list_distinct({_TOKENS}) as t from benchmark), e as (select item_id, len(t) as n, unnest(t) as token from i),
s as (select doc_id, unnest(list_distinct({_TOKENS})) as token from documents), h as (select item_id, doc_id, count(*) as hit, max(n) as n from s join e using (token) group by all)
select item_id, doc_id, round(hit / n, 4) as share from h where hit >= 0.8::double * n""")
def contamination_probe(spark: SparkSession, d: str) -> DataFrame:
    return P.contamination(tab(spark, d, "documents"), tab(spark, d, "benchmark"), 0.8)


@query(f"select item_id, array_to_string({_TOKENS}, ' ') as stems from benchmark")
def claim_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tab(spark, d, "benchmark").select("item_id", F.array_join(T.tokens(F.col("text")), " ").alias("stems"))


@query("select sha256(coalesce(text, '')) as hash, min(doc_id) as doc_id, count(*)::bigint as copies from documents group by 1")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tab(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""select doc_id, case when doc_id % 10 = 0 then 'missing' else 'changed' end as state from documents where doc_id % 10 = 0 or doc_id % 10 = 3
union all select doc_id + 1000000000, 'extra' from documents where doc_id % 10 = 1""")
def index_staleness_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = tab(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    old = docs.where("doc_id % 10 <> 0").select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    return P.staleness(old.unionByName(docs.where("doc_id % 10 = 1").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "hash")), docs, "doc_id")


@query("""with l as (select substr(sha256(doc_id::varchar), 1, 1) as b, doc_id::varchar || ' ' || sha256(coalesce(text, '')) as line from documents),
f as (select b, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as d from l group by b) select sum(n)::bigint as n_pages, sha256(string_agg(b || ' ' || d, chr(10) order by b)) as digest from f""")
def wiki_digest(spark: SparkSession, d: str) -> DataFrame:
    return P.digest(tab(spark, d, "documents"), F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return tab(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "body"))


@query(r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line from documents),
s as (select doc_id, line::int as line, trim(substr(trim(regexp_replace(replace(translate(lower(body), 'äöüàáâçèéêëìíîïñòóôùúû', 'aouaaaceeeeiiiinooouuu'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 24), '-') as slug from l),
n as (select *, row_number() over (partition by doc_id, slug order by line) - 1 as n from s) select doc_id, line, case when n = 0 then slug else slug || '-' || n end as anchor from n""")
def anchor_dedup(spark: SparkSession, d: str) -> DataFrame:
    return P.anchors(_lines(spark, d).select("doc_id", "line", T.slugify(F.col("body"), 24).alias("slug")), "doc_id", "line", "slug").select("doc_id", "line", "anchor")


@query(f"""with l as (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: x)) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line from documents),
t as (select doc_id, line::int as line, list_distinct({_TOK.format('text')}) as t from l)
select doc_id, line, len(list_distinct(flatten(list(t) over (partition by doc_id order by line rows between current row and 2 following))))::int as n_tokens from t""")
def three_sentence_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(0, 2)
    toks = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("body"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda x: ~x.isin(*T.STOPWORDS)))
    return _lines(spark, d).withColumn("t", toks).select("doc_id", "line", F.size(F.array_distinct(F.flatten(F.collect_list("t").over(w)))).alias("n_tokens"))


@query("""with l as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) as link from pages) select page_id, link, count(*)::bigint as n from l group by all""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return tab(spark, d, "pages").select("page_id", F.explode(P.html_links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("""with l as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) as link from pages) select distinct page_id, link from l where link not in (select url from pages where url is not null)""")
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    pages = tab(spark, d, "pages")
    links = pages.select("page_id", F.explode(P.html_links(F.col("html"))).alias("link")).distinct()
    return P.broken_links(links, "link", pages, "url")


def _whole(n: str) -> str:
    """SQL: how many of the first n bytes of hex h are whole characters."""
    inner = lambda k: f"substr(h, 2 * ({n} - {k}) + 1, 1) in ('8', '9', 'A', 'B')"
    return f"(case when not {inner(0)} then {n} when not {inner(1)} then {n} - 1 when not {inner(2)} then {n} - 2 else {n} - 3 end)"


_SKIP = "(case when not substr(h, 2 * (n - 40) + 1, 1) in ('8', '9', 'A', 'B') then 0 when not substr(h, 2 * (n - 39) + 1, 1) in ('8', '9', 'A', 'B') then 1 when not substr(h, 2 * (n - 38) + 1, 1) in ('8', '9', 'A', 'B') then 2 else 3 end)"
_HEX = "t as (select doc_id, text, strlen(text) as n, hex(encode(text)) as h from documents)"


@query(f"with {_HEX} select doc_id, case when n <= 80 then text else decode(unhex(substr(h, 1, 2 * {_whole('40')}))) || '…[' || (n - 80) || ' bytes omitted]…' || decode(unhex(substr(h, 2 * (n - 40 + {_SKIP}) + 1))) end as excerpt from t")
def head_tail_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return tab(spark, d, "documents").select("doc_id", T.head_tail(F.col("text"), 80).alias("excerpt"))


@query(f"with {_HEX} select doc_id, case when n <= 64 then text else decode(unhex(substr(h, 1, 2 * {_whole('64')}))) || '…[+' || (n - 64) || ' bytes]' end as excerpt from t")
def truncate_bytes(spark: SparkSession, d: str) -> DataFrame:
    return tab(spark, d, "documents").select("doc_id", T.excerpt(F.col("text"), 64).alias("excerpt"))


@query(f"with a as ({_coverage_sql('')}), b as (select query_id, rank, doc_id, sum(least(len(text), 300)) over (partition by query_id order by rank rows unbounded preceding)::bigint as used from a join documents using (doc_id)) select * from b where used <= 1500")
def prefetch_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = tab(spark, d, "documents").select("doc_id", F.least(F.length("text"), F.lit(300)).alias("size"))
    return R.budget(fts_idf_topk(spark, d).join(docs, "doc_id"), "size", 1500).select("query_id", "rank", "doc_id", "used")


_REDACT = "coalesce(text, '')"
for _kind, _pattern in T.SECRETS:
    _REDACT = f"regexp_replace({_REDACT}, '{_pattern}', '[secret:{_kind}]', 'g')"


@query(f"with r as (select doc_id, coalesce(text, '') as text, {_REDACT} as clean from documents) select doc_id, sha256(clean) as clean_hash, (len(regexp_extract_all(clean, '\\[secret:')))::int as n_secrets from r where clean <> text")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    rows = tab(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("clean", T.redact(F.col("text"))).where("clean <> text")
    return rows.select("doc_id", F.sha2("clean", 256).alias("clean_hash"), F.regexp_count("clean", F.lit(r"\[secret:")).alias("n_secrets"))


@query("""with s as (select lang, count(*)::double as n, sum(quality)::double as k from labels join documents using (doc_id) group by lang)
select lang, n::bigint as n, round(k / n, 6) as rate, round((k / n + 3.8416::double / (2 * n) - 1.96::double * sqrt(k / n * (1 - k / n) / n + 3.8416::double / (4 * n * n))) / (1 + 3.8416::double / n), 6) as low,
round((k / n + 3.8416::double / (2 * n) + 1.96::double * sqrt(k / n * (1 - k / n) / n + 3.8416::double / (4 * n * n))) / (1 + 3.8416::double / n), 6) as high from s""")
def passrate_wilson(spark: SparkSession, d: str) -> DataFrame:
    rows = tab(spark, d, "labels").join(tab(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    s = rows.groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.sum("quality").cast("double").alias("k"))
    low, high = P.wilson(F.col("n"), F.col("k"))
    return s.select("lang", F.col("n").cast("long").alias("n"), F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("select count(*)::bigint as n, round(avg((quality - toxic)::double), 6) as mean, round(stddev_samp((quality - toxic)::double) / sqrt(count(*)), 6) as se, count(*) filter (quality > toxic)::bigint as wins, count(*) filter (quality < toxic)::bigint as losses from labels")
def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("quality") - F.col("toxic")).cast("double")
    return tab(spark, d, "labels").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x) / F.sqrt(F.count("*")), 6).alias("se"), F.count_if(x > 0).alias("wins"), F.count_if(x < 0).alias("losses"))


@query("select user_id, median(value) as median_value, case when count(distinct event_type) = 1 then any_value(event_type) else 'mixed' end as label from events group by user_id")
def evidence_and_median(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.collect_set("event_type")
    return tab(spark, d, "events").groupBy("user_id").agg(F.median("value").alias("median_value"), F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("mixed").alias("label"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k, sha256(props) as props_hash from events")
def payload_fields(spark: SparkSession, d: str) -> DataFrame:
    return tab(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.sha2("props", 256).alias("props_hash"))


@query()
def conditional_episodes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("click", "tool_call", "view", "file_change", "purchase", "turn", "signup", "session_end", "error", "session_end")])
    e = tab(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("session_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), kinds[F.col("event_type")].alias("event_type"), F.when(F.col("event_type") == "error", "close").when(F.col("event_type") == "signup", "turn_end").alias("kind"), (E.micros(F.col("ts")) / 1e6).alias("ts"))
    return streaming.episodes(rows, 4102444800.0).select("session_id", "episode_id", "closed_by", F.size("events").alias("n_events"), F.round("last_ts", 3).alias("last_ts"))


@query()
def typed_values(spark: SparkSession, d: str) -> DataFrame:
    return facts.typed_values(tab(spark, d, "documents"), "doc_id", "text")


@query("""select doc_id, t || ' (' || case doc_id % 5 when 0 then strftime(day - 1, '%Y-%m-%d') when 1 then strftime(day - 2, '%Y-%m-%d') when 2 then strftime(day - 3, '%Y-%m-%d')
when 3 then strftime(day - 14, '%Y-%m-%d') else strftime(date_trunc('month', day) - interval 1 day, '%Y-%m') end || ') (stated ' || strftime(day, '%Y-%m-%d') || ')' as claim
from (select doc_id, date '2024-03-11' + (7 * (doc_id % 9))::int as day, ['Met her yesterday', 'Kam vorgestern', 'Left last friday', 'Began two weeks ago', 'Paid last month'][(doc_id % 5 + 1)::int] as t from documents)""")
def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    said = F.array(*map(F.lit, ("Met her yesterday", "Kam vorgestern", "Left last friday", "Began two weeks ago", "Paid last month")))
    rows = tab(spark, d, "documents").select("doc_id", F.element_at(said, (F.col("doc_id") % 5 + 1).cast("int")).alias("t"), F.date_add(F.lit("2024-03-11").cast("date"), (7 * (F.col("doc_id") % 9)).cast("int")).alias("day"))
    session.ship(spark)
    return rows.select("doc_id", dates.annotated("t", "day").alias("claim"))


def _services(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A claim of every document about a service on a port, and what pages knew: a page for four documents, and page 0
    for a fifth of all."""
    page = F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.floor(F.col("doc_id") / 4) + 1).cast("long")
    docs = tab(spark, d, "documents").where("doc_id is not null").select("doc_id", page.alias("page_id"))
    name = F.concat(F.lit("Service "), F.translate(F.col("page_id").cast("string"), "0123456789", "qwertzuiop"), F.lit("ab runs on port "))
    claims = docs.select(F.col("doc_id").alias("claim_id"), "page_id", F.concat(name, (8000 + F.col("doc_id") % 3).cast("string"), F.lit(".")).alias("text"), F.lit("observed").alias("label"))
    old = docs.select("page_id").distinct().select((F.col("page_id") + 1_000_000_000_000).alias("claim_id"), "page_id", F.concat(name, F.lit("8000.")).alias("text"), F.lit("observed").alias("label"))
    dated = old.withColumns({"stated_on": F.lit("2024-01-01").cast("date"), "superseded_on": F.lit(None).cast("date"), "superseded_by": F.lit(None).cast("long")})
    return claims, dated


_PAGED = "p as (select doc_id, case when doc_id % 5 = 0 then 0 else doc_id // 4 + 1 end::bigint as page_id from documents where doc_id is not null)"


@query(f"with {_PAGED} select doc_id as claim_id, page_id + 1000000000000 as old_id, 'port' as slot, '8000' as old_value, (8000 + doc_id % 3)::varchar as new_value from p where doc_id % 3 <> 0")
def contradiction_pairs(spark: SparkSession, d: str) -> DataFrame:
    claims, old = _services(spark, d)
    return C.contradictions(claims, old)


@query(f"with {_PAGED} select doc_id as claim_id, page_id from p where doc_id % 3 <> 0")
def presence_antijoin(spark: SparkSession, d: str) -> DataFrame:
    claims, old = _services(spark, d)
    return C.missing(claims, old).select("claim_id", "page_id")


@query(f"""with {_PAGED}, n as (select * from p where doc_id % 3 <> 0), b as (select page_id, min(doc_id) as first from n group by page_id)
select page_id + 1000000000000 as claim_id, date '2024-01-01' as stated_on, case when first is not null then date '2024-02-01' end as superseded_on, first as superseded_by from (select distinct page_id from p) left join b using (page_id)
union all select doc_id, date '2024-02-01', null, null from n""")
def scd2_supersede(spark: SparkSession, d: str) -> DataFrame:
    claims, old = _services(spark, d)
    return C.supersede(old, claims, "2024-02-01").select("claim_id", "stated_on", "superseded_on", "superseded_by")


@query("""with u as (select *, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'user')
select conv_id::varchar as session_id, turn as id, case k % 4 when 1 then 'user_preference' when 3 then 'decision' when 2 then 'noise' else 'environment' end as type, k % 4 <> 2 as remember from u""")
def rule_classify(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = F.array(*map(F.lit, ("Our box runs on port 8000 now.", "From now on I prefer short answers.", "thanks, what else?", "yes, do that")))
    rows = tab(spark, d, "conversations").where("role = 'user'").withColumn("k", F.row_number().over(w))
    turns = rows.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("id"), F.element_at(said, F.col("k") % 4 + 1).alias("user_text"), F.lit("I suggest we split it.").alias("assistant_text"), F.lit(False).alias("failed"), F.lit(False).alias("recovered"))
    return K.classify(turns).select("session_id", "id", "type", "remember")


@query()
def page_units(spark: SparkSession, d: str) -> DataFrame:
    return W.units(tab(spark, d, "documents"), "doc_id", "text").select("page_id", "ord", "text_hash")


@query()
def vector_sync(spark: SparkSession, d: str) -> DataFrame:
    units = W.units(tab(spark, d, "benchmark").select("item_id", "text"), "item_id", "text")
    half = W.sync(spark.createDataFrame([], "text_hash string, vec array<float>"), units.where("page_id % 2 = 0"))
    return W.sync(half, units).select("page_id", "ord", F.size("vec").alias("dim"))


@query("""select doc_id, case doc_id % 4 when 0 then '' when 1 then 'status is unknown' when 2 then 'updated before created' else 'type is missing' end as issues from documents""")
def page_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    raw = F.concat(F.lit("---\nid: p-"), F.col("doc_id").cast("string"), F.when(k == 3, "").otherwise("\ntype: note"), F.lit("\nstatus: "), F.when(k == 1, "odd").otherwise("active"), F.lit("\ncreated: 2024-01-02\nupdated: "), F.when(k == 2, "2024-01-01").otherwise("2024-01-03"), F.lit("\nconfidence: high\ntags: [a, b]\n---\nBody"))
    pages = W.parse(tab(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), raw.alias("raw")))
    return pages.select(F.col("path").cast("long").alias("doc_id"), F.array_join(W.issues(), "; ").alias("issues"))


@query("select item_id as ord, case when item_id < 6 then 'duplicate' when sum(case when item_id >= 6 then len(text) + 3 else 0 end) over (order by item_id) + (select sum(len(text) + 3) from benchmark where item_id < 6) > 2200 then 'full' else 'added' end as status from benchmark")
def profile_limits(spark: SparkSession, d: str) -> DataFrame:
    items = tab(spark, d, "benchmark").select(F.lit("user").alias("target"), F.col("item_id").alias("ord"), F.col("text").alias("entry"))
    return C.profile_add(items.where("ord < 6"), items, 2200).select("ord", "status")


@query("""select event_id, case event_id % 5 when 0 then 'Docker container web-' || user_id when 1 then 'CPU' when 2 then 'Listening ports' when 3 then 'systemd service sync@' || user_id else '' end as subject,
 case event_id % 5 when 0 then 'docker' when 1 then 'cpu,hardware' when 2 then 'ports,network' when 3 then 'systemd' else '' end as tags from events""")
def command_topics(spark: SparkSession, d: str) -> DataFrame:
    who, k = F.col("user_id").cast("string"), F.col("event_id") % 5
    run = F.when(k == 0, F.concat(F.lit("sudo docker logs web-"), who)).when(k == 1, "cat /proc/cpuinfo | head").when(k == 2, "env A=1 ss -ltn").when(k == 3, F.concat(F.lit("systemctl --user status sync@"), who)).otherwise("make all")
    about = commands.topic(run)
    return tab(spark, d, "events").select("event_id", about["subject"].alias("subject"), F.array_join(about["tags"], ",").alias("tags"))


@query(f"""with {_PAGED} select doc_id as claim_id, page_id + 1000000000000 as old_id, 'value' as kind,
 'Service ' || translate(page_id::varchar, '0123456789', 'qwertzuiop') || 'ab runs on port ' || (8000 + doc_id % 3) || '.' as rewritten from p where doc_id % 3 <> 0""")
def claim_changes(spark: SparkSession, d: str) -> DataFrame:
    return C.changes(*_services(spark, d))


@query("""select doc_id, case doc_id % 4 when 0 then '' when 1 then 'thanks only' when 2 then 'questions only' else 'empty episode' end as skip from documents""")
def gate_skips(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(F.lit("We moved it."), F.lit("Thanks!"), F.lit("How so? Why?"), F.lit(" ")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = tab(spark, d, "documents").select("doc_id", text.alias("user_text"), F.when(F.col("doc_id") % 4 != 3, "ok").alias("assistant_text"), F.lit(0).alias("n_calls"), F.lit(0).alias("n_changes"))
    return G.skip_reason(rows).select("doc_id", "skip")


@query("""select doc_id as episode_id, 0 as candidate, 0 as ord, 'The nightly export takes ' || (doc_id % 90 + 10) || ' minutes' as text, 'user_stated' as evidence, 0.9::double as confidence from documents where doc_id % 2 = 0""")
def grounded_claims(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 90 + 10
    docs = tab(spark, d, "documents").select(F.col("doc_id").alias("episode_id"), "doc_id", n.alias("n"))
    claims = docs.select("episode_id", F.lit(0).alias("candidate"), F.lit(0).alias("ord"), F.concat(F.lit("The nightly export takes "), F.col("n").cast("string"), F.lit(" minutes")).alias("text"), F.lit("user_stated").alias("evidence"), F.lit(0.9).cast("double").alias("confidence"))
    sources = docs.select("episode_id", F.lit("user_stated").alias("evidence"), F.concat(F.lit("our nightly exports took "), (F.col("n") + F.col("doc_id") % 2 * 100).cast("string"), F.lit("min or minutes")).alias("text"))
    return G.checked(claims, sources)


@query("""select doc_id, '# Page ' || doc_id || case when doc_id % 2 = 0 then chr(10) || chr(10) || '- Uses port 1. (noted 2024-01-02, inferred)' else '' end || chr(10) || chr(10) || '## Superseded' || chr(10) || '- Uses port 0. (noted 2024-01-01; superseded 2024-01-02)' as shown from documents""")
def page_render(spark: SparkSession, d: str) -> DataFrame:
    session.ship(spark)
    fact = F.when(F.col("doc_id") % 2 == 0, "\n- Uses port 1. (stated 2024-01-02) (inferred)").otherwise("")
    body = F.concat(F.lit("# Page "), F.col("doc_id").cast("string"), F.lit("\n"), fact, F.lit("\n- ~~Uses port 0. (stated 2024-01-01)~~ (observed; superseded 2024-01-02 by session:a)\n\n## Empty · session:b\n\n_Provenance: us, session:a_\n"))
    return tab(spark, d, "documents").select("doc_id", render.rendered(body).alias("shown"))


_OUTCOME = "case event_type when 'click' then 'created' when 'view' then 'ignored' when 'purchase' then 'updated' when 'signup' then 'deferred' else 'failed' end"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return tab(spark, d, "events").select(F.col("user_id").alias("batch"), "event_id", "ts", F.expr(_OUTCOME).alias("outcome"))


@query(f"""with l as (select user_id as batch, {_OUTCOME} as outcome from events)
select batch, outcome, count(*)::bigint as n, (sum(count(*) filter (outcome in ('created', 'ignored', 'updated'))) over (partition by batch))::bigint as done, (sum(count(*) filter (outcome in ('deferred', 'failed'))) over (partition by batch))::bigint as failed from l group by batch, outcome""")
def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return A.outcomes(_log(spark, d)).select("batch", "outcome", "n", "done", "failed")


@query("select user_id as event_id, event_id as try from events where event_type = 'signup' qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def first_deferrals(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).select(F.col("batch").alias("event_id"), F.col("event_id").alias("batch"), "ts", "outcome")
    return A.first_deferral(log).select("event_id", F.col("batch").alias("try"))


@query("select max(user_id) + 1 as next from events")
def next_decision_number(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("user_id").cast("string")
    names = tab(spark, d, "events").select(F.concat(F.lit("adr-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")), F.lit("-title")).alias("name"))  # lpad also cuts
    return A.next_number(names, "name", "adr")


@query("select user_id as episode_id, event_id as id from events qualify row_number() over (partition by user_id order by case when event_type = 'error' then 0 else 1 end, event_id) <= 8")
def chosen_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = tab(spark, d, "events").select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return A.chosen_calls(calls).select("episode_id", "id")


@query("select event_id, last_value(case when event_type = 'signup' then event_id % 100 end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as day_offset from events")
def carried_offsets(spark: SparkSession, d: str) -> DataFrame:
    turns = tab(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("event_id") % 100).alias("day_offset"))
    return A.carried_offset(turns, "user_id", "event_id", "day_offset").select("event_id", "day_offset")


@query("""with c as (select p_partkey as id, [p_brand, 'k' || p_size] as tags from part), t as (select id, unnest(list_distinct(tags)) as tag from c),
s as (select s_suppkey as page_id, unnest(list_distinct(['k' || (s_suppkey % 50), 'Brand#' || (11 + s_suppkey % 5)])) as tag from supplier)
select id as candidate_id, page_id, count(*)::bigint as n from t join s using (tag) group by all""")
def tag_overlap(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    ours = tab(spark, d, "part").select(F.col("p_partkey").alias("candidate_id"), F.array(F.col("p_brand"), F.concat(F.lit("k"), text("p_size"))).alias("tags"))
    theirs = tab(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.array(F.concat(F.lit("k"), (F.col("s_suppkey") % 50).cast("string")), F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string"))).alias("tags"))
    return A.by_tags(ours, theirs)


@query("select event_id, user_id from events a where event_type = 'click' and exists (select 1 from events b where b.user_id = a.user_id and b.event_type = 'view' and b.event_id > a.event_id)")
def written_after_event(spark: SparkSession, d: str) -> DataFrame:
    e = tab(spark, d, "events").select("event_id", "user_id", "event_type", F.col("user_id").cast("string").alias("text"))
    return A.written_after(e.where("event_type = 'click'"), e.where("event_type = 'view'").select(F.col("event_id").alias("id"), "text")).select("event_id", "user_id")


@query("select doc_id, case doc_id % 3 when 0 then doc_id % 2 = 0 end as record, case doc_id % 3 when 0 then 'because ' || doc_id end as why from documents")
def model_decisions(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    good = F.concat(F.lit("<think>{no}</think>\n```json\n{\"record\": "), (F.col("doc_id") % 2 == 0).cast("string"), F.lit(", \"conf\": 0.5, \"why\": \"because "), n, F.lit("\", \"items\": []}\n```"))
    answers = tab(spark, d, "documents").select("doc_id", F.when(k == 0, good).when(k == 1, "I can't say.").alias("answer"))
    return answers.select("doc_id", A.decision(F.col("answer")).alias("d")).select("doc_id", "d.record", "d.why")
