"""Lexical and dense retrieval, fusion and budgets, over whole query batches (query_id, query)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream import session
from quillstream.functions import text as T

FIELD_WEIGHT, BODY_WEIGHT, UNKNOWN = 1.0, 0.7, 0.2
#: Weights of the fields in BM25, and the fields whose terms count in full.
COLUMNS = {"title": 8.0, "tags": 4.0, "body": 1.0}
STRONG = ("title", "tags")
K1, B = 1.2, 0.75
RRF_K = 60


def postings(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, n (words of the page). Counts are combined before the shuffle."""
    words = pages.select(key, T.words(F.col(text)).alias("_w"))
    return words.select(key, F.size("_w").alias("n"), F.explode("_w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("n").alias("n"))


def terms_of(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(T.query_terms(F.col("query"))).alias("term"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def matched(queries: DataFrame, pages: DataFrame, key: str, text: str) -> DataFrame:
    """query_id, key, term, tf, n. Pages meet only the terms asked for: the query side is small and joined first."""
    words = pages.select(key, T.words(F.col(text)).alias("_w"))  # once a page: next to explode it would run once a word
    asked = terms_of(queries)
    hits = words.select(key, F.size("_w").alias("n"), F.explode("_w").alias("term")).join(asked, "term")
    return hits.groupBy("query_id", key, "term").agg(F.count("*").alias("tf"), F.max("n").alias("n"))


def document_frequency(pages: DataFrame, key: str, text: str) -> DataFrame:
    """term, df. One row per page and distinct term, combined before the shuffle."""
    return pages.select(key, F.explode(F.array_distinct(T.words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf_coverage(queries: DataFrame, pages: DataFrame, key: str, text: str, limit: int, weight: float = BODY_WEIGHT, unknown: float = UNKNOWN) -> DataFrame:
    """query_id, key, score in [0, 1], rank: the idf-weighted share of a query's terms that a page has."""
    hits = matched(queries, pages, key, text)
    total = pages.agg(F.count("*").alias("pages"))
    df = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    known = terms_of(queries).join(df, ["query_id", "term"], "left").crossJoin(total)
    w = known.select("query_id", "term", idf(F.col("pages"), F.coalesce("df", F.lit(0))).alias("idf"), F.col("df").isNotNull().alias("known"))
    whole = w.groupBy("query_id").agg(F.sum(F.when(F.col("known"), F.col("idf")).otherwise(F.col("idf") * unknown)).alias("whole"))
    got = hits.join(w, ["query_id", "term"]).groupBy("query_id", key).agg(F.sum(F.col("idf") * weight).alias("got"))
    scored = got.join(whole, "query_id").select("query_id", key, F.round(F.least(F.lit(1.0), F.col("got") / F.col("whole")), 4).alias("score"))
    return top(scored, key, limit)


def bm25(queries: DataFrame, pages: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    hits = matched(queries, pages, key, text)
    total = pages.agg(F.count("*").alias("pages"), F.avg(F.size(T.words(F.col(text)))).alias("mean"))
    df = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    part = idf(F.col("pages"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    scored = hits.join(df, ["query_id", "term"]).crossJoin(total).groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, key, limit)


def top(scored: DataFrame, key: str, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Vectors of a block of units and of a block of queries, and the parts that units are dealt to.
UNIT_BLOCK, QUERY_BLOCK, SALTS = 4096, 1024, 32


def _packed(rows: int):
    """Rows (a, b, vector) as blocks of at most `rows` of one length: (ids a, ids b, dim, all numbers as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                sizes = np.array([len(v) for v in part.column(2)])
                for dim in np.unique(sizes):
                    some = part.filter(pa.array(sizes == dim))
                    flat = np.ascontiguousarray(some.column(2).flatten().to_numpy(zero_copy_only=False), "<f8")
                    yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([some.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([int(dim)], pa.int32()), pa.array([flat.tobytes()], pa.binary())], names=["a", "b", "dim", "flat"])

    return run


def _best(k: int, by_page: bool):
    """Pairs of blocks (units, pages, flat, queries, flat): the k best units of each query (and page, if by_page)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                units, pages, flat, asked, qflat = (batch.column(i)[r].as_py() for i in range(5))
                x, q = np.frombuffer(flat, "<f8").reshape(len(units), -1), np.frombuffer(qflat, "<f8").reshape(len(asked), -1)
                sims = np.round(q @ x.T, 6)
                ids, group = np.array(units), np.array([p if p is not None else -1 for p in pages])
                order = np.argsort(ids, kind="stable")
                ids, group, sims = ids[order], group[order], sims[:, order]
                out = []
                for n, s in zip(asked, sims):
                    if by_page:
                        at = np.lexsort((ids, -s, group))
                        first = np.r_[True, group[at][1:] != group[at][:-1]]
                        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                        at = at[nth < k]
                    else:
                        at = np.argsort(-s, kind="stable")[:k]
                    out.append((np.full(len(at), n), group[at], ids[at], s[at]))
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "page", "unit", "sim"])

    return run


def dense(queries: DataFrame, units: DataFrame, k: int, by_page: bool = False) -> DataFrame:
    """query_id, page, unit, sim: for a stated batch of queries (query_id, qvec) the k best of each block of units (unit,
    page, vec), or of each page in a block. Blocks of queries meet blocks of units in matrix products; a block gives k
    rows a query, never all pairs. Vectors of other lengths, null ones and null ids don't meet; a null page is -1."""
    session.ship(units.sparkSession)
    ddl = "a array<long>, b array<long>, dim int, flat binary"
    numbers = lambda c: F.col(c).cast("array<double>")
    u = units.where("vec is not null and unit is not null").select(F.col("unit").cast("long"), F.col("page").cast("long"), numbers("vec")).mapInArrow(_packed(UNIT_BLOCK), ddl)
    q = queries.where("qvec is not null and query_id is not null").select(F.col("query_id").cast("long"), F.col("query_id").cast("long").alias("same"), numbers("qvec")).repartition(1 + _blocks(queries)).mapInArrow(_packed(QUERY_BLOCK), ddl)
    dealt = u.withColumn("_salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))  # a length alone would be one key
    copies = q.select(F.col("a").alias("asked"), F.col("dim").alias("qdim"), F.col("flat").alias("qflat"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_copy"))
    pairs = dealt.join(copies, (F.col("dim") == F.col("qdim")) & (F.col("_salt") == F.col("_copy")))
    return pairs.select("a", "b", "flat", "asked", "qflat").mapInArrow(_best(k, by_page), "query_id long, page long, unit long, sim double")


def _blocks(queries: DataFrame) -> int:
    return queries.count() // (8 * QUERY_BLOCK)


def dense_topk(queries: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """query_id, unit, sim, rank of the k best units of each query; ties to the smaller unit."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "unit"))
    return dense(queries, units, k).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "unit", "sim", "rank")


def best_units(sims: DataFrame, page: str, k: int = 3) -> DataFrame:
    """query_id, page, score (best unit) and the k best units; ranked before grouping, so no list grows."""
    rank = F.row_number().over(Window.partitionBy("query_id", page).orderBy(F.desc("sim"), "unit"))
    few = sims.withColumn("_r", rank).where(F.col("_r") <= k)
    return few.groupBy("query_id", page).agg(F.max("sim").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "unit"))), lambda u: u["unit"].cast("string")), ",").alias("units"))


def calibrate(sim: Column, floor: float, ceiling: float) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (sim - floor) / (ceiling - floor))), 4)


def fuse(lists: list[tuple[DataFrame, float]], key: str, limit: int, depth: int = 20) -> DataFrame:
    """Weighted reciprocal ranks of ranked lists (query_id, key, score, rank): union and sum, no n-way outer join."""
    every = None
    for df, w in lists:
        part = df.where(F.col("rank") <= max(depth, limit)).select("query_id", key, "score", (w / (RRF_K + F.col("rank"))).alias("rr"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query_id", key).agg(F.round(F.sum("rr"), 9).alias("rrf"), F.max("score").alias("best"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc("best"), key))
    return fused.withColumn("rank", rank).where(F.col("rank") <= limit)


def budget(ranked: DataFrame, length: str, most: int) -> DataFrame:
    """Ranked lines of each query until the first that would overflow."""
    upto = F.sum(length).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", upto.cast("long")).where(F.col("used") <= most)


def search(queries: DataFrame, pages: DataFrame, limit: int, unknown: float = UNKNOWN, columns: dict[str, float] = COLUMNS) -> DataFrame:
    """query_id, page, score, bm25, rank over pages (page, title, tags, body; all text): the best max(5 * limit, 50) pages
    of a query by BM25 over weighted fields are scored by idf coverage, a term in a strong field counting FIELD_WEIGHT and
    one in the body alone BODY_WEIGHT. Ties go to the larger BM25, then the smaller page. Queries without a known term
    have no rows; null fields have no words."""
    asked = terms_of(queries)
    fields = pages.select("page", *[T.words(F.col(c).cast("string")).alias(c) for c in columns])
    n = sum(F.size(c) for c in columns)
    marked = lambda c: F.transform(c, lambda w: F.struct(w.alias("term"), F.lit(c).alias("field")))
    each = fields.select("page", n.alias("n"), F.explode(F.concat(*map(marked, columns))).alias("w")).select("page", "n", "w.*")
    weight = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    hits = each.join(asked, "term").groupBy("query_id", "page", "term").agg(F.sum(weight[F.col("field")]).alias("tf"), F.max("n").alias("n"), F.max(F.col("field").isin(*STRONG)).alias("strong"))
    total = pages.select(sum(F.size(T.words(F.col(c).cast("string"))) for c in columns).alias("n")).agg(F.count("*").alias("pages"), F.avg("n").alias("mean"))
    df = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    known = asked.join(df, ["query_id", "term"], "left").crossJoin(total)  # one row of totals
    w = known.select("query_id", "term", idf(F.col("pages"), F.coalesce("df", F.lit(0))).alias("idf"), F.col("df").isNotNull().alias("known"), "mean")
    whole = w.groupBy("query_id").agg(F.sum(F.when(F.col("known"), F.col("idf")).otherwise(F.col("idf") * unknown)).alias("whole"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    got = hits.join(w, ["query_id", "term"]).groupBy("query_id", "page").agg(F.round(F.sum(part), 6).alias("bm25"), F.sum(F.col("idf") * F.when(F.col("strong"), FIELD_WEIGHT).otherwise(BODY_WEIGHT)).alias("got"))
    pool = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "page"))
    scored = got.withColumn("_p", pool).where(F.col("_p") <= max(5 * limit, 50)).join(whole, "query_id")
    scored = scored.select("query_id", "page", F.round(F.least(F.lit(1.0), F.col("got") / F.col("whole")), 4).alias("score"), "bm25")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("bm25"), "page"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def snippets(hits: DataFrame, queries: DataFrame, pages: DataFrame, items: int = 2, most: int = 420, head: int = 200) -> DataFrame:
    """hits (query_id, page) with a snippet: the `items` lines of the body that hold most of the query's terms, the later
    first among equals, in their order, cut to `most` characters; the first `head` characters where no line holds one."""
    asked = terms_of(queries).groupBy("query_id").agg(F.collect_set("term").alias("_terms"))  # 24 terms at most
    rows = hits.join(pages.select("page", F.coalesce("body", F.lit("")).alias("_body")), "page").join(asked, "query_id")
    lines = rows.select("query_id", "page", "_terms", F.posexplode(F.split("_body", "\n")).alias("_at", "_line"))
    held = lines.withColumn("_n", F.size(F.array_intersect("_terms", T.words(F.col("_line"))))).where("_n > 0")
    nth = F.row_number().over(Window.partitionBy("query_id", "page").orderBy(F.desc("_n"), F.desc("_at")))
    best = held.withColumn("_k", nth).where(F.col("_k") <= items).groupBy("query_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda x: F.btrim(x["_line"])), " … ").alias("_s"))
    out = rows.drop("_terms").join(best, ["query_id", "page"], "left")
    return out.withColumn("snippet", F.when(F.col("_s").isNotNull(), F.substring("_s", 1, most)).otherwise(F.substring("_body", 1, head))).drop("_body", "_s")


def focus(query: Column) -> Column:
    """A message as a query: of absolute paths only the last part stays, links and paths from here stay whole."""
    return F.btrim(F.regexp_replace(F.coalesce(query, F.lit("")), r"(?<![\w/.:~-])(?:~|\.{1,2})?/(?:[\w.@+-]+/)+([\w.@+-]+)", "$1"))


def rerank_queries(query: Column) -> Column:
    """What a reranker is asked for a message: all of it on one line, and, of one with several paragraphs, its two longest
    questions and its last two paragraphs."""
    line = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    whole = line(F.coalesce(query, F.lit("")))
    parts = F.filter(F.transform(F.split(F.coalesce(query, F.lit("")), r"\n\s*\n"), line), lambda p: p != "")
    asks = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(r"([^.!?]+\?)"), F.lit(1)), lambda p: F.btrim(p)), lambda p: p != "")
    longest = F.slice(F.transform(F.array_sort(F.transform(asks, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda x: x["p"]), 1, 2)
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2))
    return F.array_distinct(F.when(F.size(parts) > 1, F.concat(F.array(whole), longest, last)).otherwise(F.array(whole)))


def shared_terms(queries: list[str], texts: list[str]) -> list[float]:
    """A deterministic stand-in for a reranking model: the share of a query's words that a text has."""
    out = []
    for q, t in zip(queries, texts):
        want, have = set(re.findall(r"\w+", q.lower())), set(re.findall(r"\w+", t.lower()))
        out.append(len(want & have) / len(want) if want else 0.0)
    return out


def rerank(hits: DataFrame, queries: DataFrame, texts: DataFrame, limit: int, scorer: Callable[[list[str], list[str]], list[float]] = shared_terms, chars: int = 2000) -> DataFrame:
    """query_id, page, score, prior, via, rank: hits (query_id, page, score, rank) in the order of a scorer's relevance,
    the best over the forms of the query (rerank_queries) on the first `chars` characters that a reranker reads of a text
    (page, text); prior is the score before. Where the scorer fails for a batch, its hits keep score and order, via base."""
    rows = hits.select("query_id", "page", "score", "rank").join(queries.select("query_id", rerank_queries(focus(F.col("query"))).alias("asked")), "query_id").join(texts.select("page", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text")), "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, texts = b.column(4).to_pylist(), b.column(5).to_pylist()
            of = [k for k, forms in enumerate(asked) for _ in forms]
            try:
                found = scorer([f for forms in asked for f in forms], [texts[k] for k in of])
            except Exception:  # a model that is away costs the order, not the answer
                found = None
            best: list = [None] * b.num_rows
            for k, s in zip(of, found or ()):
                best[k] = s if best[k] is None else max(best[k], s)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(best, pa.float64())], names=["query_id", "page", "prior", "before", "relevance"])

    session.ship(hits.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    scored = rows.select("query_id", "page", F.col("score").cast("double"), F.col("rank").cast("int"), "asked", "text").mapInArrow(run, f"query_id {kinds['query_id']}, page {kinds['page']}, prior double, before int, relevance double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("relevance"), "before"))
    out = scored.select("query_id", "page", F.coalesce("relevance", "prior").alias("score"), "prior", F.when(F.col("relevance").isNull(), "base").otherwise("rerank").alias("via"), order.alias("rank"))
    return out.where(F.col("rank") <= limit)


#: Least relevance of a reranked hit, absolute and as a share of the best; least prior that makes up for it; least score of others.
RELEVANT, SHARE_OF_BEST, PRIOR_ENOUGH, ENOUGH = 0.002, 0.01, 0.4, 0.2


def accepted(hits: DataFrame) -> DataFrame:
    """Hits (query_id, score, prior, via) worth recalling: reranked ones by relevance or prior, others by score."""
    best = F.max(F.when(F.col("via") == "rerank", F.col("score"))).over(Window.partitionBy("query_id"))
    relevant = F.col("score") >= F.greatest(F.lit(RELEVANT), SHARE_OF_BEST * best)
    keep = F.when(F.col("via") == "rerank", relevant | (F.col("prior") >= PRIOR_ENOUGH)).otherwise(F.col("score") >= ENOUGH)
    return hits.withColumn("_keep", keep).where("_keep").drop("_keep")


def compatible(index: dict, model: dict) -> bool:
    """Whether an index's vectors and a model's live in one space: name, revision and length agree."""
    return all(index.get(k) == model.get(k) for k in ("model_id", "revision", "dim"))
