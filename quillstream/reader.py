"""The read path: retrievers over a table of pages, recall for a batch of messages, and reading a page.

Pages are rows (page, path, title, tags, type, status, body), queries (query_id, query); every method takes and gives
DataFrames, so a batch of messages is one plan."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators import render
from quillstream.operators import retrieval as R
from quillstream.sources import wiki

#: Hits of a recall and its characters; most hits of a search, least score of one that isn't lexical; characters of a page.
RECALLED, BUDGET, MOST_HITS, LEAST_SCORE, PAGE_CHARS = 4, 1500, 20, 0.2, 20_000


class Retriever(ABC):
    @abstractmethod
    def retrieve(self, queries: DataFrame, k: int, type: str | None = None) -> DataFrame:
        """query_id, page, score in [0, 1], rank, and what else tells how a hit came about."""


class Lexical(Retriever):
    """Pages by idf coverage; index pages only where they are asked for by type."""

    def __init__(self, pages: DataFrame, unknown: float = R.UNKNOWN):
        self.pages, self.unknown = pages, unknown

    def retrieve(self, queries: DataFrame, k: int, type: str | None = None) -> DataFrame:
        pages = self.pages.where(F.coalesce("type", F.lit("")) != "index") if type in (None, "any") else self.pages.where(F.col("type") == type)
        return R.search(queries, pages, k, self.unknown).withColumn("via", F.lit("fts"))


class Dense(Retriever):
    """Pages by their best unit; nothing where the index's vectors are of another model than the queries'."""

    def __init__(self, units: DataFrame, embed: Callable[[DataFrame], DataFrame], index: dict, model: dict, floor: float = 0.1, ceiling: float = 0.8):
        self.units, self.embed, self.fits, self.floor, self.ceiling = units, embed, R.compatible(index, model), floor, ceiling

    def retrieve(self, queries: DataFrame, k: int, type: str | None = None) -> DataFrame:
        asked = self.embed(queries) if self.fits else self.embed(queries).where("false")
        best = R.best_units(R.dense(asked, self.units, 3, by_page=True), "page").select("query_id", "page", R.calibrate(F.col("score"), self.floor, self.ceiling).alias("score"))
        return R.top(best, "page", k).withColumn("via", F.lit("dense"))


class Fused(Retriever):
    """Reciprocal ranks of several retrievers; one whose plan can't be made is left out."""

    def __init__(self, parts: list[tuple[Retriever, float]]):
        self.parts = parts

    def retrieve(self, queries: DataFrame, k: int, type: str | None = None) -> DataFrame:
        lists = []
        for part, weight in self.parts:
            try:
                lists.append((part.retrieve(queries, max(k, 20), type), weight))
            except Exception:
                continue
        if not lists:
            raise RuntimeError("no retriever is there")
        fused = R.fuse(lists, "page", k)
        return fused.select("query_id", "page", F.col("best").alias("score"), "rank", F.lit("fused").alias("via"))


class Reranked(Retriever):
    """The hits of another retriever in the order of a scorer of (query, text)."""

    def __init__(self, base: Retriever, texts: DataFrame, scorer: Callable = R.shared_terms, depth: int = 20):
        self.base, self.texts, self.scorer, self.depth = base, texts, scorer, depth

    def retrieve(self, queries: DataFrame, k: int, type: str | None = None) -> DataFrame:
        return R.rerank(self.base.retrieve(queries, max(k, self.depth), type), queries, self.texts, k, self.scorer)


def build_retriever(pages: DataFrame, purpose: str = "reader", dense: Dense | None = None, scorer: Callable | None = None) -> Retriever:
    """For readers: lexical, fused with dense and reranked where those are given; for curation a stricter lexical one."""
    lexical = Lexical(pages, 0.5 if purpose == "curator" else R.UNKNOWN)
    out: Retriever = Fused([(lexical, 1.0), (dense, 1.0)]) if dense else lexical
    return Reranked(out, texts_of(pages), scorer) if scorer and purpose == "reader" else out


def texts_of(pages: DataFrame) -> DataFrame:
    """page, text: what a reranker reads of a page."""
    return pages.select("page", F.concat_ws("\n", "title", "body").alias("text"))


class Reader:
    def __init__(self, pages: DataFrame, retriever: Retriever | None = None):
        self.pages, self.retriever = pages, retriever or Lexical(pages)

    def search(self, queries: DataFrame, limit: int = 5, type: str | None = None) -> DataFrame:
        """Hits with title, type, status and snippet; at most MOST_HITS, and others than lexical ones by LEAST_SCORE."""
        hits = self.retriever.retrieve(queries, max(1, min(MOST_HITS, limit)), type)
        return self._shown(hits.where((F.col("via") == "fts") | (F.col("score") >= LEAST_SCORE)), queries)

    def prefetch(self, queries: DataFrame, budget: int = BUDGET, k: int = RECALLED) -> DataFrame:
        """query_id, block: what a message brings to mind, in at most `budget` characters."""
        focused = queries.select("query_id", R.focus(F.col("query")).alias("query"))
        hits = self.retriever.retrieve(focused, k)
        hits = hits if "prior" in hits.columns else hits.withColumn("prior", F.col("score"))
        shown = self._shown(R.accepted(hits), focused)
        return render.recall(shown.withColumnRenamed("page", "id"), budget, 0.0)

    def read(self, wanted: DataFrame, raw: bool = False) -> DataFrame:
        """wanted (name, section): the page of an id, else of a path, whole or its section (by heading or anchor), as readers
        see it unless raw, cut to PAGE_CHARS; no row for unknown names."""
        by_id = wanted.join(self.pages.select(F.col("page").cast("string").alias("name"), "body"), "name").withColumn("_k", F.lit(0))
        by_path = wanted.join(self.pages.select(F.col("path").alias("name"), "body"), "name").withColumn("_k", F.lit(1))
        both = by_id.unionByName(by_path).groupBy("name", "section").agg(F.min_by("body", "_k").alias("body"))
        body = wiki.section_of(F.coalesce("body", F.lit("")), F.coalesce("section", F.lit("")))
        return both.select("name", "section", F.substring(body if raw else render.rendered(body), 1, PAGE_CHARS).alias("text"))

    def _shown(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        about = self.pages.select("page", "title", "type", "status")
        return R.snippets(hits, queries, self.pages).join(about, "page")
