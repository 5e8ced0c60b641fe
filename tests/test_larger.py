"""Queries against their SQL on tables that are larger or odder than the given ones."""

from collections import Counter

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from quillstream import catalogue
from quillstream.functions import text as T
from quillstream.operators import audit as A


def put(folder, **tables) -> str:
    """Writes tables given as SQL; returns the folder."""
    for name, sql in tables.items():
        duckdb.execute(f"copy ({sql}) to '{folder}/{name}.parquet'")
    return str(folder)


def same(spark, d: str, name: str) -> bool:
    return compare.differences(spark, d, catalogue.queries()[name], catalogue.oracle_sql()[name]) == []


@pytest.mark.parametrize("docs", [
    "select i as doc_id, 'text ' || i % 7 as text from range(20000) r(i)",
    "select case when i % 3 > 0 then i // 2 end as doc_id, case when i % 5 > 0 then 'ä' || i end as text from range(50) r(i)",
    "select null::bigint as doc_id, 'x' as text from range(3)",
    "select 1::bigint as doc_id, 'x' as text where false",
])
def test_digest_at_any_size(spark, tmp_path, docs):
    assert same(spark, put(tmp_path, documents=docs), "wiki_digest")


@pytest.mark.parametrize("most", [9_998, 9_999, 89_999, 3_000_000_000, 123_456_789_012_345_678])
def test_next_number_of_any_length(spark, tmp_path, most):
    events = f"select {most} - i as user_id from range(5) r(i) union all select 12 union all select null"
    assert same(spark, put(tmp_path, events=events), "next_decision_number")


def test_numbers_beyond_a_long_are_none(spark):
    names = spark.createDataFrame([("adr-7-x",), ("adr-" + "9" * 30,), ("adr-0012",), ("adr-13x-y",), (None,)], "n string")
    assert A.next_number(names, "n", "adr").first().next == 14


def test_shared_tags_of_odd_rows(spark):
    ours = [(1, ["a", "b", "a"]), (1, ["b", None]), (2, ["b"]), (None, ["a"]), (None, ["a", "c"]), (3, []), (4, None), (5, ["z"])] + [(i, ["c"]) for i in range(100, 9_100)]
    theirs = [(7, ["a", "b"]), (8, ["c", "b"]), (8, ["c"]), (None, ["b", "b"]), (9, [None])]
    want = Counter((i, p) for i, s in ours for p, t in theirs for x in set(s or ()) & set(t or ()) if x)
    got = A.by_tags(spark.createDataFrame(ours, "candidate_id long, tags array<string>"), spark.createDataFrame(theirs, "page_id long, tags array<string>"))
    assert Counter({(r.candidate_id, r.page_id): r.n for r in got.collect()}) == want and got.count() == len(want)
    assert A.by_tags(spark.createDataFrame([], "candidate_id long, tags array<string>"), spark.createDataFrame(theirs, "page_id long, tags array<string>")).count() == 0


def test_pairs_of_shared_tags_are_not_grouped(spark, sf):
    df = catalogue.queries()["tag_overlap"](spark, sf)
    result, below = df._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)
    assert result.count("Generate explode") == 2 and "Aggregate" not in result and "Aggregate" in below


def test_token_sets_are_those_of_columns(spark, sf):
    odd = ["", "The Cities, DRIED boxes; noes ties dies 1990s classes class ss apes trees freed bees agreed sing pinging", "\u0130stanbul \u212aelvin wei\u00dfes stra\u00dfe na\u00efve_word a_b", "x" * 100 + "es " + "y" * 100 + "es", "ees eed eing seeing been queues ices iced ages", "a\x00bc\ndies"]
    texts = spark.createDataFrame([(t,) for t in odd], "text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text")))
    sets = T.TokenSets(50)
    for r in texts.select(F.array_distinct(T.tokens(F.col("text"))).alias("want"), F.lower("text").alias("low")).collect():
        assert sets.of(r.low.encode()) == set(r.want) and sets.of(r.low.encode()) == set(r.want)


def test_documents_are_split_outside_of_patterns_in_the_jvm(spark, sf):
    plan = catalogue.queries()["contamination_probe"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_extract_all" in line and "doc_id" in line for line in plan.splitlines()) and "MapInArrow" in plan
