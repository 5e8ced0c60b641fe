"""Versions of pages, snapshots of tables, stems."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quillstream.functions import porter
from quillstream.operators import writing as W
from quillstream.sources import versions as V

CANDIDATE = "candidate_id long, session_id string, type string, title string, subject string, context string, tags array<string>, refs array<string>, claims array<struct<text:string,label:string>>"
PAGES = "page_id string, path string, type string, title string, subject string, status string, confidence string, created string, updated string, tags array<string>, sources array<string>, body string, version int"
DAY = "2030-05-06"


def page(page_id, body, type="environment", **more):
    row = dict(page_id=page_id, path=f"{page_id}.md", type=type, title=page_id, subject=None, status="active", confidence="medium", created="2030-01-01", updated="2030-01-01", tags=[], sources=["session:old"], body=body, version=1)
    return tuple({**row, **more}.values())


def candidate(n, type, claims, title=None, **more):
    row = dict(candidate_id=n, session_id=f"s{n}", type=type, title=title, subject=None, context=None, tags=None, refs=[f"event:{n}"], claims=claims)
    return tuple({**row, **more}.values())


def write(spark, pages, candidates, targets=(), olds=None):
    p, c = spark.createDataFrame(list(pages), PAGES), spark.createDataFrame(list(candidates), CANDIDATE)
    t = spark.createDataFrame(list(targets), "candidate_id long, page_id string")
    o = olds and spark.createDataFrame(olds, "page_id string, line int, note string")
    return {r.page_id: r for r in W.write(p, c, t, DAY, "writer", o).collect()}


def test_update_appends_strikes_and_links(spark):
    body = "# Host\n\n## Facts\n\n- Port is 25 (observed)\n- Name is a\n\n## Updates\n\n## Notes\n\nkept\n"
    got = write(spark, [page("host", body), page("other", "# O\n")], [candidate(2, "environment", [("Port is 26", "observed")]), candidate(1, "environment", [("Disk is full", None), ("It hums", "inferred")])], [(2, "host"), (1, "host")], [("host", 4, "superseded 2030-05-06 by session:s2"), ("host", 5, "gone"), ("host", 0, "no bullet")])
    assert set(got) == {"host"}
    r = got["host"]
    assert r.body == (
        "# Host\n\n## Facts\n\n- ~~Port is 25~~ (observed; superseded 2030-05-06 by session:s2)\n- ~~Name is a~~ (gone)\n\n## Updates\n\n"
        "### 2030-05-06 · session:s1\n\n- Disk is full (observed)\n- It hums (inferred)\n\n_Provenance: writer, 2030-05-06 · session:s1, event:1_\n\n"
        "### 2030-05-06 · session:s2\n\n- Port is 26 (observed)\n\n_Provenance: writer, 2030-05-06 · session:s2, event:2_\n\n## Notes\n\nkept\n"
    )
    assert (r.version, r.updated, r.created) == (2, DAY, "2030-01-01")
    assert r.sources == ["session:old", "session:s1", "event:1", "session:s2", "event:2"]


def test_update_without_a_section_and_of_a_future_page(spark):
    got = write(spark, [page("a", None, created="2031-01-01", updated="2031-01-01", sources=None)], [candidate(1, "learning", [("x y", "observed")])], [(1, "a")])
    assert got["a"].body.startswith("\n\n## Updates\n\n### 2030-05-06") and got["a"].updated == "2031-01-01"
    assert got["a"].sources == ["session:s1", "event:1"]


def test_created_pages_by_type(spark):
    have = [page("decision.adr-0007", "# x\n", "decision"), page("environment.build-host", "# x\n"), page("environment.build-host-4", "# x\n")]
    made = write(
        spark,
        have,
        [
            candidate(1, "decision", [("We use B", "observed")], "Use B", context="A was slow"),
            candidate(2, "decision", [("We use C", "observed")], "Use C"),
            candidate(3, "environment", [("It has 4 cores", "inferred")], "Build host"),
            candidate(4, "learning", [("It failed", "observed"), ("Retry helps", "observed")], "Retry"),
            candidate(5, "user_preference", [("Short answers", "observed")]),
            candidate(6, "user_preference", [("No emoji", "observed")]),
            candidate(7, "environment", [], "Nothing said"),
            candidate(8, "environment", None, "Nothing said"),
        ],
    )
    assert set(made) == {"decision.adr-0008", "decision.adr-0009", "environment.build-host-5", "learning.retry", W.PREFERENCES[0]}
    d = made["decision.adr-0008"]
    assert (d.title, d.status, d.path, d.confidence) == ("ADR-0008: Use B", "accepted", "decision/adr-0008-use-b.md", "medium")
    assert "## Context\n\nA was slow\n\n## Decision\n\n- We use B (observed)\n\n## Consequences\n\n_Not recorded yet._" in d.body
    assert "_Not recorded._" in made["decision.adr-0009"].body
    e = made["environment.build-host-5"]
    assert (e.status, e.confidence, e.path) == ("draft", "low", "environment/build-host-5.md") and "## Facts\n\n- It has 4 cores (inferred)" in e.body
    assert "## Observation\n\n- It failed (observed)\n\n## Fix\n\n- Retry helps (observed)\n\n## Updates" in made["learning.retry"].body
    p = made[W.PREFERENCES[0]]
    assert p.version == 1 and p.body.index("Short answers") < p.body.index("No emoji") and p.sources == ["session:s5", "event:5", "session:s6", "event:6"]


def test_preferences_join_their_page(spark):
    got = write(spark, [page(W.PREFERENCES[0], "# P\n", "user_preference")], [candidate(1, "user_preference", [("Short", "observed")]), candidate(2, "user_preference", [("Calm", "observed")])])
    assert set(got) == {W.PREFERENCES[0]} and got[W.PREFERENCES[0]].version == 2 and got[W.PREFERENCES[0]].body.count("### ") == 2


def test_empty_tables_current_and_refused(spark):
    assert write(spark, [], []) == {} and write(spark, [page("a", "# A\n")], []) == {}
    rows = spark.createDataFrame([page("a", "# A\n"), page("a", "# B\n", version=2), page("b", "no heading", path="../b.md")], PAGES)
    assert {r.page_id: r.body for r in W.current(rows).collect()} == {"a": "# B\n", "b": "no heading"}
    assert {r.page_id: r.issues for r in W.refused(W.current(rows)).collect()} == {"b": ["path leaves the folder", "no heading"]}
    files = {r.path: r.text for r in W.as_file(W.current(rows)).collect()}
    assert files["a.md"].startswith("---\nid: a\ntype: environment\nstatus: active\n") and files["a.md"].endswith("---\n# B\n")


def test_hot_page_takes_every_block(spark):
    many = spark.range(3000).selectExpr("id as candidate_id", "concat('s', id) as session_id", "'environment' as type", "cast(null as string) as title", "cast(null as string) as subject", "cast(null as string) as context", "cast(null as array<string>) as tags", "array(concat('event:', id)) as refs", "array(named_struct('text', concat('fact ', id), 'label', 'observed')) as claims")
    targets = many.select("candidate_id", F.lit("a").alias("page_id"))
    r = W.write(spark.createDataFrame([page("a", "# A\n")], PAGES), many, targets, DAY, "w").collect()[0]
    assert r.body.count("### ") == 3000 and r.body.index("fact 2 ") < r.body.index("fact 10 ")


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/wiki"
    assert V.read(spark, folder) is None and V.batches(spark, folder) == []
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")
    V.commit(a, folder, "b1")
    V.commit(b, folder, "b2")
    assert V.batches(spark, folder) == ["b1", "b2"] and {r.k for r in V.read(spark, folder).collect()} == {2, 3}
    assert {(r.k, r.change) for r in V.difference(V.read(spark, folder, "b1"), V.read(spark, folder), "k").collect()} == {(1, "removed"), (2, "changed"), (3, "added")}
    V.revert(spark, folder, "b1")
    assert V.batches(spark, folder) == ["b1"] and {r.k for r in V.read(spark, folder).collect()} == {1, 2}
    with pytest.raises(KeyError):
        V.read(spark, folder, "b2")
    with pytest.raises(ValueError):
        V.commit(b, folder, "../b3")
    broken = b.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        V.commit(broken, folder, "b3")
    assert V.batches(spark, folder) == ["b1"]


def test_one_writer(spark, tmp_path):
    folder = f"file://{tmp_path}/wiki"
    with V.lock(spark, folder):
        with pytest.raises(V.Busy), V.lock(spark, folder):
            pass
    with V.lock(spark, folder):
        pass


def test_stems_equal_a_second_implementation(spark, sf):
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("w")).distinct()
    published = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling failing filing happy sky relational conditional vietnamization hopefulness electriciti adjustable replacement adoption probate rate cease controll roll logi bli archaeology oed ing y by"
    every = words.unionByName(spark.createDataFrame([(w,) for w in published.split()], "w string")).distinct()
    got = {r.w: r.s for r in every.select("w", porter.stems(F.array("w"))[0].alias("s")).collect()}
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(x, tokenize='porter')")
    c.execute("create virtual table v using fts5vocab(t, instance)")
    names = sorted(got)
    c.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(names)))
    assert len(names) > 500 and {names[d]: t for d, t in c.execute("select doc, term from v")} == got


def test_match_expression(spark):
    rows = spark.createDataFrame([(["a", 'b"c'],), ([],), (None,)], "t array<string>")
    assert [r.e for r in rows.select(porter.match_expression(F.col("t")).alias("e")).collect()] == ['"a" OR "b""c"', None, None]
    assert [r.s for r in rows.select(porter.stems(F.col("t")).alias("s")).collect()] == [["a", 'b"c'], [], None]
