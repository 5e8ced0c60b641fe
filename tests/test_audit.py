"""Logs, drafts, targets, preferences and a model's answers on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from quillstream.operators import audit as A


def test_drafts_merge_by_type_and_subject(spark):
    rows = [("e", 1, "decision", "The Relay", ["a", "b"]), ("e", 0, "decision", "the relay", ["b", "c"]), ("e", 2, "noise", None, []), ("f", 0, "decision", "the relay", ["x"])]
    got = A.merged_drafts(spark.createDataFrame(rows, "episode_id string, ord int, type string, subject string, claims array<string>")).collect()
    assert sorted((r.episode_id, r.ord, r.subject, tuple(r.claims)) for r in got if r.type == "decision") == [("e", 0, "the relay", ("b", "c", "a")), ("f", 0, "the relay", ("x",))]


def test_targets_by_subject(spark):
    pages = spark.createDataFrame([(1, "b.md", "Mail Relay", None), (2, "a.md", None, "the mail relay"), (3, "c.md", "", "")], "page_id long, path string, title string, subject string")
    cand = spark.createDataFrame([(1, "our mail relay"), (2, None), (3, "shop")], "candidate_id long, subject string")
    assert [tuple(r) for r in A.by_subject(cand, pages).collect()] == [(1, 2)]


def test_preferences_in_order_without_repeats(spark):
    entries = spark.createDataFrame([(0, "Likes tabs in code"), (1, "Likes tabs in the code"), (2, "Never likes tabs in code"), (3, "Wants short answers"), (4, "Loves green tea")], "ord int, entry string")
    queries = spark.createDataFrame([(1, "which tea is green"), (2, "hello")], "query_id int, query string")
    got = {}
    for r in A.preferences(entries, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.ord)
    assert got == {1: [4, 3, 0, 2], 2: [3, 0, 2, 4]}


def test_echoes(spark):
    claims = spark.createDataFrame([(1, "e", "The relay listens on port 2525"), (2, "e", "The relay listens on port 26"), (3, "f", "x"), (4, "e", "")], "claim_id int, episode_id string, text string")
    shown = spark.createDataFrame([("e", "mail relay: port 2525, listens always"), ("e", None)], "episode_id string, text string")
    assert [r.claim_id for r in A.echoes(claims, shown).collect()] == [1]


def test_edits_rewrites_and_routes(spark):
    changes = spark.createDataFrame([("1", "a.md", "s", "write"), ("2", "a.md", "t", "replace"), ("3", "b.md", "s", "write")], "id string, path string, session_id string, op string")
    assert [tuple(r) for r in A.edited_pages(changes, spark.createDataFrame([("a.md",), ("c.md",)], "path string")).collect()] == [("a.md", "t", "replace")]
    log = spark.createDataFrame([([("added", None)], ["1"]), ([("superseded", "new")], ["2", "5"]), ([("superseded", "new")], ["3"])], "l1 array<struct<status: string, replacement: string>>, event_ids array<string>")
    assert [tuple(r) for r in A.own_rewrites(log).collect()] == [("new", "5")]
    rows = spark.createDataFrame([("none", None), (None, None), ("user", "added"), ("core", "full"), ("wiki", None)], "d string, s string")
    assert [r[0] for r in rows.select(A.route(F.col("d"), F.col("s"))).collect()] == ["dropped", "dropped", "profile", "wiki", "wiki"]


@pytest.mark.parametrize("name,arguments,want", [("terminal", '{"a": 1}', None), ("", "{}", "no name"), (None, "{}", "no name"), ("x<y", "{}", "markup in the name"), ("nope", "{}", "unknown tool"), ("terminal", "<tool_call>{}", "markup in the arguments"), ("terminal", "[1]", "arguments are no object"), ("terminal", '{"a": }', "arguments are no object"), ("terminal", None, "arguments are no object")])
def test_calls_are_judged(spark, name, arguments, want):
    df = spark.createDataFrame([(name, arguments)], "n string, a string")
    assert df.select(A.call_issue(F.col("n"), F.col("a"), ["terminal"])).first()[0] == want


def test_prose_and_files_give_claims():
    assert A.split_enumeration("relay on 2525, shop on 8080 and wiki on 81.") == ["relay on 2525.", "shop on 8080.", "wiki on 81."]
    assert A.split_enumeration("The relay, the shop and the wiki are up.") == ["The relay, the shop and the wiki are up."] and A.split_enumeration(None) == []
    assert A.file_claims("a/b.toml", "# c\nport = 25\nname: \"x\" # why\napi_token = zzz\n[section]\nnested = {a = 1}\n") == ["In a/b.toml port = 25.", "In a/b.toml name = x."]
    assert A.file_claims("a.py", "port = 25") == A.file_claims(None, None) == []


def test_the_log_is_kept(spark, tmp_path):
    ddl = "ts string, session_id string, outcome string"
    A.log_records(spark.createDataFrame([("2", "s", "created"), ("1", "s", "ignored")], ddl), f"{tmp_path}/log")
    A.log_records(spark.createDataFrame([("3", "s", "updated"), ("4", "t", "failed")], ddl), f"{tmp_path}/log")
    assert [r.ts for r in A.read_log(spark, f"{tmp_path}/log", ddl, "s", 2).collect()] == ["2", "3"]
    A.dead_letters_to(spark.createDataFrame([("1", "dead"), ("2", "done")], "id string, status string"), f"{tmp_path}/dead")
    assert [r.id for r in spark.read.json(f"{tmp_path}/dead").collect()] == ["1"]
    assert A.next_number(spark.createDataFrame([("x",)], "n string"), "n", "adr").first().next == 1
