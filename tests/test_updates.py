"""Topics of commands, changes of claims, profiles, rendering, gate checks and stateful episodes on hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstream.functions import commands, updates
from quillstream.operators import curation as C
from quillstream.operators import gate as G
from quillstream.operators import render as R
from quillstream.streaming import episodes as S


def test_command_topics(spark):
    want = {"nvidia-smi -L": "GPU", "lspci | grep -i nvidia": "GPU", "sudo lscpu": "CPU", "cat /proc/meminfo": "Memory (RAM)", "docker exec -it db-1 sh": "Docker container db-1", "docker-compose up": "Docker containers", "systemctl list-units": "systemd services", "lsof -i :80": "Listening ports", "lsof": "", "python x.py": "", "": "", None: ""}
    rows = spark.createDataFrame([(c,) for c in want], "c string").select("c", commands.topic(F.col("c")).alias("t")).collect()
    assert {r.c: r.t.subject for r in rows} == want
    assert all((r.t.tags == []) == (r.t.subject == "") for r in rows)


@pytest.mark.parametrize(
    "new,old,want",
    [
        ("We moved the mail relay to port 2525.", "Mail relay runs on port 25.", ("value", "Mail relay runs on port 2525.")),
        ("The mail relay now runs on port 2525.", "The mail relay runs on port 2500.", ("value", "The mail relay runs on port 2525.")),
        ("Update: mail relay moved from port 2500 to port 2525", "mail relay on port 2500", ("value", "mail relay on port 2525")),
        ("The web shop runs on port 2525.", "The mail relay runs on port 2500.", None),
        ("The mail relay no longer runs on port 2500.", "The mail relay runs on port 2500.", ("retracted", None)),
        ("The mail relay no longer runs on port 2500.", "The mail relay runs on port 9000.", None),
        ("We cancelled the weekly reviews", "The weekly review is at 10:15.", ("retracted", None)),
        ("The review is now in room C on odd weeks", "The review is in room B on odd weeks", ("shape", None)),
        ("Same text on port 2500", "Same text on port 2500", None),
        (None, "x", None),
        ("", "", None),
    ],
)
def test_changes_of_a_pair(new, old, want):
    assert updates.change(new, old) == want


def test_changes_are_blocked_on_the_page(spark):
    old = spark.createDataFrame([(1, 1, "The mail relay runs on port 2500.", None), (2, 2, "The mail relay runs on port 2500.", None), (1, 3, None, None)], "page_id long, claim_id long, text string, superseded_on date")
    new = spark.createDataFrame([(1, 10, "The mail relay runs on port 2525."), (1, 11, None)], "page_id long, claim_id long, text string")
    assert [tuple(r) for r in C.changes(new, old).collect()] == [(10, 1, "value", "The mail relay runs on port 2525.")]
    assert C.changes(new, old.where("false")).count() == 0
    assert "Cartesian" not in C.changes(new, old)._jdf.queryExecution().toString()


def test_profiles_are_reconciled(spark):
    t = lambda day: dt.datetime(2024, 3, day)
    entries = spark.createDataFrame([("m", 0, "The mail relay runs on port 2500.", t(1)), ("m", 1, "Prefers mail relay talk on port 2500.", t(1)), ("m", 2, "The web shop runs on port 8000.", t(9)), ("n", 0, "The mail relay runs on port 2500.", t(1)), ("n", 1, "The mail relay runs on port 2525.", t(1))], "target string, ord int, entry string, written_at timestamp")
    claims = spark.createDataFrame([("m", 1, "The mail relay runs on port 2525.", t(5)), ("m", 2, "The web shop runs on port 8001.", t(5)), ("n", 3, "The mail relay runs on port 2525.", t(5))], "target string, claim_id long, text string, seen_at timestamp")
    got = {(r.target, r.ord): (r.status, r.replacement) for r in C.reconcile(entries, claims, 2200).collect()}
    assert got == {("m", 0): ("superseded", "The mail relay runs on port 2525."), ("m", 2): ("kept_newer", None), ("n", 0): ("removed", None)}
    assert {r.status for r in C.reconcile(entries, claims.where("claim_id = 1"), 10).collect()} == {"full"}


def test_pages_are_rendered():
    body = "# T\n\nUser asked: \"x\".\n\n## Facts · session:a\n\n- ~~Old. (stated 2024-01-01)~~ (observed; superseded 2024-02-01 by session:b)\n- New. (stated 2024-02-01) (observed)\n- Odd. (stated 2024-02-01) (inferred)\n\n## Status\n\n_Not recorded yet._\n\n## Updates\n\n### 2024-03-01 · session:c\n\n- Said. (stated 2024-03-01) (reported)\n_Provenance: us · event:1_\n"
    assert R.page(body).split("\n") == ["# T", "", 'User asked: "x".', "", "## Facts", "", "- New. (noted 2024-02-01)", "- Odd. (noted 2024-02-01, inferred)", "", R.UPDATES, "", "### 2024-03-01", "", "- Assistant reported: Said. (noted 2024-03-01)", "", R.SUPERSEDED, "- Old. (noted 2024-01-01; superseded 2024-02-01)"]
    assert R.page(None) == R.page("") == ""


def test_recall_keeps_its_budget(spark):
    hits = spark.createDataFrame([(1, 1, "a", "A", "note", "active", "x (noted 2024-01-01)", 0.9), (1, 2, "b", "B", "note", "stale", "y" * 200, 0.8), (1, 3, "c", "C", "note", "active", "z", 0.1), (2, 1, "c", "C", "note", "active", "z", 0.1), (3, 1, "d", None, None, None, None, 0.5)], "query_id long, rank int, id string, title string, type string, status string, snippet string, score double")
    got = {r.query_id: r.block for r in R.recall(hits, 240).collect()}
    assert set(got) == {1, 3} and all(len(b) <= 240 for b in got.values())
    lines = got[1].split("\n")
    assert lines[:2] == [R.RECALL, "- [a] A (note): x (noted 2024-01-01)"] and lines[2].startswith("- [b] B (note, stale): yy") and lines[2].endswith("…") and lines[3] == R.NOTES[0][1]
    assert got[3] == f"{R.RECALL}\n- [d]  ()" and R.recall(hits, 30).count() == 0


@pytest.mark.parametrize(
    "claim,source,want",
    [
        ("The export costs 4210.50 euros", "Der Export: 4.210,50 Euro, export costs", True),
        ("The export costs 4210.50 euros", "the export costs 4,210.50 euros", True),
        ("The job takes 700 seconds", "job took 700s, seconds", True),
        ("The job takes 700 seconds", "the job takes 7000 seconds", False),
        ("Meeting on Mittwoch", "das meeting ist mittwochs", True),
        ("Backups go to the attic", "the cellar is wet", False),
        ("", "anything", False),
        (None, None, False),
    ],
)
def test_grounding(spark, claim, source, want):
    df = spark.createDataFrame([(claim, source)], "c string, s string")
    assert df.select(G.grounded(G.content(F.col("c")), G.content(F.col("s")))).first()[0] is want


def test_the_gate_skips_and_checks(spark):
    rows = [("a", "Thanks!", "ok", 0, 0, "thanks only"), ("b", "Why? How?", "x", 0, 0, "questions only"), ("c", "Why is it on 8000?", "x", 0, 0, ""), ("d", None, None, None, None, "empty episode"), ("e", "", "x", 0, 0, "assistant text only"), ("f", "thanks", "x", 1, 0, ""), ("g", "We cancelled it. Ok?", "", 0, 0, "")]
    df = spark.createDataFrame(rows, "id string, user_text string, assistant_text string, n_calls int, n_changes int, want string")
    assert [r.id for r in G.skip_reason(df).where("skip <> want").collect()] == []
    claims = spark.createDataFrame([("e", c, o, f"Valve {c} holds {o} bar", kind, 0.9) for c in range(6) for o in range(8) for kind in ("user_stated",)] + [("e", 0, 9, "valve 0 holds 0 BAR", "user_stated", 0.9), ("e", 1, -1, "Valve 77 holds", "user_stated", 0.9), ("f", 0, 0, "Valve seen", "assistant_reported", None), ("f", 0, 1, "Valve seen once", "assistant_reported", 0.9)], "episode_id string, candidate int, ord int, text string, evidence string, confidence double")
    sources = spark.createDataFrame([("e", "user_stated", "valve holds bar 0 1 2 3 4 5 6 7 8"), ("f", "assistant_reported", "valve seen once")], "episode_id string, evidence string, text string")
    got = G.checked(claims, sources).collect()
    assert sorted((r.candidate, r.ord) for r in got if r.episode_id == "e") == [(c, o) for c in range(4) for o in range(6)]
    assert sorted(r.confidence for r in got if r.episode_id == "f") == [0.4, 0.4]


def test_a_stream_of_episodes_closes_by_turn_and_by_idleness(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cols = "session_id string, id string, event_type string, kind string, n int"
    days = [[("s", "01", "tool_call", None, 1), ("t", "02", "tool_call", None, 2)], [("s", "03", "turn", None, 3), ("u", "04", "tool_call", None, 90000)], [("v", "05", "turn", None, 90001)]]
    for k, rows in enumerate(days):
        spark.createDataFrame(rows, cols).withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("n"))).drop("n").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    seen = []
    q = S.run_batches(S.stream_episodes(stream, "1 minute"), lambda df, k: seen.extend((r.session_id, r.closed_by, tuple(r.events)) for r in df.collect()), f"{tmp_path}/ck")
    assert q.awaitTermination(180)
    assert sorted(seen) == [("s", "turn", ("01", "03")), ("t", "idle", ("02",)), ("v", "turn", ("05",))]
