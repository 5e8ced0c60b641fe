"""Values, dates, curation, classification, episodes and pages on hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstream.functions import dates, facts
from quillstream.operators import classify
from quillstream.operators import curation as C
from quillstream.sources import wiki as W
from quillstream.streaming import episodes as S

MONDAY = dt.date(2024, 3, 11)


def slots(text):
    out = {}
    for slot, value, _ in facts.values(text):
        out.setdefault(slot, set()).add(value)
    return out


@pytest.mark.parametrize(
    "text,want",
    [
        ("The queue listens on 9150 today.", {"port": {"9150"}}),
        ("Grafana is at mole-3:3100", {"host": {"mole-3"}, "port": {"3100"}}),
        ("See https://wiki.local:8443/x, please.", {"url": {"https://wiki.local:8443/x"}}),
        ("Gateway 10.1.2.3:53 answers", {"ip": {"10.1.2.3"}, "port": {"53"}}),
        ("Settings are in /etc/queue/main.toml", {"path": {"/etc/queue/main.toml"}}),
        ("Pinned to version 1.14.2", {"version": {"1.14.2"}}),
        ("The GPU is an **RTX4090**.", {"id:gpu": {"rtx4090"}}),
        ("It holds 64 GB", {"size": {"64gb"}}),
        ("There are 3 replicas.", {}),
        ("Backups run on Fridays at 03:30", {"day": {"friday"}, "time": {"03:30"}}),
        ("", {}),
        (None, {}),
    ],
)
def test_values(text, want):
    assert slots(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("We met yesterday.", "We met yesterday (2024-03-10)."),
        ("the day before yesterday it broke", "the day before yesterday (2024-03-09) it broke"),
        ("last monday and last friday", "last monday (2024-03-04) and last friday (2024-03-08)"),
        ("vor drei Tagen", "vor drei Tagen (2024-03-08)"),
        ("2 weeks ago", "2 weeks ago (2024-02-26)"),
        ("last week; last month; this month", "last week (≈ 2024-03-04); last month (2024-02); this month (2024-03)"),
        ("Nothing here", "Nothing here"),
    ],
)
def test_relative_dates(text, want):
    assert dates.resolve(text, MONDAY) == want == dates.resolve(want, MONDAY)


@pytest.mark.parametrize("text,want", [("Today is Monday, 11 March 2024. Hi", MONDAY), ("[Today is 2024-03-11]", MONDAY), ("Heute ist der 11.3.2024", MONDAY), ("date: March 11th, 2024", MONDAY), ("today is 2024-13-40", None), ("It was fine", None), (None, None)])
def test_stated_dates(text, want):
    assert dates.stated_date(text) == want


def test_claims_supersede_and_a_rerun_adds_nothing(spark):
    cols = "page_id long, claim_id long, text string, label string, stated_on date, superseded_on date, superseded_by long"
    old = spark.createDataFrame([(1, 1, "The build queue runs on port 8000.", "observed", MONDAY, None, None), (1, 2, "The mail relay runs on port 25.", "observed", MONDAY, None, None)], cols)
    new = spark.createDataFrame([(10, 1, "The build queue runs on port 8010.", "observed"), (11, 1, "The build queue runs on port 8000.", "observed"), (12, 1, "The build queue no longer runs on port 8000.", "observed")], "claim_id long, page_id long, text string, label string")
    out = C.supersede(old, new.where("claim_id < 12"), "2024-04-01")
    got = {r.claim_id: r.superseded_by for r in out.collect()}
    assert got == {1: 10, 2: None, 10: None}
    assert sorted(map(str, C.supersede(out, new.where("claim_id = 10"), "2024-05-01").collect())) == sorted(map(str, out.collect()))
    assert C.contradictions(new.where("claim_id = 12"), old).count() == 0


def test_targets_take_the_first_rule(spark):
    cand = spark.createDataFrame([(1,), (2,), (3,)], "candidate_id long")
    a = spark.createDataFrame([(1, 7, 0.1)], "candidate_id long, page_id long, score double")
    b = spark.createDataFrame([(1, 8, 0.9), (2, 9, 0.5), (2, 8, 0.5)], "candidate_id long, page_id long, score double")
    assert {r.candidate_id: r.page_id for r in C.targets(cand, [a, b]).collect()} == {1: 7, 2: 8}


def test_classification(spark):
    rows = [("s", 1, "How is it?", "I suggest we shard the table.", False, False), ("s", 2, "Yes, go ahead", "Done.", False, False), ("s", 3, "From now on I prefer tabs over spaces.", "ok", True, True), ("s", 4, None, None, None, None)]
    df = spark.createDataFrame(rows, "session_id string, id long, user_text string, assistant_text string, failed boolean, recovered boolean")
    assert sorted((r.id, r.type) for r in classify.classify(df).collect()) == [(1, "noise"), (2, "decision"), (3, "learning"), (3, "user_preference"), (4, "noise")]


EVENTS = [
    ("s", "02", "tool_call", None, 10.0),
    ("s", "01", "tool_call", None, 5.0),
    ("s", "03", "session_end", "turn_end", 11.0),
    ("s", "04", "tool_call", None, 12.0),
    ("s", "05", "turn", None, 13.0),
    ("s", "06", "session_end", "close", 14.0),
    ("s", "07", "file_change", None, 20.0),
    ("t", "08", "turn", None, 21.0),
    ("u", "09", "tool_call", None, 5000.0),
]


@pytest.mark.parametrize("flush,last", [(False, ("idle", "pending")), (True, ("flush", "flush"))])
def test_episodes(spark, flush, last):
    df = spark.createDataFrame(EVENTS, "session_id string, id string, event_type string, kind string, ts double")
    got = {(r.session_id, r.episode_id): (r.closed_by, r.events) for r in S.episodes(df, 5001.0, flush).collect()}
    assert got == {("s", "01"): ("turn", ["01", "02", "05"]), ("s", "04"): ("close", ["04"]), ("s", "07"): (last[0], ["07"]), ("t", "08"): ("turn", ["08"]), ("u", "09"): (last[1], ["09"])}
    assert S.episodes(df.where("false"), 0.0).count() == 0


def test_a_stream_of_boundaries_and_batches(spark, tmp_path):
    rows = spark.createDataFrame([("s", "close", 1), ("s", "close", 2), ("t", "close", 3)], "session_id string, kind string, n int").withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("n")))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    seen = []
    q = S.run_batches(S.first_boundaries(stream, "1 hour"), lambda df, k: seen.extend(r.session_id for r in df.collect()), f"{tmp_path}/ck")
    assert q.awaitTermination(120) and sorted(seen) == ["s", "t"]


def test_pages(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("---\nid: x\ntype: note\nstatus: active\ncreated: 2024-01-01\nupdated: 2024-01-02\nconfidence: high\ntags: [one, \"two\"]\n---\n# Top\nText\n```\n# no heading\n```\n## Sub ##\nMore")
    (tmp_path / "a/y.txt").write_text("no")
    page = W.parse(W.scan(spark, str(tmp_path))).withColumn("issues", W.issues()).collect()
    assert len(page) == 1 and page[0].id == "x" and page[0].tags == ["one", "two"] and page[0].issues == []
    assert W.sections(page[0].body) == [(1, "Top", "Text\n```\n# no heading\n```"), (2, "Sub", "More")]
    assert all(len(c) <= 700 for c in W.chunks("word " * 500)) and "".join(W.chunks("word " * 500)).replace(" ", "") == "word" * 500


def test_sync_embeds_only_what_is_new(spark):
    units = W.units(spark.createDataFrame([("p", "# A\none"), ("q", "# B\ntwo")], "page string, body string"), "page", "body")
    stored = units.where("page_id = 'p'").select("text_hash", F.array(F.lit(9.0).cast("float")).alias("vec"))
    got = {r.page_id: list(r.vec) for r in W.sync(stored, units, lambda texts: [[1.0]] * len(texts)).collect()}
    assert got == {"p": [9.0], "q": [1.0]}
