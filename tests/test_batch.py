"""A batch from claim to commit, twice; failures; empty tables."""

import json

from quillstream.operators import batch as B
from quillstream.operators import writing as W
from quillstream.sources import versions as V

EVENTS = "id string, session_id string, event_type string, ts double, content string, status string, attempts int, claimed_by string, claimed_at double"
PAGES = "page_id string, path string, type string, title string, subject string, status string, confidence string, created string, updated string, tags array<string>, sources array<string>, body string, version int"


def event(n, session, kind, **content):
    return (f"{n:03d}", session, kind, 100.0 + n, json.dumps(content), "new", 0, None, None)


def spool(spark, *rows):
    return spark.createDataFrame(list(rows), EVENTS)


ROWS = (
    event(1, "a", "turn", user="The mail relay runs on port 2525 since today.", assistant="Noted."),
    event(2, "a", "turn", user="From now on I want short answers in English.", assistant="I suggest we keep the logs for ten days."),
    event(3, "a", "turn", user="Yes, sounds good", assistant="OK"),
    event(4, "b", "turn", user="My neighbour's relay runs on port 99 (not ours).", assistant="I see."),
    event(5, "b", "tool_call", tool="terminal", args={"command": "make all"}, status="error", result_excerpt="no rule"),
    event(6, "b", "tool_call", tool="terminal", args={"command": "make all"}, status="ok", result_excerpt="built the docs target"),
    event(7, "b", "turn", user="please build", assistant="The docs target is built."),
    event(8, "c", "tool_call", tool="terminal", args={"command": "ls"}, status="ok"),
    event(9, "c", "l1_write", action="add", content="x"),
)
RELAY = ("environment.mail-relay", "environment/mail-relay.md", "environment", "Mail relay", "Mail relay", "active", "medium", "2030-01-01", "2030-01-01", [], ["session:z"], "# Mail relay\n\n## Facts\n\n- The mail relay runs on port 25. (observed)\n\n## Updates\n", 3)


def test_batch_from_claim_to_commit(spark, tmp_path):
    work, wiki = f"file://{tmp_path}/work", f"file://{tmp_path}/wiki"
    pages = spark.createDataFrame([RELAY], PAGES)
    got = B.run(spool(spark, *ROWS), pages, work, "b1", "2030-05-06", 130.0, "w1")
    log = {(r.episode_id, r.type): (r.outcome, r.page_id, r.refused) for r in got.log.collect()}
    assert log == {
        ("001", "environment"): ("updated", "environment.mail-relay", []),
        ("002", "user_preference"): ("created", W.PREFERENCES[0], []),
        ("003", "decision"): ("created", "decision.adr-0001", []),
        ("004", "environment"): ("dropped", None, ["third party"]),
        ("005", "learning"): ("created", log[("005", "learning")][1], []),
    }
    new = {r.page_id: r for r in got.written.collect()}
    body = new["environment.mail-relay"].body
    assert "- ~~The mail relay runs on port 25.~~ (observed; superseded 2030-05-06 by session:a)" in body and "- The mail relay runs on port 2525 since today. (observed)" in body
    assert new["environment.mail-relay"].version == 4 and "keep the logs for ten days" in new["decision.adr-0001"].body
    assert {r.id: r.status for r in got.spool.collect()} == {**{f"{n:03d}": "done" for n in (1, 2, 3, 4, 5, 6, 7, 9)}, "008": "new"}
    assert got.dead.count() == 0
    B.commit(pages, got, wiki, "b1")
    stored = V.read(spark, wiki)
    assert stored.count() == 4

    # the same statements again change nothing
    again = B.run(spool(spark, *ROWS[:3]), stored, work, "b2", "2030-05-07", 131.0, "w1")
    assert {r.type: r.outcome for r in again.log.collect()} == {"environment": "ignored", "user_preference": "ignored", "decision": "ignored"}
    assert again.written.count() == 0


def test_refused_pages_are_tried_again_and_die(spark, tmp_path):
    bad = spark.createDataFrame([(*RELAY[:1], "../relay.md", *RELAY[2:])], PAGES)
    odd = ("010", None, "turn", None, None, "new", 0, None, None)
    once = (*ROWS[1][:6], 1, None, None)
    got = B.run(spool(spark, (*ROWS[0][:6], 1, None, None), once, odd), bad, f"file://{tmp_path}/work", "b1", "2030-05-06", 130.0, "w1", max_attempts=2)
    assert {r.episode_id: r.outcome for r in got.log.collect()} == {"001": "failed", "002": "created"}
    assert [r.page_id for r in got.written.collect()] == [W.PREFERENCES[0]]
    assert {r.id: (r.status, r.attempts) for r in got.spool.collect()} == {"001": ("dead", 2), "002": ("done", 1), "010": ("done", 0)}
    assert [r.id for r in got.dead.collect()] == ["001"]


def test_empty_queue_and_no_pages(spark, tmp_path):
    got = B.run(spool(spark), spark.createDataFrame([], PAGES), f"file://{tmp_path}/work", "b1", "2030-05-06", 1.0, "w1")
    assert got.spool.count() == got.written.count() == got.log.count() == got.dead.count() == 0
