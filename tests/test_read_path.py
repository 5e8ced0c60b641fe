"""Searching, reranking, recalling and reading pages; capture of messages and calls; the spool; facts by brute force."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream import reader
from quillstream.functions import capture, facts, updates
from quillstream.operators import curation as C
from quillstream.operators import episodes as E
from quillstream.operators import retrieval as R
from quillstream.sources import spool as S
from quillstream.sources import wiki as W

PAGES = [
    ("mail", "m/mail.md", "Mail relay", "mail, network", "system", "active", "# Mail relay\n\nIt runs on port 2525.\nLogs go to disk.\n\n## Limits\n\nThe queue holds 500 letters.\n\n### Old\n\nIt held 100.\n\n## Limits\n\nNone now."),
    ("shop", "m/shop.md", "Web shop", "shop", "system", "active", "The shop sells mugs.\nThe relay sends its letters."),
    ("all", "index.md", "Index", "", "index", "active", "mail relay shop"),
    ("bare", "b.md", None, None, "note", "draft", None),
]


@pytest.fixture(scope="session")
def pages(spark):
    return spark.createDataFrame(PAGES, "page string, path string, title string, tags string, type string, status string, body string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def test_titles_count_in_full_and_index_pages_stay_out(spark, pages):
    hits = reader.Reader(pages).search(asked(spark, "mail relay", "kubernetes charts", "letters of the queue", "", 'foo AND ("', None)).collect()
    got = {(r.query_id, r.rank): (r.page, r.score) for r in hits}
    assert got[0, 1] == ("mail", 1.0) and got[0, 2][0] == "shop" and got[0, 2][1] < 0.7
    assert got[2, 1][0] == "mail" and {q for q, _ in got} == {0, 2}
    assert next(r.snippet for r in hits if (r.query_id, r.rank) == (2, 1)) == "The queue holds 500 letters."
    index = reader.Lexical(pages).retrieve(asked(spark, "relay"), 5, "index").collect()
    assert [r.page for r in index] == ["all"]


def test_focus_and_forms_of_a_query(spark):
    q = ["Your folder is: /srv/work/runs/job-7/space\n\nTask: sum up notes/inbox.md daily.", "see https://example.org/a/b and ~/src/app/main.py", "on 30/09/2026, and/or 1/2 of it", None]
    got = [r[0] for r in asked(spark, *q).orderBy("query_id").select(R.focus(F.col("query"))).collect()]
    assert got == ["Your folder is: space\n\nTask: sum up notes/inbox.md daily.", "see https://example.org/a/b and main.py", "on 30/09/2026, and/or 1/2 of it", ""]
    forms = [r[0] for r in asked(spark, "You run in an app.\n\nWhat dose? What does the dog get?", "One line?").orderBy("query_id").select(R.rerank_queries(F.col("query"))).collect()]
    assert forms[0][0] == "You run in an app. What dose? What does the dog get?" and "What does the dog get?" in forms[0] and "You run in an app." in forms[0]
    assert forms[1] == ["One line?"]


def test_rerank_orders_and_falls_back(spark, pages):
    queries = asked(spark, "relay letters")
    base = reader.Lexical(pages)
    got = reader.Reranked(base, reader.texts_of(pages), lambda q, t: [float("mugs" in x) for x in t]).retrieve(queries, 3).orderBy("rank").collect()
    assert [(r.page, r.score, r.via) for r in got] == [("shop", 1.0, "rerank"), ("mail", 0.0, "rerank")]

    def away(q, t):
        raise TimeoutError

    plain = base.retrieve(queries, 3).orderBy("rank").collect()
    back = reader.Reranked(base, reader.texts_of(pages), away).retrieve(queries, 3).orderBy("rank").collect()
    assert [(r.page, r.score, "base") for r in plain] == [(r.page, r.score, r.via) for r in back]


def test_what_is_recalled(spark):
    rows = [(1, s, p, "rerank") for s, p in ((0.5, 0.0), (0.003, 0.0), (0.003, 0.45), (0.001, 0.0))] + [(2, 0.02, 0.0, "rerank"), (2, 0.004, 0.0, "rerank"), (2, 0.001, 0.0, "rerank"), (3, 0.3, 0.3, "fts"), (3, 0.1, 0.9, "fts")]
    got = R.accepted(spark.createDataFrame(rows, "query_id int, score double, prior double, via string")).collect()
    assert sorted((r.query_id, r.score, r.prior) for r in got) == [(1, 0.003, 0.45), (1, 0.5, 0.0), (2, 0.004, 0.0), (2, 0.02, 0.0), (3, 0.3, 0.3)]


def test_prefetch_and_read(spark, pages):
    r = reader.Reader(pages)
    blocks = {x.query_id: x.block for x in r.prefetch(asked(spark, "where does the mail relay run?", "hello, thanks")).collect()}
    assert set(blocks) == {0} and "- [mail] Mail relay (system): " in blocks[0] and len(blocks[0]) <= reader.BUDGET
    wanted = spark.createDataFrame([("mail", "limits"), ("m/mail.md", "limits-1"), ("mail", "Old"), ("shop", None), ("no", None)], "name string, section string")
    got = {(x.name, x.section): x.text for x in r.read(wanted, raw=True).collect()}
    assert got == {("mail", "limits"): "## Limits\n\nThe queue holds 500 letters.\n\n### Old\n\nIt held 100.", ("m/mail.md", "limits-1"): "## Limits\n\nNone now.", ("mail", "Old"): "### Old\n\nIt held 100.", ("shop", None): PAGES[1][6]}


def test_dense_retriever_and_fusion(spark, pages):
    units = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 10, [0.0, 1.0]), (3, 20, [0.6, 0.8])], "unit long, page long, vec array<double>")
    embed = lambda q: q.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("qvec"))
    model = {"model_id": "a", "revision": "1", "dim": 2}
    got = reader.Dense(units, embed, model, model).retrieve(asked(spark, "x"), 5).collect()
    assert [(r.page, r.score, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(10, 1.0, 1), (20, 0.7143, 2)]
    assert reader.Dense(units, embed, model, model | {"revision": "2"}).retrieve(asked(spark, "x"), 5).count() == 0

    class Broken(reader.Retriever):
        def retrieve(self, queries, k, type=None):
            raise OSError

    fused = reader.Fused([(reader.Lexical(pages), 1.0), (Broken(), 1.0)]).retrieve(asked(spark, "mail relay"), 2)
    assert [r.page for r in fused.orderBy("rank").collect()] == ["mail", "shop"]


def test_dense_against_numpy(spark):
    r = np.random.RandomState(1)
    x = r.normal(size=(300, 8))
    units = spark.createDataFrame([(i, i % 7, v.tolist()) for i, v in enumerate(x)] + [(900, 1, [1.0]), (901, 1, None), (None, 1, [0.0] * 8)], "unit long, page long, vec array<double>")
    queries = units.where("unit % 100 = 0").select(F.col("unit").alias("query_id"), F.col("vec").alias("qvec"))
    got = {(g.query_id, g.rank): g.unit for g in R.dense_topk(queries, units, 4).collect()}
    for q in (0, 100, 200):
        order = sorted(range(300), key=lambda i: (-round(float(x[i] @ x[q]), 6), i))[:4]
        assert [got[q, k] for k in range(1, 5)] == order
    assert got[900, 1] == 900 and R.dense_topk(queries.where("false"), units, 4).count() == 0


# -- capture --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,keep",
    [
        ('memory replace: content="The relay runs on port 26.", old_text="port 25", target=memory', ""),
        ("Memory (user):", ""),
        ("<tool_call>\n<function=memory>\nadd\n</function>\n</tool_call>", ""),
        ('{"name": "terminal", "arguments": {"command": "ls {a}"}}', ""),
        ('Look.\n```json\n{"tool": "memory_search", "query": "mail port"}\n```', "Look."),
        ('memory_search(query="mail port", limit=3)', ""),
        ('functions.memory_read(page="ops.mail")', ""),
        ('{"action": "add", "target": "memory", "content": "x"}', ""),
        ("Saving.\n<tool_call>\n<function=memory>\nadd", "Saving."),
        ('<|tool_call_begin|>functions.terminal:0{"command": "ls"}<|tool_call_end|>', ""),
    ],
)
def test_printed_calls_go(text, keep):
    assert capture.strip_calls(text) == (keep, True)


@pytest.mark.parametrize("text", ["The relay runs on port 25.", "Memory: 128 GB, shared.", "Use the `terminal` tool to run `ls`.", 'It sets `max: 3` and `name: "x"`.', '{"output": "RTX", "exit_code": 0}', "I'll open the page first.", "", "{ not json"])
def test_ordinary_texts_stay(spark, text):
    assert capture.strip_calls(text) == (text, False)
    assert capture.strip_calls(None) == ("", False)


def test_every_printed_call_passes_the_cheap_test(spark):
    texts = ["memory_search(query=1)", "<tool_call>", '{"tool": "x", "a": 1}', "functions.f()", "plain words"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(capture.mentions_call(F.col("t"))).collect()]
    assert got == [True, True, True, True, False]


def test_contents_are_cut_to_their_size():
    big = json.dumps({"a": "ä" * 5000, "b": [{"c": "x" * 5000}], "n": 1})
    cut = capture.truncate_content(big, 4000)
    assert len(cut.encode()) <= 4000 and json.loads(cut)["n"] == 1 and "bytes]" in json.loads(cut)["a"]
    many = json.dumps({str(i): "y" * 300 for i in range(100)})
    assert json.loads(capture.truncate_content(many, 2000))["truncated"] and capture.truncate_content("no json" * 900, 2000).startswith("{")
    assert capture.truncate_content(None, 10) is None and capture.truncate_content("{}", 10) == "{}"


def test_file_changes(spark):
    patch = "*** Begin Patch\n*** Update File: a/b.py\n@@\n*** Add File: c d.txt\n+x\n*** Delete File: e\n*** Move File: f -> g\n*** End Patch"
    rows = [("write_file", json.dumps({"path": "x.md"})), ("patch", json.dumps({"path": "y.md", "old": "a"})), ("patch", json.dumps({"mode": "patch", "patch": patch})), ("terminal", json.dumps({"path": "z"})), ("write_file", "{}"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tool string, args string").withColumn("c", capture.file_changes(F.col("tool"), F.col("args")))
    got = {r.i: [(c["path"], c["op"], c["from"]) for c in r.c] for r in df.collect()}
    assert got == {0: [("x.md", "write", None)], 1: [("y.md", "replace", None)], 2: [("c d.txt", "add", None), ("a/b.py", "update", None), ("e", "delete", None), ("g", "move", "f")], 3: [], 4: [], 5: []}


def test_events_are_made(spark):
    rows = spark.createDataFrame([("01", "t", "s", "do x", "done", "child")], "id string, ts string, session_id string, task string, result string, child_session string")
    got = capture.events(rows, "delegation").first()
    assert got.event_type == "delegation" and got.source_refs == ["session:s", "session:child"] and json.loads(got.content)["task"] == "do x"


def test_spool_additions(spark):
    spool = spark.createDataFrame([(f"{i:02d}", "s" if i % 2 else "t", "new", 0, None, None, '{"a": 1}') for i in range(6)], "id string, session_id string, status string, attempts int, claimed_by string, claimed_at double, content string")
    assert [r.id for r in S.list_rows(spool, 2, session_id="s").collect()] == ["03", "05"]
    assert S.get(spool, "03", "a int").first().content.a == 1 and S.get(spool, "zz").count() == 0
    more = spark.createDataFrame([("07", "s", '{"a": "' + "x" * 4000 + '"}'), ("01", "s", "{}")], "id string, session_id string, content string")
    added = {r.id: r for r in S.append(spool, more, 1024).collect()}
    assert len(added) == 7 and len(added["07"].content.encode()) <= 1024 and added["07"].source_refs == ["session:s"] and added["07"].status == "new"
    mine = {r.id: (r.status, r.claimed_by) for r in S.append_claimed(spool, more.where("id = '07'"), "w", 1.0).collect()}
    assert mine["07"] == ("processing", "w")


# -- pages and claims -----------------------------------------------------------------------------------------------


def test_claims_in_three_sentences(spark):
    body = "# Facts\n\nThe relay was set up in spring. It has a queue for letters. The queue holds 500 of them.\n\n- Old way: post."
    pages = spark.createDataFrame([(1, body)], "page_id long, body string")
    claims = spark.createDataFrame([(1, 1, "The relay queue holds 500 letters."), (2, 1, "The relay queue holds 600 letters."), (3, 1, "a queue for letters"), (4, 1, "Mugs are blue today"), (5, 2, "The relay queue holds 500 letters.")], "claim_id long, page_id long, text string")
    assert sorted(r.claim_id for r in C.present_in_text(claims, pages).collect()) == [1, 3]
    assert W.md_sentences("One. Two is e.g. small\ngoes on. Three!\n- item a\n| x | y |\n\nlast") == ["One.", "Two is e.g. small goes on.", "Three!", "item a", "x | y", "last"]


def test_bullets_and_live_bodies(spark):
    body = "# P\n- New. (stated 2024-02-01) (observed)\n- ~~Old.~~ (inferred; superseded 2024-02-01 by session:a)\n* Plain\n_Provenance: us_\n"
    df = spark.createDataFrame([(1, body), (2, None)], "page_id long, body string")
    got = [(r.line, r.text, r.label, r.live) for r in W.bullets(df, "page_id", "body").orderBy("line").collect()]
    assert got == [(1, "New. (stated 2024-02-01)", "observed", True), (2, "Old.", "inferred", False), (3, "Plain", None, True)]
    assert [r[0] for r in df.orderBy("page_id").select(W.live_body(F.col("body"))).collect()] == ["# P\n- New. (stated 2024-02-01) (observed)\n* Plain", ""]


def test_front_matter_round_trip(spark):
    raw = "---\nid: x\ntype: note\nstatus: active\ncreated: 2024-01-01\nupdated: 2024-01-02\nconfidence: high\ntags:\n  - one\n  - \"two\"\nrelated: [y]\n---\nBody"
    page = W.parse(spark.createDataFrame([("p", raw)], "path string, raw string"))
    again = W.parse(page.select("path", W.serialize({c: F.col(c) for c in (*W.REQUIRED, "sources", "related", "tags")}, F.col("body")).alias("raw")))
    assert page.first().tags == ["one", "two"] and page.collect() == again.collect()


def test_explicit_supersession(spark):
    old = spark.createDataFrame([(1, 1, "The pottery class meets in room 4 on Thursdays.", None), (1, 2, "The chess club meets on Mondays.", None)], "page_id long, claim_id long, text string, superseded_on date")
    new = spark.createDataFrame([(1, 10, ["Pottery class meets in room 4 on Thursdays"]), (1, 11, None), (2, 12, ["The chess club meets on Mondays."])], "page_id long, claim_id long, supersedes array<string>")
    assert [tuple(r) for r in C.explicit(new, old).collect()] == [(10, 1)]


def test_incremental_index(spark):
    index = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "page int, term string")
    out = W.update_index(index, spark.createDataFrame([(2, "x")], "page int, term string"), spark.createDataFrame([(3,)], "page int"), "page")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (1, "b"), (2, "x")]


# -- facts ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [
        ("The pool size limit is 25.", {"measure:pool-size-limit": {"25"}}),
        ("Die Miete beträgt 1.250,50 Euro.", {"measure:miete": {"1250.50"}}),
        ("The club car has the plate number KX 902.", {"measure:plate-number": {"902"}}),
        ("It has default_theme = Nord-2 here.", {"name": {"nord-2"}}),
        ("Set theme=Nord-2 please", {"name": {"nord-2"}}),
        ("Met on March 3rd, 2024.", {"date": {"march3rd,2024"}}),
        ("Host is called mole-3 and port is 81", {"host": {"mole-3"}, "port": {"81"}}),
        ("There were 20 people", {}),
    ],
)
def test_measures_and_names(text, want):
    assert {k: set(v) for k, v in facts.slots(text).items()} == want


@pytest.mark.parametrize("text,want", [("Note: our mail relay runs on port 25.", "mail relay"), ("We moved the mail relay to port 26.", "mail relay"), ("The machine has an **RTX4090** GPU.", "GPU"), ("redis is listening on 6379", "Redis"), ("It runs on 25", ""), ("Which port is it?", ""), (None, "")])
def test_subjects(text, want):
    assert facts.subject_of(text) == want


def test_planted_values_are_found_in_long_texts():
    r = random.Random(7)
    for _ in range(60):
        port, name = r.randint(1000, 65535), "".join(r.choices("abcdefgh", k=6))
        plant = f"{name} listens on port {port}."
        words = ["".join(r.choices("xyzuvw", k=r.randint(1, 9))) for _ in range(400)]
        words[r.randint(0, 399)] += f". {plant}"
        assert facts.values(" ".join(words)) == [("port", str(port), str(port))]


def test_values_against_single_shape_patterns():
    """Shapes without cues, held against one plain pattern each, on texts of random words and signs."""
    r = random.Random(1)
    kinds = {"ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "time": lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}", "url": lambda: "https://ab.example/" + "".join(r.choices("abc", k=4)), "date": lambda: f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", "path": lambda: "/etc/" + "".join(r.choices("abc", k=4))}
    for _ in range(100):
        planted = [(k, f()) for k, f in r.sample(sorted(kinds.items()), 3)]
        text = " ".join(f"{''.join(r.choices('qwertz', k=5))} {v}{r.choice(['', ',', '.'])}" for _, v in planted)
        assert [(s, v) for s, v, _ in facts.values(text)] == planted


def test_clauses_that_hold_and_occasions():
    assert updates.carried("The relay runs on port 25, keeps logs in /var/log/relay", ["The relay runs on port 26"]) == ["keeps logs in /var/log/relay"]
    assert updates.other_occasion("Met Jo on 2024-01-02", "Met Jo on 2024-01-03") and not updates.other_occasion("Met Jo", "Met Jo on 2024-01-03")


# -- scale ----------------------------------------------------------------------------------------------------------


def test_following_is_one_running_frame(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("p"), "id", (F.col("id") % 1000 == 999).alias("f"))
    out = E.following(rows, "p", "id", F.col("f"), "id", "next")
    assert "UNBOUNDED FOLLOWING" not in out._jdf.queryExecution().executedPlan().toString().upper().replace("UNBOUNDEDFOLLOWING$", "UNBOUNDED FOLLOWING")
    got = {r.id: r.next for r in out.where("id in (0, 998, 999, 29999)").collect()}
    assert got == {0: 999, 998: 999, 999: 1999, 29999: None}


def test_no_product_in_the_dense_scan(spark):
    units = spark.createDataFrame([(1, 1, [1.0])], "unit long, page long, vec array<double>")
    plan = R.dense_topk(units.select(F.col("unit").alias("query_id"), F.col("vec").alias("qvec")), units, 1)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", plan)
