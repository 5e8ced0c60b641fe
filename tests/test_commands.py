"""The commands over a folder of pages and a file of events."""

import json

from quillstream import __main__ as cli


def head(id, extra=""):
    return f"---\nid: {id}\ntype: note\nstatus: active\ncreated: 2024-01-01\nupdated: 2024-01-02\nconfidence: high\ntags: [mail]\n{extra}---\n"


def said(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_commands(spark, tmp_path, capsys):
    wiki = tmp_path / "wiki"
    wiki.mkdir()
    (wiki / "a.md").write_text(head("relay") + "# Mail relay\n\nIt runs on port 2525.\n\n## Limits\n\nNone.\n")
    (wiki / "b.md").write_text(head("shop") + "# Web shop\n\nIt sells mugs.\n")
    assert cli.main(["search", str(wiki), "mail relay port"]) == 0
    hits = said(capsys)
    assert hits[0]["page"] == "relay" and "2525" in hits[0]["snippet"]
    assert cli.main(["read", str(wiki), "relay", "--section", "Limits"]) == 0
    assert said(capsys)[0]["text"] == "## Limits\n\nNone."
    assert cli.main(["validate", str(wiki)]) == 0 and said(capsys) == []
    assert cli.main(["index", str(wiki), f"{tmp_path}/index"]) == 0
    (wiki / "b.md").write_text(head("shop") + "# Web shop\n\nIt sells cups.\n")
    (wiki / "c.md").write_text(head("new").replace("status: active", "status: odd") + "# New\n\nText.\n")
    capsys.readouterr()
    assert cli.main(["status", str(wiki), f"{tmp_path}/index"]) == 0
    assert {r["page_id"]: r["state"] for r in said(capsys)} == {"shop": "changed", "new": "missing"}
    assert cli.main(["validate", str(wiki)]) == 1 and said(capsys)[0]["issues"] == ["status is unknown"]
    (tmp_path / "events.json").write_text("\n".join(json.dumps({"session_id": "s", "id": i, "event_type": k, "ts": 1.0}) for i, k in (("1", "tool_call"), ("2", "turn"))))
    assert cli.main(["replay", f"{tmp_path}/events.json", f"{tmp_path}/out"]) == 0
    assert [(r.episode_id, r.closed_by) for r in spark.read.json(f"{tmp_path}/out").collect()] == [("1", "turn")]
    assert cli.main(["queries"]) == 0 and "fts_idf_topk" in capsys.readouterr().out
