"""Whose statement it is and how it is meant; where claims come from; what a model is shown."""

import pytest
from pyspark.sql import functions as F

from quillstream.functions import stance
from quillstream.operators import gate as G

CASES = [
    ("third party", "My landlord's cellar (not ours) has 3 pumps.", "The cellar has 3 pumps."),
    ("third party", "Mein Kollege Jens hat einen Server mit 96 GB RAM.", "Der Server hat 96 GB RAM."),
    ("", "Mein Kollege Jens hat einen Server mit 96 GB RAM. Meiner hat 16 GB RAM im Keller.", "Im Keller sind 16 GB RAM."),
    ("third party", "She says the lab switch has 12 ports.", "The lab switch has 12 ports."),
    ("third party", "Also, my aunt's cabin has 2 stoves.", "The cabin has 2 stoves."),
    ("", "My aunt's cabin has 2 stoves, so I ordered wood for both.", "The cabin has 2 stoves."),
    ("", "My aunt and I painted the cabin in April.", "The user painted the cabin in April."),
    ("", "Our manager wants us to archive logs every Monday.", "Archive logs every Monday."),
    ("", "The readme says the limit is 40, and we raised it to 60.", "The limit was raised to 60."),
    ("hypothetical", "If we move the rack we would need 7 cables.", "The rack needs 7 cables."),
    ("hypothetical", "Maybe the backup takes 90 minutes.", "The backup takes 90 minutes."),
    ("hypothetical", "The choir moves to Sundays. Nothing is decided.", "The choir moves to Sundays."),
    ("", "We should never deploy on Fridays.", "Never deploy on Fridays."),
    ("wish", "Someday I'd love to own a kiln.", "The user owns a kiln."),
    ("jest", "Oh great, the lift is as fast as a snail.", "The lift is fast."),
    ("question", "Does the relay listen on port 25?", "The relay listens on port 25."),
    ("", "I moved the relay to port 26, can you update the notes?", "The relay moved to port 26."),
    ("", "The relay listens on port 25.", "Something else entirely"),
    ("", "", ""),
    ("", None, "x"),
    ("", "x", None),
]


@pytest.mark.parametrize("want,message,claim", CASES)
def test_refusals(want, message, claim):
    assert stance.refusal(claim, message) == want


def test_refusals_as_a_column(spark):
    rows = spark.createDataFrame(CASES, "want string, message string, claim string")
    got = rows.select("want", stance.refusals(F.col("claim"), F.col("message")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_long_texts_end():
    message = "The relay listens on port 25. " * 5_000
    assert stance.refusal("The relay listens on port 25.", message) == ""
    assert stance.refusal("a " * 20_000, "a, and " * 20_000) == ""


def test_attribution(spark):
    claims = spark.createDataFrame(
        [
            (1, "The relay listens on port 25", "assistant_inferred"),
            (1, "The relay has 9 queues", "assistant_inferred"),
            (1, "The disk has 40 blocks", "assistant_inferred"),
            (1, "The old host was called ada", "assistant_inferred"),
            (1, None, "user_stated"),
            (2, "The lab switch has 12 ports", "user_stated"),
            (3, "Nobody was there with 3 things", "assistant_inferred"),
        ],
        "episode_id int, text string, evidence string",
    )
    sources = spark.createDataFrame(
        [
            (1, "user_stated", "Our relay listens on port 25 now."),
            (1, "tool_observed", "disk: 40 blocks"),
            (1, "shown", "The old host was called ada"),
            (1, "user_stated", None),
            (2, "user_stated", "He says the lab switch has 12 ports."),
        ],
        "episode_id int, evidence string, text string",
    )
    got = {r.text: (r.evidence, r.refused) for r in G.attributed(claims, sources).collect()}
    assert got == {
        "The relay listens on port 25": ("user_stated", ""),
        "The relay has 9 queues": ("assistant_inferred", "value of nobody"),
        "The disk has 40 blocks": ("assistant_inferred", ""),
        "The old host was called ada": ("assistant_inferred", "echo"),
        None: ("user_stated", "empty"),
        "The lab switch has 12 ports": ("user_stated", "third party"),
        "Nobody was there with 3 things": ("assistant_inferred", "value of nobody"),
    }
    assert G.attributed(claims.limit(0), sources).count() == 0


EPISODE = "user string, assistant string, previous_user string, previous_assistant string, known string, recalled string, calls array<struct<tool:string,args:string,status:string,output:string>>, files array<struct<op:string,path:string>>"


def prompts(spark, *rows, **more):
    return [r.prompt for r in G.prompt(spark.createDataFrame(list(rows), EPISODE), **more).collect()]


def test_prompt_has_its_parts(spark):
    got = prompts(spark, ("Hi", "Done", "Before", None, "fact", " ", [("terminal", "ls", None, "a\nb")], [("write", "x.py")]), (None, None, None, None, None, None, None, None))
    assert got[0] == "<previous_turn>\n<user>Before</user>\n<assistant></assistant>\n</previous_turn>\n<known>\nfact\n</known>\n<episode>\n<user>Hi</user>\n<tools>\n1 terminal ls ok: a\nb\n</tools>\n<files>\nwrite x.py\n</files>\n<assistant>Done</assistant>\n</episode>"
    assert got[1] == "<episode>\n<user></user>\n<assistant></assistant>\n</episode>"


def test_prompt_cuts_and_masks(spark):
    log = "start\n" + "fine\n" * 3000 + "ERROR: disk denied\n" + "fine\n" * 3000 + "end"
    calls = [("t", f"a{k}", "failed" if k == 11 else "ok", log) for k in range(12)]
    one = prompts(spark, ("u" * 9000, "b" * 9000, None, None, None, None, calls, None))[0]
    assert "chars cut]…" in one and one.count("ERROR: disk denied") == 8 and "t a11 failed" in one and "t a7 " not in one
    assert len(one) <= G.INPUT
    small = prompts(spark, ("u" * 9000, "b" * 9000, None, None, None, None, calls, None), most=1500)[0]
    assert len(small) == 1500
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    assert key not in prompts(spark, (f"the key is {key}", "ok", None, None, None, None, None, None))[0]
