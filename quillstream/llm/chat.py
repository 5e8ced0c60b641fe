"""Chat formatting of reply trees.

Messages (tree_id, msg_id, parent_id, role, text, score) form trees. Self-joins double the pointers of every message to
its ancestors until none is left, then write each leaf's path, so a thread of n turns takes about 2 log2(n) joins of
ids alone. A branch's score is the mean of its messages' scores; the best `top` branches of a tree are kept, ties to
the smaller leaf, and each becomes one conversation. The template marks turns with control strings; one inside a text
or role is broken by a backslash after its first character, and a backslash is doubled, which reads back exactly.

A message whose parent is null or missing is a root; messages on a cycle have no root and are in no path. Null roles
and texts count as empty, null scores as 0, a null tree_id is a tree, rows without a msg_id are dropped, and of rows of
one tree and msg_id one counts (the least). A thread that leads into a cycle is in no path either. Flat
conversations become chains by turn, null first, ties by role and text; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import common

BEGIN, MIDDLE, END = "<|turn|>", "<|says|>", "<|over|>"
#: Control strings of this and of common templates. None is part of another, none ends as another begins.
CONTROL = (BEGIN, MIDDLE, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED = "assistant"
_BREAK = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))
_JOIN = re.compile(r"\\(\\?)")
_TURN = re.compile(f"{re.escape(BEGIN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _JOIN.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans of it (code points) that the loss is taken on."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role)}{MIDDLE}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def once(messages: DataFrame) -> DataFrame:
    """Messages with an id, one row each: of rows of one tree and id the least by parent, role, text and score counts."""
    kept = F.min(F.struct("parent_id", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("_m")
    return messages.where("msg_id is not null").groupBy("tree_id", "msg_id").agg(kept).select("tree_id", "msg_id", "_m.*")


def paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """tree_id, leaf_id, branch, branch_score, msg_id, depth (from 0 at the root) of the `top` best branches of each tree
    (None: all). Score sums are carried along the doubled pointers, so that only chosen branches are written out."""
    ids = common.materialise(once(messages).select("tree_id", "msg_id", "parent_id", "score"), "messages")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    known = ids.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"))
    up = common.materialise(ids.join(known, same("tree_id", "t") & (F.col("parent_id") == F.col("m")), "inner").select("tree_id", "msg_id", F.col("m").alias("to"), F.col("score").alias("sum")), "up")
    leaves = ids.join(up.select(F.col("tree_id").alias("t"), F.col("to").alias("p")).distinct(), same("tree_id", "t") & (F.col("msg_id") == F.col("p")), "left_anti").select("tree_id", "msg_id")
    jumps, n = [up], ids.count()
    while len(jumps) <= n.bit_length():  # longer ways than messages are cycles
        a = jumps[-1]
        b = a.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("via"), F.col("to").alias("far"), F.col("sum").alias("more"))
        a = common.materialise(a.join(b, same("tree_id", "t") & (F.col("to") == F.col("via"))).select("tree_id", "msg_id", F.col("far").alias("to"), (F.col("sum") + F.col("more")).alias("sum")), "up")
        if a.isEmpty():
            break
        jumps.append(a)
    via = lambda k: jumps[k].select(F.col("tree_id").alias("t"), F.col("msg_id").alias("via"), "to", F.col("sum").alias("more"))
    ends = leaves.select("tree_id", F.col("msg_id").alias("leaf_id"), F.col("msg_id").alias("at"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):  # at most one jump of each length leads to the root
        far = ends.join(via(k), same("tree_id", "t") & (F.col("at") == F.col("via")), "left")
        ends = far.select("tree_id", "leaf_id", F.coalesce("to", "at").alias("at"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("up") + F.when(F.col("to").isNotNull(), 1 << k).otherwise(0)).alias("up"))
    roots = ids.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "score").join(up.select(F.col("tree_id").alias("ut"), F.col("msg_id").alias("um")), F.col("t").eqNullSafe(F.col("ut")) & (F.col("m") == F.col("um")), "left_anti")
    each = ends.join(roots, same("tree_id", "t") & (F.col("at") == F.col("m"))).select("tree_id", "leaf_id", F.col("up").alias("length"), ((F.col("total") + F.col("score")) / (F.col("up") + 1)).alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("branch_score"), "leaf_id"))
    best = each.withColumn("branch", rank).where(F.lit(True) if top is None else F.col("branch") <= top)
    way = common.materialise(best.select("*", F.col("leaf_id").alias("msg_id"), F.col("length").alias("depth")), "paths")
    for k in range(len(jumps) - 1, -1, -1):
        more = way.join(via(k), same("tree_id", "t") & (F.col("msg_id") == F.col("via"))).select(*[c for c in way.columns if c not in ("msg_id", "depth")], F.col("to").alias("msg_id"), (F.col("depth") - (1 << k)).alias("depth"))
        way = common.materialise(way.unionByName(more), "paths")
    return way.select("tree_id", "leaf_id", "branch", "branch_score", "msg_id", "depth")


_OUT = pa.schema([("tree_id", pa.int64()), ("leaf_id", pa.int64()), ("branch", pa.int32()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree_id, leaf_id, branch, role, text) come by path in order; one path is held at a time."""
    now, turns, out, size = None, [], [], 0

    def close() -> None:
        nonlocal turns, size
        if now is not None:
            text, spans = render(turns)
            out.append((*now, text, [{"start": a, "end": b} for a, b in spans]))
            size += len(text)
        turns = []

    def rows() -> pa.RecordBatch:
        nonlocal out, size
        done, out, size = out, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _OUT.types)], schema=_OUT)

    for b in batches:
        for tree, leaf, branch, role, text in zip(*(b.column(i).to_pylist() for i in range(5))):
            if (tree, leaf, branch) != now:
                close()
                now = (tree, leaf, branch)
                if size > 4 << 20:
                    yield rows()
            turns.append((role or "", text or ""))
    close()
    if out:
        yield rows()


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """tree_id, leaf_id, branch, formatted, loss_spans array<struct<start,end>>: a row per chosen branch."""
    messages = common.materialise(messages.select("tree_id", "msg_id", "parent_id", "role", "text", "score"), "messages")
    words = once(messages).select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "role", "text")
    rows = paths(messages, top).join(words, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("m"))).select("tree_id", "leaf_id", "branch", "role", "text", "depth")
    rows = rows.repartition("tree_id", "leaf_id").sortWithinPartitions("tree_id", "leaf_id", "depth").drop("depth")
    return common.arrow_map(rows, _format, "tree_id long, leaf_id long, branch int, formatted string, loss_spans array<struct<start: long, end: long>>")


def flat(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as chains of messages."""
    at = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("msg_id", at).select("tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    for b in batches:
        rows = []
        for tree, text, spans in zip(common.col(b, "tree_id"), common.col(b, "formatted"), common.col(b, "loss_spans")):
            turns, learned = parse(text), [unescape(text[s["start"] : s["end"]]) for s in spans]
            rows.append((tree, len(turns), sha([x for role, said in turns for x in (role, "\n", said, "\n")]), sum(map(len, learned)), sha(learned), len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(formatted: DataFrame) -> DataFrame:
    return common.arrow_map(formatted, _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    return digest(format_trees(flat(rows.unionByName(planted))))


_CONTROL_SQL = "|".join(re.escape(c).replace("/", "/") for c in CONTROL)
OP3_SQL = rf"""
with c as (select conv_id, turn::bigint as turn, role, text from conversations
           union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
             row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k from c),
e as (select *, len(role) + len(text) + len(regexp_extract_all(role, '{_CONTROL_SQL}|\\')) + len(regexp_extract_all(text, '{_CONTROL_SQL}|\\')) + {len(BEGIN + MIDDLE + END)} as n from t)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256, sum(n)::bigint as formatted_chars
from e group by conv_id
"""
