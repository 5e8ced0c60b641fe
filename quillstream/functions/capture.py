"""What is kept of a host's messages and tool calls: contents cut to a size, printed calls taken out of prose, files that a
call changes, and the events made of them. JSON and prose are worked on in Arrow batches, the rest are Columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least bytes that a string of a cut content keeps.
LEAST = 256


def _cut(text: str, most: int) -> str:
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= most else f"{raw[:most].decode('utf-8', 'ignore')}…[+{len(raw) - most} bytes]"


def cap_values(value, most: int):
    """A JSON value whose strings, at any depth, have `most` bytes and a mark at most."""
    if isinstance(value, str):
        return _cut(value, most)
    if isinstance(value, list):
        return [cap_values(v, most) for v in value]
    if isinstance(value, dict):
        return {k: cap_values(v, most) for k, v in value.items()}
    return value


def truncate_content(content: str | None, most: int) -> str | None:
    """A JSON text of at most `most` bytes: its strings are cut to a quarter of that and then to half as much again, down
    to LEAST; what is too large even so, or no JSON, becomes an excerpt."""
    if content is None or len(content.encode("utf-8", "replace")) <= most:
        return content
    try:
        value = json.loads(content)
    except ValueError:
        value = None
    size = most // 4
    while value is not None and size >= LEAST:
        text = json.dumps(cap_values(value, size), ensure_ascii=False)
        if len(text.encode("utf-8", "replace")) <= most:
            return text
        size //= 2
    return json.dumps({"truncated": True, "excerpt": _cut(content, most // 2)}, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def truncated(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for content, most in rows:
        yield pd.Series([truncate_content(c, m) for c, m in zip(content, most)], dtype=object)


# -- printed tool calls ---------------------------------------------------------------------------------------------

#: Tools whose calls may be printed as a line of text.
TOOLS = ("memory", "memory_search", "memory_read", "terminal", "read_file", "write_file", "patch", "web_search", "search_files", "execute_code")
_TAGGED = re.compile(r"<tool_call>.*?(?:</tool_call>|\Z)|<\|tool_call_begin\|>.*?(?:<\|tool_call_end\|>|\Z)|<\|tool_calls?_(?:section_)?(?:begin|end)\|>", re.S)
_TOOL = "(?:functions\\.\\w+|" + "|".join(sorted(TOOLS, key=len, reverse=True)) + ")"
_CALL = re.compile(rf"{_TOOL}\s*\(\s*(?:\w+\s*=.*)?\)\s*;?")
_SETTING = re.compile(rf"{_TOOL}(?:\s+(?:add|replace|remove|search|read))?\s*:\s*(?:\w+\s*=\s*(?:\"[^\"]*\"|\S+)\s*,?\s*)+", re.I)
_LABEL = re.compile(rf"{_TOOL}\s*\((?:user|memory)\)\s*:", re.I)
_EMPTY_FENCE = re.compile(r"```\w*\s*```")


def is_call(value) -> bool:
    """Whether a JSON value is a tool call: a name with arguments, a tool with its own, a list of calls, or an action on a
    target of memory. Results of tools are none."""
    if not isinstance(value, dict):
        return False
    keys = value.keys()
    return "tool_calls" in keys or {"name", "arguments"} <= keys or {"action", "target"} <= keys or ("tool" in keys and len(keys) > 1)


def strip_calls(text: str | None) -> tuple[str, bool]:
    """A text without the tool calls that are printed in it, and whether there were any; a text without any is untouched."""
    text = text or ""
    out, reader, at = [], json.JSONDecoder(), 0
    rest = _TAGGED.sub("", text)
    while (k := rest.find("{", at)) >= 0:
        try:
            value, end = reader.raw_decode(rest, k)
        except ValueError:
            end, value = k + 1, None
        out.append(rest[at : k if is_call(value) else end])
        at = end
    rest = _EMPTY_FENCE.sub("", "".join([*out, rest[at:]]))
    said = lambda line: any(p.fullmatch(line.strip()) for p in (_CALL, _SETTING, _LABEL))
    lines = [line for line in rest.split("\n") if not said(line)]
    found = rest != text or len(lines) < rest.count("\n") + 1
    return ("\n".join(lines).strip(), True) if found else (text, False)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("found", T.BooleanType())]))
def stripped(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in texts:
        yield pd.DataFrame([strip_calls(x) for x in t], columns=["text", "found"])


def mentions_call(text: Column) -> Column:
    """A cheap test that every text with a printed call passes, by which others need not be looked at."""
    return F.coalesce(text, F.lit("")).rlike(r"(?i)<tool_call>|<\|tool_call|\{|\b(?:" + "|".join(TOOLS) + r")\b|functions\.")


# -- files and events -----------------------------------------------------------------------------------------------


def file_changes(tool: Column, args: Column) -> Column:
    """array<struct<path, op, from>> of the files that a call with JSON arguments changes: a written path, the path of a
    replacement, or the headers of a patch (add, update, delete, move)."""
    row = lambda path, op, old=None: F.struct(path.alias("path"), F.lit(op).alias("op"), (F.lit(None).cast("string") if old is None else old).alias("from"))
    path, patch = F.get_json_object(args, "$.path"), F.coalesce(F.get_json_object(args, "$.patch"), F.lit(""))
    none = F.array().cast("array<struct<path: string, op: string, from: string>>")
    heads = lambda word, op: F.transform(F.regexp_extract_all(patch, F.lit(rf"(?m)^\*\*\* {word} File: (.+?)\s*$"), F.lit(1)), lambda p: row(p, op))
    moves = F.transform(F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* Move File: (.+? -> .+?)\s*$"), F.lit(1)), lambda p: row(F.element_at(F.split(p, " -> "), 2), "move", F.element_at(F.split(p, " -> "), 1)))
    patched = F.concat(heads("Add", "add"), heads("Update", "update"), heads("Delete", "delete"), moves)
    single = lambda op: F.when(F.coalesce(path, F.lit("")) != "", F.array(row(path, op))).otherwise(none)
    whole = (F.get_json_object(args, "$.mode") == "patch") | ((patch != "") & path.isNull())
    return F.when(tool == "write_file", single("write")).when((tool == "patch") & whole, patched).when(tool == "patch", single("replace")).otherwise(none)


#: Event types and the fields of their content.
EVENTS = {
    "turn": ("user", "assistant", "recall", "messages"),
    "tool_call": ("tool", "args", "status", "error_type", "error_message", "result_excerpt", "tool_call_id"),
    "file_change": ("path", "op", "tool"),
    "l1_write": ("action", "target", "content", "metadata"),
    "session_end": ("kind", "source", "reason"),
    "compaction": ("message_count",),
    "delegation": ("task", "result", "child_session"),
    "session_switch": ("previous",),
    "subagent_stop": ("child_session", "status"),
}
ACTORS = {"tool_call": "tool", "file_change": "tool", "l1_write": "main_agent", "delegation": "main_agent", "subagent_stop": "subagent", "turn": "user"}


def events(rows: DataFrame, kind: str) -> DataFrame:
    """rows (id, ts, session_id, and fields of a kind's content) as events: id, ts, session_id, actor, event_type, content
    (JSON), source_refs. Fields that rows lack are left out; a delegation's refs name its child session too."""
    fields = [c for c in EVENTS[kind] if c in rows.columns]
    refs = [F.concat(F.lit("session:"), F.col("session_id"))]
    refs += [F.concat(F.lit("session:"), F.col("child_session"))] if "child_session" in fields else []
    refs += [F.concat(F.lit("tool_call:"), F.col("tool_call_id"))] if "tool_call_id" in fields else []
    content = F.to_json(F.struct(*fields)) if fields else F.lit("{}")
    return rows.select("id", "ts", "session_id", F.lit(ACTORS.get(kind, "system")).alias("actor"), F.lit(kind).alias("event_type"), content.alias("content"), F.array_compact(F.array(*refs)).alias("source_refs"))


def compact_messages(messages: Column, most: int) -> Column:
    """array<struct<role, content, tool_calls>> of messages without what a host adds, contents cut to `most` characters."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.substring(F.coalesce(m["content"], F.lit("")), 1, most).alias("content"), m["tool_calls"].alias("tool_calls")))


def call_status(status: Column) -> Column:
    """ok, failed, or null for a blank or unknown status, which is neither."""
    low = F.lower(F.btrim(F.coalesce(status, F.lit(""))))
    return F.when(low.isin("ok", "success", "succeeded", "completed"), "ok").when(low.isin("error", "failed", "failure", "timeout"), "failed")


def program(command: Column) -> Column:
    """The program that a shell command runs, without sudo, settings and its folder."""
    bare = F.regexp_replace(F.btrim(F.coalesce(command, F.lit(""))), r"^(?:(?:sudo|env|\w+=\S+)\s+)*", "")
    return F.regexp_extract(bare, r"^(?:\S*/)?([^\s/;|&]+)", 1)
