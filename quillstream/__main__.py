"""Commands: `search` and `read` over a folder of pages, `validate` its front matter, `index` its units and vectors,
`status` of an index against the folder, `replay` of stored events into episodes, and `queries`.

    python -m quillstream search FOLDER "what runs on port 25" --limit 5
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream import catalogue, reader
from quillstream.operators import pages as P
from quillstream.session import get_session
from quillstream.sources import wiki
from quillstream.streaming import episodes


def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a folder as the reader takes them; the title is the first heading, else the id."""
    parsed = wiki.parse(wiki.scan(spark, folder))
    heading = F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1)
    return parsed.select(F.col("id").alias("page"), "path", F.coalesce(F.nullif(heading, F.lit("")), "id").alias("title"), F.array_join("tags", ", ").alias("tags"), "type", "status", "body").where("page is not null")


def show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillstream", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"search": ("folder", "query"), "read": ("folder", "name"), "validate": ("folder",), "index": ("folder", "out"), "status": ("folder", "out"), "replay": ("events", "out"), "queries": ()}.items():
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a)
        if name == "search":
            one.add_argument("--limit", type=int, default=5)
            one.add_argument("--type")
        if name == "read":
            one.add_argument("--section")
    a = p.parse_args(argv)
    if a.command == "queries":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    spark = get_session()
    if a.command == "search":
        asked = spark.createDataFrame([(0, a.query)], "query_id int, query string")
        show(reader.Reader(page_rows(spark, a.folder)).search(asked, a.limit, a.type).orderBy("rank").select("rank", "page", "title", "type", "score", "snippet"))
    elif a.command == "read":
        show(reader.Reader(page_rows(spark, a.folder)).read(spark.createDataFrame([(a.name, a.section)], "name string, section string")))
    elif a.command == "validate":
        bad = wiki.parse(wiki.scan(spark, a.folder)).select("path", wiki.issues().alias("issues")).where("size(issues) > 0")
        show(bad)
        return 1 if bad.count() else 0
    elif a.command == "index":
        units = wiki.units(page_rows(spark, a.folder), "page", "body")
        wiki.sync(spark.createDataFrame([], "text_hash string, vec array<float>"), units).write.mode("overwrite").parquet(a.out)
    elif a.command == "status":
        hashed = lambda df: df.groupBy("page_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("text_hash")), ""), 256).alias("hash"))
        show(P.staleness(hashed(spark.read.parquet(a.out)), hashed(wiki.units(page_rows(spark, a.folder), "page", "body")), "page_id"))
    elif a.command == "replay":
        rows = spark.read.schema("session_id string, id string, event_type string, kind string, ts double").json(a.events)
        episodes.episodes(rows, float("inf"), flush=True).write.mode("overwrite").json(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
