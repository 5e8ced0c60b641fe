"""Markdown pages: reading folders, front matter, sections, units for embedding, and keeping an index of vectors."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, types
from pyspark.sql import functions as F

from quillstream import session

REQUIRED = ("id", "type", "status", "created", "updated", "confidence")
STATUSES = ("active", "superseded", "archived", "draft")
CONFIDENCES = ("high", "medium", "low")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, raw of every *.md below a folder; a page is one row."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def head(raw: Column, key: str) -> Column:
    """A scalar of the front matter, without quotes; null where it isn't there."""
    block = F.regexp_extract(raw, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    value = F.regexp_extract(block, rf"(?m)^{re.escape(key)}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
    return F.when(value != "", value)


def items(raw: Column, key: str) -> Column:
    """A list of the front matter, in its [a, b] form or as lines of `- a`."""
    block = F.regexp_extract(raw, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.regexp_extract(F.concat(block, F.lit("\n")), rf"(?m)^{re.escape(key)}:[ \t]*\r?\n((?:[ \t]*- .*\r?\n)+)", 1)
    listed = F.filter(F.transform(F.split(lines, r"\r?\n"), lambda s: F.btrim(F.regexp_replace(s, r"^[ \t]*- ", ""), F.lit(" \"'"))), lambda s: s != "")
    return F.when(lines != "", listed).otherwise(_inline(raw, key))


def _inline(raw: Column, key: str) -> Column:
    return F.filter(F.transform(F.split(F.regexp_extract(F.coalesce(head(raw, key), F.lit("")), r"^\[(.*)\]$", 1), ","), lambda s: F.btrim(s, F.lit(" \"'"))), lambda s: s != "")


def parse(pages: DataFrame) -> DataFrame:
    raw = F.col("raw")
    meta = [head(raw, k).alias(k) for k in (*REQUIRED, "subject")] + [items(raw, k).alias(k) for k in ("sources", "related", "tags")]
    return pages.select("path", *meta, F.regexp_replace(raw, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("body"))


def serialize(page: dict[str, Column], body: Column) -> Column:
    """Front matter in fixed order (REQUIRED, subject, then lists inline) and the body; null scalars are left out."""
    scalar = [F.concat(F.lit(f"{k}: "), page[k].cast("string")) for k in (*REQUIRED, "subject") if k in page]
    lists = [F.concat(F.lit(f"{k}: ["), F.array_join(page[k], ", "), F.lit("]")) for k in ("sources", "related", "tags") if k in page]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*scalar, *lists)), "\n"), F.lit("\n---\n"), F.coalesce(body, F.lit("")))


def issues() -> Column:
    """What is wrong with a parsed page, an array of texts."""
    day = lambda c: F.try_to_date(F.col(c), "yyyy-MM-dd")
    lacks = [F.when(F.col(k).isNull(), f"{k} is missing") for k in REQUIRED]
    more = [
        F.when(~F.col("id").rlike(r"^[a-z0-9][a-z0-9-]*$"), "id is malformed"),
        F.when(~F.col("status").isin(*STATUSES), "status is unknown"),
        F.when(~F.col("confidence").isin(*CONFIDENCES), "confidence is unknown"),
        F.when(F.col("created").isNotNull() & day("created").isNull(), "created is no date"),
        F.when(day("updated") < day("created"), "updated before created"),
    ]
    return F.array_compact(F.array(*lacks, *more))


def sections(text: str | None) -> list[tuple[int, str, str]]:
    """(level, heading, own text) in order; headings inside fences are text."""
    out, fence = [[0, "", []]], False
    for line in (text or "").split("\n"):
        fence ^= line.lstrip().startswith("```")
        m = None if fence else re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        if m:
            out.append([len(m[1]), m[2], []])
        else:
            out[-1][2].append(line)
    return [(level, h, "\n".join(lines).strip()) for level, h, lines in out if h or "".join(lines).strip()]


def anchor(heading: str) -> str:
    plain = unicodedata.normalize("NFKD", heading.lower().replace("ß", "ss")).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


def section(text: str | None, name: str) -> str:
    """The text of a section, by heading or anchor (a repeated one by its number: a, a-1), with the sections below it; all
    for no name, and nothing for an unknown one."""
    if not name:
        return text or ""
    seen: dict[str, int] = {}
    out: list[str] = []
    inside = 0
    for level, heading, own in sections(text):
        if inside and level <= inside:
            break
        slug = anchor(heading)
        seen[slug] = seen.get(slug, -1) + 1
        tag = slug if not seen[slug] else f"{slug}-{seen[slug]}"
        if not inside and level and (name == tag or name.strip().lower() == heading.lower()):
            inside = level
        if inside:
            out += [f"{'#' * level} {heading}", *([own] if own else [])]
    return "\n\n".join(out)


@F.pandas_udf(types.StringType())
def section_of(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for body, name in rows:
        yield pd.Series([section(b, n) for b, n in zip(body, name)], dtype=object)


def live_body(body: Column) -> Column:
    """A body without superseded bullets, lines of provenance and struck text."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: ~x.rlike(r"^\s*[-*+]\s+~~") & ~x.rlike(r"^\s*_Provenance:"))
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), r"~~[^~\n]*~~", ""), F.lit("\n "))


def bullets(pages: DataFrame, key: str, body: str) -> DataFrame:
    """key, line, text, label, live: the claims of pages, a row per bullet; struck ones are not live. The label is the
    evidence in the last bracket, without what follows a semicolon."""
    lines = pages.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n")).alias("line", "_l"))
    item = lines.select(key, "line", F.regexp_extract("_l", r"^\s*[-*+]\s+(.+?)\s*$", 1).alias("_l")).where("_l <> ''")
    struck = F.col("_l").startswith("~~")
    mark = r"\s*\((observed|inferred|reported|mixed)(?:;[^)]*)?\)\s*$"
    plain = F.regexp_replace(F.regexp_replace("_l", mark, ""), "^~~|~~$", "")
    label = F.regexp_extract("_l", mark, 1)
    return item.select(key, "line", plain.alias("text"), F.when(label != "", label).alias("label"), (~struck).alias("live"))


def sentence_windows(pages: DataFrame, key: str, body: str, size: int = 3) -> DataFrame:
    """key, ord, text: every run of up to `size` sentences of a page that follow each other, by its first."""
    each = pages.select(key, F.posexplode(sentences_of(F.coalesce(body, F.lit("")))).alias("ord", "_s"))
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(0, size - 1)
    return each.select(key, "ord", F.array_join(F.collect_list("_s").over(w), " ").alias("text"))


def md_sentences(text: str | None) -> list[str]:
    """Sentences of Markdown: headings, table rows, list items and blank lines end a paragraph; other lines are joined, and
    a sentence ends at . ! ? before white space and a capital, a digit or a quote."""
    blocks: list[list[str]] = [[]]
    for line in (text or "").split("\n"):
        bare = line.strip()
        if not bare:
            blocks.append([])
        elif re.match(r"#{1,6}\s|\|", bare):
            blocks += [[bare.lstrip("#").strip(" |")], []]
        elif m := re.match(r"(?:[-*+]|\d+[.)])\s+(.*)", bare):
            blocks.append([m[1]])
        else:
            blocks[-1].append(bare)
    return [s for b in blocks if b for s in re.split(r"(?<=[.!?])\s+(?=[A-ZÄÖÜ0-9\"'“„(])", " ".join(b)) if s]


@F.pandas_udf(types.ArrayType(types.StringType()))
def sentences_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(md_sentences)


def update_index(index: DataFrame, fresh: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """An index table with the rows of pages in fresh replaced and those of pages in gone removed; the rest is kept."""
    touched = fresh.select(key).unionByName(gone.select(key)).distinct()
    return index.join(touched, key, "left_anti").unionByName(fresh)


def chunks(text: str, most: int = 700) -> list[str]:
    """Paragraphs packed up to `most` characters; a longer one is cut at words."""
    out = [""]
    for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        while len(p) > most:
            cut = p.rfind(" ", 1, most)
            cut = cut if cut > 0 else most
            out += [p[:cut], ""]
            p = p[cut:].strip()
        if len(out[-1]) + len(p) + 2 > most:
            out.append("")
        out[-1] += ("\n\n" if out[-1] else "") + p
    return [c for c in out if c]


_UNITS = pa.schema([("page_id", pa.string()), ("ord", pa.int32()), ("heading", pa.string()), ("text", pa.string()), ("text_hash", pa.string())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for page, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parts = [(h, c) for _, h, text in sections(body) for c in chunks(text)]
            rows += [(page, k, h, c, hashlib.sha256(f"{h}\n{c}".encode()).hexdigest()) for k, (h, c) in enumerate(parts)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _UNITS.types)], schema=_UNITS)


def units(pages: DataFrame, key: str, body: str) -> DataFrame:
    """page_id, ord, heading, text, text_hash: what is embedded."""
    session.ship(pages.sparkSession)
    return pages.select(F.col(key).cast("string"), F.col(body)).mapInArrow(_units, "page_id string, ord int, heading string, text string, text_hash string")


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A deterministic stand-in for a model: a normalised bag of hashed words."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for w in re.findall(r"\w+", t.lower()):
            v[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % dim] += 1.0
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / norm for x in v])
    return out


def sync(index: DataFrame, fresh: DataFrame, embed: Callable[[list[str]], list[list[float]]] = hashed_embedding, batch: int = 64, stored_model: dict | None = None, model: dict | None = None) -> DataFrame:
    """units with vec: stored vectors are used again by text_hash, only unseen texts are embedded, missing units go. Where
    the index was made by another model (name, revision, length), all are embedded anew."""
    if stored_model != model:
        index = index.where("false")
    stored = index.select("text_hash", "vec").dropDuplicates(["text_hash"])
    new = fresh.select("text_hash", "heading", "text").dropDuplicates(["text_hash"]).join(stored, "text_hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                texts = [f"{h}\n{t}" for h, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(embed(texts), pa.list_(pa.float32()))], names=["text_hash", "vec"])

    session.ship(index.sparkSession)
    return fresh.join(stored.unionByName(new.mapInArrow(run, "text_hash string, vec array<float>")), "text_hash")
