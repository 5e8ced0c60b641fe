"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has slots of a bit per language; an n-gram sets its language's bit in HASHES slots, and the AND
of an n-gram's slots gives every language that (perhaps falsely) contains it at one look. A text's languages are counted
over all its n-grams, false positives are taken off by each language's own rate, and the largest count wins. A language
contains an n-gram if its share there is at least RATIO of its largest share in any language, however rare it is and
however many rows there are; languages and shares come from all learning rows, counted in Spark.

Null texts and texts without a letter are `und`; without anything to learn, all are. A text none of whose n-grams is
known gets the language with most n-grams, at score 0. Ties go to the smaller code. Repeated rows get a row each, an
empty table none. A very long text is held whole, with some 40 bytes a character. The filter has SPARSE
slots for each distinct n-gram of the language that has most of them, SLOTS at least, so false positives stay under 2 %
at any size. On the driver and in a broadcast it takes a byte a slot for every eight languages, begun or full: 2 MB up to
131,072 n-grams, from there on 16 bytes for each of them. Over MOST_LANGUAGES languages (1 GB at least) fit() fails.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import common

N, SLOTS, SPARSE, HASHES, RATIO = 4, 1 << 21, 16, 2, 0.4
#: Slots of a page of the filter as executors return it.
PAGE = 1 << 13
#: Languages that a filter may hold.
MOST_LANGUAGES = 4096
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space for all else."""
    if not _letters:
        t = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters.append(t)
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of all texts, words set off by single spaces, and how many each text has."""
    joined = "".join(f"\0{t or ''}" for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = letters()[raw]
    keep = (at != 32) | np.r_[True, at[:-1] != 32] | (np.r_[True, doc[1:] != doc[:-1]])
    at, doc = at[keep].astype(np.uint64), doc[keep]
    if len(at) < N:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h = np.zeros(len(at) - N + 1, np.uint64)
    for k in range(N):
        h = (h ^ at[k : len(at) - N + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = doc[: len(h)] == doc[N - 1 :]
    return h[inside], np.bincount(doc[: len(h)][inside], minlength=len(texts))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.pieces(batches, "text"):
        langs, texts = np.array(common.col(b, "lang"), object), common.col(b, "text")
        for lang in sorted(set(langs)):
            h, _ = grams([texts[i] for i in np.flatnonzero(langs == lang)])
            u, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def slots_of(h: np.ndarray, slots: int = SLOTS) -> list[np.ndarray]:
    return [((h >> np.uint64(24 * k)) % np.uint64(slots)).astype(np.int64) for k in range(HASHES)]


class Filter:
    def __init__(self, languages: list[str], table: np.ndarray, common_one: str):
        self.languages, self.table, self.common_one = languages, table, common_one
        fill = [((table[:, k // 8] >> (k % 8)) & 1).mean() if len(table) else 0.0 for k in range(len(languages))]
        self.false = np.array(fill) ** HASHES

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        h, n = grams(texts)
        has = [bool(t) and any(c.isalpha() for c in t) for t in texts]
        if not self.languages:
            return [("und", 0.0) for _ in texts]
        masks = None
        for s in slots_of(h, len(self.table)):
            masks = self.table[s] if masks is None else masks & self.table[s]
        first = np.r_[0, np.cumsum(n)]
        hits = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            total = np.r_[0, np.cumsum((masks[:, k // 8] >> (k % 8)) & 1, dtype=np.int64)]
            hits[:, k] = total[first[1:]] - total[first[:-1]]
        rate = np.minimum(self.false, 0.99)
        hits = np.maximum(0, (hits - n[:, None] * rate) / (1 - rate))
        out = []
        for ok, row in zip(has, hits):
            if not ok:
                out.append(("und", 0.0))
            elif not row.any():
                out.append((self.common_one, 0.0))
            else:
                k = int(row.argmax())
                out.append((self.languages[k], float(row[k] / row.sum())))
        return out


def fit(docs: DataFrame) -> Filter:
    """Learns from text and lang of every row of docs that has a lang."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    counts = common.materialise(common.arrow_map(rows, _counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    spoken = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()
    seen = counts.groupBy("lang").agg(F.sum("n"), F.count("gram")).limit(MOST_LANGUAGES + 1).collect()
    totals = {r[0]: 0 for r in spoken} | {r[0]: r[1] for r in seen}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(totals, key=lambda x: [ord(c) for c in x])
    width = max(1, (len(names) + 7) // 8)
    slots = max([SLOTS] + [-(-SPARSE * r[2] // PAGE) * PAGE for r in seen])
    if not names:
        return Filter([], np.zeros((0, 1), np.uint8), "und")
    spark = docs.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(x, float(totals[x]), k) for k, x in enumerate(names)], "_lang string, _total double, _bit int"))  # MOST_LANGUAGES rows at most
    share = counts.join(sizes, F.col("lang") == F.col("_lang")).withColumn("share", F.col("n") / F.col("_total"))
    top = share.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= RATIO * F.col("most"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            bit = b.column(1).to_numpy()
            s = np.concatenate(slots_of(h, slots))
            yield pa.RecordBatch.from_arrays([pa.array(s // PAGE), pa.array(np.tile(bit, HASHES)), pa.array((s % PAGE).astype(np.int32))], names=["page", "bit", "slot"])

    marks = common.arrow_map(top.select("gram", "_bit"), placed, "page long, bit int, slot int").distinct()
    pages = marks.groupBy("page").agg(F.collect_list(F.col("slot").cast("long") * MOST_LANGUAGES + F.col("bit")).alias("marks"))  # PAGE * languages at most each
    table = np.zeros((slots, width), np.uint8)
    for page, found in pages.toLocalIterator():
        x = np.array(found, np.int64)
        np.bitwise_or.at(table, (page * PAGE + x // MOST_LANGUAGES, x % MOST_LANGUAGES // 8), (1 << (x % MOST_LANGUAGES % 8)).astype(np.uint8))
    return Filter(names, table, min(names, key=lambda x: (-totals[x], names.index(x))))


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a row per row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a bit per slot and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "text", 4 << 20):
            found = held.value.predict(common.col(b, "text"))
            ids = common.col(b, "doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([common.is_held_out(i) for i in ids]), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~common.held_out(F.col("doc_id")))))
