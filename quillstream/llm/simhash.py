"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit i of a fingerprint has a vector m(i) of R + 1 bits, and every non-zero vector v of R + 1 bits a table, whose
mask holds the bits i with m(i) . v odd. R differing bits span at most R dimensions, so some v is orthogonal to all of
them: that table's mask leaves all differing bits out, and the pair meets there. No pair within the radius is missed.

Only distinct fingerprints are compared, so exact copies cost one row. In a bucket, a search over its fingerprints
gives a spanning forest of the links, not all pairs; a bucket of more than MOST fingerprints is dealt anew by a further
set of masks, over and over, which keeps the guarantee and ends, as every level fixes more bits. Components come from
alternating large-star and small-star rounds, each cut off by a written table.

Null and empty texts have fingerprint zero and link like any other; null ids get a row, but never name a component
(a component of null ids alone has a null component_id); repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import common

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of a bucket that one task compares; larger buckets are dealt anew.
MOST = 4096
SALTS = 8


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
        starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * counts > len(hashes)].sum())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.pieces(batches, "text"):
        fps = np.array([fingerprint(t) for t in common.col(b, "text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id long, text_hash long, fp long: the 64 bits as a signed number."""
    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text")), _fingerprints, "doc_id long, text_hash long, fp long")


def masks(level: int, radius: int = RADIUS) -> list[int]:
    """The masks of a covering code, as signed numbers; another assignment of vectors to bits at each level."""
    n = (1 << (radius + 1)) - 1
    bits = np.random.RandomState(level).permutation(64)
    vector = {int(b): 1 + k % n for k, b in enumerate(bits)}
    found = [sum(1 << i for i in range(64) if bin(vector[i] & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def _forest(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within the radius that join all that are linked: one fewer than each linked set has members."""
    left = x
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            a = todo.pop()
            near = np.bitwise_count(left ^ a) <= RADIUS
            if near.any():
                hit = left[near]
                yield np.full(len(hit), a), hit
                todo += list(hit)
                left = left[~near]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) come sorted. Out: links (a, b), or with over true rows (mask a, fp b) of too large buckets."""

    def out(a, b, over=False):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), over))], names=["a", "b", "over"])

    carry = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    large = None  # the bucket whose rows are handed on

    def runs(mask, key, fp) -> Iterator[pa.RecordBatch]:
        if len(fp) < 2:
            return
        start = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[start, len(fp)])
        run, small = np.repeat(np.arange(len(start)), sizes), sizes <= 16
        keep = small[run] & (sizes[run] > 1)
        r, x = run[keep], fp[keep]
        for s in range(1, 16):
            i = np.flatnonzero(r[s:] == r[:-s]) if len(r) > s else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[np.bitwise_count(x[i] ^ x[i + s]) <= RADIUS]
            if len(i):
                yield out(x[i], x[i + s])
        for k in np.flatnonzero(~small):
            for a, b in _forest(fp[start[k] : start[k] + sizes[k]]):
                yield out(a, b)

    for batch in batches:
        mask, key, fp = (np.concatenate([c, batch.column(i).to_numpy(zero_copy_only=False).view(c.dtype)]) for i, c in enumerate(carry))
        if not len(fp):
            continue
        last = int(np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])[-1])
        if large is not None:
            n = int(np.argmin(np.r_[(mask == large[0]) & (key == large[1]), False]))
            if n:
                yield out(mask[:n], fp[:n], True)
            if n == len(fp):
                continue
            mask, key, fp, last, large = mask[n:], key[n:], fp[n:], last - n, None
        yield from runs(mask[:last], key[:last], fp[:last])
        carry = [mask[last:], key[last:], fp[last:]]
        if len(carry[2]) > MOST:
            large = (carry[0][0], carry[1][0])
            yield out(carry[0], carry[2], True)
            carry = [c[:0] for c in carry]
    yield from runs(*carry)


def links(fps: DataFrame, most: int | None = None) -> DataFrame:
    """Links a, b between distinct fingerprints fp that join all within the radius, found by all masks."""
    spark, level = fps.sparkSession, 0
    todo = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    found = None
    while True:
        more = F.array(*[F.lit(m).cast("long") for m in masks(level)])
        rows = todo.select(F.explode(F.transform(more, lambda m: m.bitwiseOR(F.col("mask")))).alias("mask"), "fp").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        made = common.materialise(common.arrow_map(rows.repartition(F.col("mask"), F.col("key")).sortWithinPartitions("mask", "key", "fp"), _links, "a long, b long, over boolean"), "simhash")
        part = made.where("not over").select("a", "b")
        found = part if found is None else found.unionByName(part)
        todo = made.where("over").select(F.col("a").alias("mask"), F.col("b").alias("fp")).distinct()
        if todo.isEmpty():
            return found
        level += 1


def components(edges: DataFrame) -> DataFrame:
    """node long, root long: the smallest number of its component, for every node of the edges (a, b)."""
    pair = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = common.materialise(pair(edges), "edges")
    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = common.materialise(pair(common.salted_left_join(both, least, "a", SALTS, F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = common.salted_left_join(large, least, "a", SALTS, F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = common.materialise(pair(small), "edges")
        if (then := state(now)) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = then


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root (a number of the component's own), component_id; a row per row of docs."""
    fps = common.materialise(fingerprints(docs), "fingerprints")
    each = common.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(each.select("fp")))
    of = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of = common.materialise(of, "roots")
    names = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.salted_left_join(of, names, "root", SALTS, F.col("fp")).select("fp", "root", "component_id")
    return common.salted_left_join(fps, named, "fp", SALTS, F.col("doc_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), a row per row."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of its smallest doc_id, of a repeated id that of the smallest text hash.

    Rows without a doc_id can't be told apart and are kept. Rows of one id and text are one document; which of them
    stays is settled by their other columns."""
    least = F.min(F.struct("doc_id", "text_hash")).alias("kept")
    same = grouped(docs).where("doc_id is not null").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    keep = same.groupBy("root").agg(least, F.min_by("n", F.struct("doc_id", "text_hash")).alias("n")).select(F.col("kept.doc_id").alias("_keep"), F.col("kept.text_hash").alias("_hash"), F.col("n").alias("_n"))
    keep = common.materialise(keep, "kept")
    match = (F.col("doc_id").cast("long") == F.col("_keep")) & (text_hash() == F.col("_hash"))
    rows = docs.join(keep.where("_n = 1"), match, "left_semi")
    twice = keep.where("_n > 1")
    if not twice.isEmpty():
        nth = F.row_number().over(Window.partitionBy("_keep", "_hash").orderBy(F.xxhash64(*[F.col(c) for c in docs.columns])))
        rows = rows.unionByName(docs.join(twice, match).withColumn("_nth", nth).where("_nth = 1").select(*docs.columns))
    return rows.unionByName(docs.where("doc_id is null"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
