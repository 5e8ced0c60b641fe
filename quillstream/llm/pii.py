"""Personal data by bootstrapped contextual extraction.

Strict patterns find base spans, the seed entities. Looser runs of digits and signs are candidates. Words to the left
of a mention are its lexical patterns; patterns and instances (normalised values) form a graph on which Spark passes
confidence to and fro: a pattern is as good as the share of its uses that are followed by sure instances, an instance
as sure as its patterns make it (noisy or). Candidates of sure patterns become spans of that pattern's kind.

A use is any occurrence of a pattern's words in any text, so that words that stand everywhere prove nothing. Texts are
read twice: for mentions, and to count the uses of the patterns with enough seeds, found by a filter of fixed size. Only
mentions and counts are shuffled. Null texts count as empty; null ids and repeated rows get a
row each. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SURE, SUPPORT, SALTS = 3, 0.5, 3, 16
#: The filter of patterns' words has so many bits, in blocks of Spark's bitmaps; a task holds so many counts.
BITS, BLOCK, MOST = 1 << 25, 1 << 15, 1 << 17
# Possessive forms of the contract's patterns: a run of digits is looked at once, so long runs take linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Candidates: runs of digits, and words around an @ or (at).
_LOOSE = re.compile(r"(?<![0-9])[0-9](?:[ ().:/-]{0,2}[0-9])++")
_LOOSE_EMAIL = re.compile(r"(?<![^\s<(\[])[^\s@<(\[]++(?:@| ?[(\[]at[)\]] ?)[^\s@>)\]]{2,}+")
_WORD_START = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")
_SIGNS = ".,;!?\"'()[]{}<>«»“”"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: leftmost non-overlapping matches of each kind that pass its test."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser spans, clear of the base spans and of each other, with the kind that they resemble."""
    found = []
    if "@" in text or "at)" in text or "at]" in text:
        found += [(m.start(), 0, m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    for m in _LOOSE.finditer(text):
        digits = sum(c in "0123456789" for c in m[0])
        if m[0].count(".") >= 2 and not set(m[0]) & set(" ():/-"):
            found.append((m.start(), 1, m.end()))
        elif 14 <= digits <= 19:
            found.append((m.start(), 2, m.end()))
        elif 7 <= digits <= 13:
            found.append((m.start(), 3, m.end()))
    out: list[tuple[int, int, int]] = []
    ends, starts = [], []  # the base spans, overlapping ones as one
    for a, _, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for a, kind, b in sorted(found):
        k = bisect.bisect_right(ends, a)
        if (k == len(ends) or b <= starts[k]) and (not out or out[-1][2] <= a):
            out.append((a, kind, b))
    return out


def _short(word: str) -> str:
    """A long word as its digest: rows stay small, and different words stay different."""
    return word if len(word) <= 64 else "#" + hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def plain(words: list[str] | pa.Array) -> list[str]:
    """Words as patterns hold them: without the signs about them, lower case, every digit a 0, long ones as digests."""
    bare = pc.utf8_lower(pc.utf8_trim(pa.array(words, pa.string()), characters=_SIGNS))
    return [_short(w) for w in pc.replace_substring_regex(bare, "[0-9]", "0").to_pylist()]


def _plain(word: str) -> str:
    return plain([word])[0]


def _before(text: str, starts: list[int], a: int) -> list[str]:
    """The two words to the left of offset a, which may stand inside the second; starts: where words start."""
    k = bisect.bisect_left(starts, a)
    return [w.decode() for w in text[starts[max(0, k - 2)] : a].encode().split()] if k else []


def mentions(text: str, base: list, loose: list) -> list[dict]:
    """Base spans and candidates, each with a row per pattern: one and two words to its left."""
    if not base and not loose:
        return []
    out, starts = [], [m.start() for m in _WORD_START.finditer(text)]
    for known, spans in ((True, base), (False, loose)):
        for a, kind, b in spans:
            left = plain(_before(text, starts, a))
            value = _short(re.sub(r"\W", "", text[a:b]).lower())
            shapes = [left[-1]] if left and left[-1] else []
            if len(left) == 2 and all(left):
                shapes.append(" ".join(left))
            out += [{"start": a, "kind": kind, "end": b, "base": known, "value": value, "pattern": f"{KINDS[kind]}:{p}"} for p in shapes]
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_MENTION = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string()), ("pattern", pa.string())])
_DDL = "doc_id long, text_hash long, base array<struct<start: long, kind: int, end: long>>, mentions array<struct<start: long, kind: int, end: long, base: boolean, value: string, pattern: string>>, base_sha256 string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.pieces(batches, "text"):
        bases, found, digests = [], [], []
        for text in common.col(b, "text"):
            text = text or ""
            base = base_spans(text)
            bases.append([{"start": x, "kind": k, "end": y} for x, k, y in base])
            found.append(mentions(text, base, candidates(text, base)))
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{x}:{y}" for x, k, y in base).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bases, pa.list_(_SPAN)), pa.array(found, pa.list_(_MENTION)), pa.array(digests)], names=["doc_id", "text_hash", "base", "mentions", "base_sha256"])


def _counted(held):
    """Sums of the occurrences of one and two words that are in the filter, or seem to be, by crc32. The second word of a
    pattern is a pattern too, of the same mentions, so pairs are looked for only where it is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, total = held.value, Counter()
        none = bytes(BLOCK // 8)

        def inside(words: str) -> bool:
            block, bit = divmod(zlib.crc32(words.encode()) % BITS, BLOCK)
            return blocks.get(block, none)[bit >> 3] >> (bit & 7) & 1 == 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["words", "uses"])
            total.clear()
            return out

        for b in common.pieces(batches, "text"):
            raw, at, sizes = common.words_of(b.column(b.schema.get_field_index("text")))
            coded = pa.array(plain(raw), pa.string()).dictionary_encode()
            names = coded.dictionary.to_pylist()
            seq = coded.indices.to_numpy()[at].astype(np.int64)
            held_in = np.array([bool(w) and inside(w) for w in names], bool)
            count = np.bincount(seq, minlength=len(names))
            total.update({names[k]: int(count[k]) for k in np.flatnonzero(held_in & (count > 0))})
            follows = np.ones(len(seq), bool)
            follows[(np.cumsum(sizes) - sizes)[sizes > 0]] = False  # the first word of a text
            k = np.flatnonzero(follows & held_in[seq])
            full = np.array([bool(w) for w in names], bool)
            k = k[full[seq[k - 1]]]
            pairs, n = np.unique(seq[k - 1] * len(names) + seq[k], return_counts=True)
            for pair, times in zip(pairs.tolist(), n.tolist()):
                words = f"{names[pair // len(names)]} {names[pair % len(names)]}"
                if inside(words):
                    total[words] += times
            if len(total) >= MOST:
                yield flush()
        yield flush()

    return run


def count_uses(words: DataFrame, texts: DataFrame) -> DataFrame:
    """words, uses: how often each of `words` occurs in all texts."""
    at = F.crc32(F.col("words").cast("binary")) % BITS
    bits = words.select((at / BLOCK).cast("int").alias("block"), (at % BLOCK).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    held = words.sparkSession.sparkContext.broadcast({r.block: bytes(r.bits) for r in bits.collect()})  # BITS / 8 bytes at most
    found = common.arrow_map(texts.select(F.col("text").cast("string").alias("text")), _counted(held), "words string, uses long")
    return found.groupBy("words").agg(F.sum("uses").alias("uses"))


def sure_patterns(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found (value, pattern, base): the patterns that ROUNDS of scoring leave at SURE or more."""
    edges = common.materialise(found.groupBy("pattern", "value").agg(F.max("base").alias("base"), F.count("*").alias("hits")), "pii-edges")
    seeded = edges.groupBy("pattern").agg(F.sum("hits").alias("all_hits"), F.count_if("base").alias("support")).where(f"support >= {SUPPORT}")
    seeded = common.materialise(seeded.select("pattern", "all_hits", F.substring_index("pattern", ":", 1).alias("kind"), F.expr("substring(pattern, instr(pattern, ':') + 1)").alias("words")), "pii-seeded")
    uses = count_uses(seeded.select("words").distinct(), texts).withColumnRenamed("words", "_words")
    # Words cut short, or with signs before the mention, have fewer whole uses than hits.
    seeded = common.materialise(seeded.join(uses, F.col("words") == F.col("_words"), "left").select("pattern", F.greatest(F.coalesce("uses", F.lit(0)), "all_hits").alias("uses")), "pii-uses")
    sure = F.when(F.col("base"), 1.0).otherwise(F.coalesce(F.col("conf"), F.lit(0.0)))
    now = edges.withColumn("conf", F.lit(0.0))
    for k in range(ROUNDS):
        known = now.groupBy("pattern").agg(F.sum(sure * F.col("hits")).alias("known")).withColumnRenamed("pattern", "_pattern")
        patterns = seeded.join(known, F.col("pattern") == F.col("_pattern")).select("pattern", (F.col("known") / (F.col("uses") + 1)).alias("score"))
        patterns = common.materialise(patterns, "pii-patterns")
        if k + 1 < ROUNDS:
            scored = common.salted_left_join(edges, patterns, "pattern", SALTS, F.col("value"))
            instances = scored.where("not base").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999)))))).alias("conf"))
            now = common.materialise(edges.join(instances.withColumnRenamed("value", "_value"), F.col("value") == F.col("_value"), "left").drop("_value"), "pii-edges")
    return patterns.where(F.col("score") >= SURE).select("pattern", "score")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and added arrays of (start, kind, end), base_sha256; a row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    scanned = common.arrow_map(rows, _scan, _DDL).withColumn("row", F.monotonically_increasing_id())
    scanned = common.materialise(scanned, "pii")
    each = scanned.where(F.size("mentions") > 0).select("row", F.inline("mentions"))
    sure = sure_patterns(each.select("value", "pattern", "base"), rows)
    hits = common.salted_left_join(each.where("not base").select("row", "start", "kind", "end", "pattern"), sure, "pattern", SALTS, F.col("row")).where("score is not null")
    added = hits.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added")).withColumnRenamed("row", "_row")  # spans of one text
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    return scanned.join(added, F.col("row") == F.col("_row"), "left").select("doc_id", "text_hash", "base", F.coalesce("added", none).alias("added"), "base_sha256")


def spans_text(base: str, added: str):
    """All spans as kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    every = F.array_sort(F.concat(base, added))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return find(docs).select("doc_id", *(n(k) for k in range(4)), "base_sha256", spans_text("base", "added").alias("spans"))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, spans = common.col(b, "text"), common.col(b, "_spans")
        out = [mask(t, s) if s else t for t, s in zip(texts, spans)]
        at = b.schema.get_field_index("text")
        b = b.set_column(at, b.schema.field(at), pa.array(out, b.column(at).type))
        if "n_chars" in b.schema.names:
            k = b.schema.get_field_index("n_chars")
            b = b.set_column(k, b.schema.field(k), pa.array([len(t) if s else n for t, s, n in zip(out, spans, b.column(k).to_pylist())], b.column(k).type))
        yield b.select([n for n in b.schema.names if n != "_spans"])


def mask(text: str, spans: list[dict]) -> str:
    """Every span, overlapping ones as one, becomes the name of its first kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"], s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text (n_chars follows, where there is one)."""
    found = find(docs).where(F.size("base") + F.size("added") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.concat("base", "added").alias("_spans")).dropDuplicates(["_id", "_hash"])
    rows = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash")), "left").select(*docs.columns, "_spans")
    return common.arrow_map(rows, _masked, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))
