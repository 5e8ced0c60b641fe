"""Quality by weak supervision: rules vote or abstain, expectation-maximisation estimates how right each rule is, and
the posterior probability of good quality decides, in place of a filter that every rule has to pass.

Rules see whole texts. The votes of all rows are counted by pattern in Spark, at most 3 ** len(RULES) patterns; EM runs
on those counts, and the posteriors go back to rows as a table of that bounded size. Rows that fail the base rule are lost already; EM
learns from the rest, so that what it tells apart is not their lack of words.

Null texts have no words and fail the base rule; null ids and repeated rows get a row each.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common

#: Name, SQL condition of a vote for good, SQL condition of a vote for bad; neither: abstain.
RULES = [
    ("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars not between 2 * n_words and 14 * n_words"),
    ("symbols", "50 * n_symbols < n_words", "10 * n_symbols > n_words"),
    ("dup_lines", "n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    ("repeats", "10 * n_repeat_words < n_words", "10 * n_repeat_words > 3 * n_words"),
    ("length", "n_words >= 100", "n_words < 50"),
    ("letters", "20 * n_letters > 17 * word_chars", "10 * n_letters < 7 * word_chars"),
    ("capitals", "10 * n_capitals < n_letters", "10 * n_capitals > 4 * n_letters"),
    ("sentences", "n_ends > 0 and 40 * n_ends >= n_words and 3 * n_ends < n_words", "100 * n_ends < n_words or 2 * n_ends > n_words"),
    ("punctuation", "5 * n_marks < n_words", "10 * n_marks > 3 * n_words"),
    ("bare", "20 * n_bare < n_words", "5 * n_bare > n_words"),
]
ROUNDS, TOLERANCE = 200, 1e-9
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_MARKS = string.punctuation.encode()
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_ends", "n_marks", "n_bare")


def measure(text: str | None) -> tuple[int, ...]:
    """The values of _LONGS."""
    data = (text or "").encode()
    words = data.split()  # bytes split at exactly the six white-space characters
    n = len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(counts.sum() - counts[0x80:0xC0].sum())
    some = lambda which: int(counts[list(which)].sum())
    capitals = int(counts[65:91].sum())
    letters = capitals + int(counts[97:123].sum() + counts[0xC2:].sum())
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = set(windows)
        if len(seen) < len(windows):
            times: dict = {}
            for w in windows:
                times[w] = times.get(w, 0) + 1
            inside = np.zeros(n, bool)
            at = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
            for k in range(3):
                inside[k : k + len(windows)] |= at
            repeats = int(inside.sum())
    bare = sum(not w.strip(_MARKS) for w in words)
    marks = some(_MARKS.replace(b".", b"").replace(b"'", b""))
    return n, chars - some(_SPACE), some(_SYMBOLS), len(lines) - len(set(lines)), repeats, len(lines), letters, capitals, some(b".!?"), marks, bare


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.pieces(batches, "text"):
        values = np.array([measure(t) for t in common.col(b, "text")], np.int64).reshape(-1, len(_LONGS))
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, values.T)], names=["doc_id", *_LONGS])


def measures(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.arrow_map(rows, _measured, "doc_id long, " + ", ".join(f"{c} long" for c in _LONGS))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """votes: a row per pattern, 1 good, -1 bad, 0 abstains. Prior of good, accuracies (2, rules): for good and bad
    rows, and the posterior of good by pattern. A rule seldom blames a good row, but a bad row need not break every rule:
    a rule's accuracy on bad rows starts at a half and may fall to where a vote for bad says nothing."""
    prior, acc = 0.7, np.repeat([[0.95], [0.5]], votes.shape[1], axis=1)
    good, bad, w = votes == 1, votes == -1, counts.astype(float)
    post, before = np.full(len(votes), prior), -np.inf
    for _ in range(ROUNDS):
        one = np.log(prior) + good @ np.log(acc[0]) + bad @ np.log(1 - acc[0])
        two = np.log(1 - prior) + bad @ np.log(acc[1]) + good @ np.log(1 - acc[1])
        both = np.logaddexp(one, two)
        post = np.exp(one - both)
        now = float((w * both).sum() / max(w.sum(), 1))
        if now - before < TOLERANCE:
            break
        before = now
        prior = float(np.clip((w * post).sum() / max(w.sum(), 1), 0.05, 0.95))
        for k, p in enumerate((w * post, w * (1 - post))):
            right = (good if k == 0 else bad).T @ p
            prior_right = (9.5, 5.0)[k]
            acc[k] = np.clip((right + prior_right) / ((good | bad).T @ p + 10), 0.55 if k == 0 else 1 - acc[0], 0.995)
    return prior, acc, post


def label(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, quality double (posterior), kept boolean; a row per row of docs."""
    spark = docs.sparkSession
    pattern = F.expr(" + ".join(f"(case when {bad} then 2 when {good} then 1 else 0 end) * {3**k}" for k, (_, good, bad) in enumerate(RULES))).cast("int")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    rows = common.materialise(measures(docs).withColumn("_votes", pattern).withColumn("base_failed", failed), "quality")
    seen = rows.groupBy("_votes").agg(F.count_if(~F.col("base_failed"))).collect()  # at most 3 ** 10 rows
    if not seen:
        return rows.select("doc_id", *_LONGS, "base_failed", F.lit(0.0).alias("quality"), F.lit(False).alias("kept"))
    codes, counts = np.array([r[0] for r in seen]), np.array([r[1] for r in seen])
    votes = np.array([[(0, 1, -1)[c // 3**k % 3] for k in range(len(RULES))] for c in codes])
    _, _, post = expectation_maximisation(votes, counts)
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], "_pattern int, quality double")
    joined = rows.join(F.broadcast(table), F.col("_votes") == F.col("_pattern"), "left")  # at most 3 ** 10 rows
    return joined.select("doc_id", *_LONGS, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
