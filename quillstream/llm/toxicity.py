"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens don't. On a bounded sample of labelled documents (SAMPLE of each class, near copies
once), words and proper prefixes that are much likelier in toxic documents label the tokens of toxic documents; Spark
counts them. The field is trained on short windows of those tokens: emissions from the word, its prefixes and suffix,
transitions between plain and toxic. Scoring runs forward-backward over whole texts, and a logistic curve fitted on the
sample, in which toxic rows weigh PRIOR of all whatever their number, turns the marginals of a text into its score, so
that THRESHOLD means the same at every size; tokens of a marginal of 0.5 or more are the offending spans.

The driver sees ids, marking features (MARKS at most), WINDOWS windows of LENGTH tokens a document and four figures of
each, never whole texts. Texts of a batch are one chain that starts anew at each text; it is cut into blocks whose 2 x 2
products are formed side by side, so that a long text takes no more steps than many short ones.

Null and empty texts get the score of a text without a toxic token. Labels that are null, or of null ids, are not
learned from; of several labels of an id the largest counts, of several texts the smallest. Without both classes to learn
from, every score is the share of toxic labels. Repeated rows get a row each, an empty table none; other columns are
ignored, and kept by keep_clean.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common

#: Most labelled documents of either class that training looks at, most marking features, windows of a document.
SAMPLE, MARKS, WINDOWS = 1500, 50_000, 4
#: Tokens of a training sequence, and gradient steps.
LENGTH, STEPS = 120, 80
#: Marking features that chance alone is allowed to put among all those tested.
FALSE_MARKS = 1.0
#: Share of toxic documents that scores assume.
PRIOR = 0.1
THRESHOLD = 0.3
REMEMBERED = 200_000
#: Tokens whose products are held at once; a longer chain is taken in so many at a time.
SEGMENT = 1 << 20
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»„…–—¿¡"


#: Lengths of the proper prefixes that are features, and how many features may mark toxic tokens.
PREFIXES = (3, 4, 5, 6, 7, 8)
MARKING = 1 + len(PREFIXES)


def named(token: str) -> list[str]:
    """The word, its proper prefixes, and its suffix; the first MARKING may mark toxic tokens.

    A prefix that is the whole word is no feature of its own: stems that offend only with an ending stay apart."""
    w = token.strip(_STRIP).lower() or token
    return [f"w={w}", *(f"{k}={w[:k]}" if len(w) > k else f"w={w}" for k in PREFIXES), f"s={w[-3:]}"]


def features(token: str) -> list[int]:
    return [zlib.crc32(f.encode()) for f in named(token)]


def tokens(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def _marks(words: list[str]) -> tuple[int, int]:
    """Two smallest shingle hashes, by which near copies are told."""
    grams = {" ".join(words[k : k + 6]).encode() for k in range(max(1, len(words) - 5))}
    return min(zlib.crc32(g, 1) for g in grams), min(zlib.crc32(g, 2) for g in grams)


def marking(counts: DataFrame, n_toxic: int, n_plain: int) -> DataFrame:
    """counts (feature, a, b: toxic and plain documents that have it) as the features that mark toxic tokens: those in
    far more toxic documents than chance would put them in (a Chernoff bound over all features tested), and much
    likelier there than in plain ones."""
    share = n_toxic / (n_toxic + n_plain)
    tested = max(1, counts.where("a > 0 and a + b >= 3").count())
    a, b = F.col("a"), F.col("b")
    r = a / (a + b)
    chance = (a + b) * (r * F.log(r / F.lit(share)) + F.when(b > 0, (1 - r) * F.log((1 - r) / F.lit(1 - share))).otherwise(0.0))
    return counts.where((a >= 3) & (a / n_toxic >= 8 * b / n_plain)).withColumn("chance", chance).where(F.col("chance") > float(np.log(tested / FALSE_MARKS))).select("feature", "chance")


def evidence(p: np.ndarray) -> list[float]:
    """What the curve sees of a text's marginals: one, the largest, their sum, and the length."""
    return [1.0, float(p.max()), float(np.log1p(p.sum())), float(np.log1p(len(p)))] if len(p) else [1.0, 0.0, 0.0, 0.0]


class Field:
    """weights: by named feature; bias, start: of toxic against plain; move: log potentials of (before, after)."""

    def __init__(self, weights: dict[str, float], bias: float, start: float, move: np.ndarray, curve: tuple[float, ...]):
        self.bias, self.start, self.move, self.curve = bias, start, move, curve
        self.tables = []
        for kind in ("w", *map(str, PREFIXES), "s"):
            some = {f.partition("=")[2]: w for f, w in weights.items() if f.startswith(f"{kind}=")}
            self.tables.append((pa.array(some.keys(), pa.string()), np.array([*some.values(), 0.0])))

    def emissions(self, words: list[str] | pa.Array) -> np.ndarray:
        """The sum of the weights of named(word), for many words at once."""
        words = pa.array(words, pa.string())
        bare = pc.utf8_trim(words, characters=_STRIP)
        bare = pc.if_else(pc.equal(bare, ""), words, pc.utf8_lower(bare))
        size = pc.utf8_length(bare).to_numpy()
        weigh = lambda x, table: table[1][pc.fill_null(pc.index_in(x, value_set=table[0]), len(table[0])).to_numpy()]
        whole, *parts, end = self.tables
        out = self.bias + weigh(bare, whole) * (1 + sum((size <= k).astype(float) for k in PREFIXES))
        for k, table in zip(PREFIXES, parts):
            out += np.where(size > k, weigh(pc.utf8_slice_codeunits(bare, 0, k), table), 0.0)
        return out + weigh(pc.utf8_slice_codeunits(bare, -3), end)

    def marginals(self, rows: list) -> list[np.ndarray]:
        """P(toxic) of every token of every row of emissions."""
        sizes = np.array([len(r) for r in rows], np.int64)
        return self._split(np.concatenate([np.zeros(0), *(np.asarray(r, float) for r in rows)]), sizes)

    def of_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """P(toxic) of every token of every text."""
        words, at, sizes = common.words_of(texts)
        return self._split(self.emissions(words)[at], sizes)

    def _split(self, e: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        first, ends = np.zeros(len(e), bool), np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        return np.split(chain(e, first, self.start, self.move), ends[:-1]) if len(sizes) else []

    def score(self, p: np.ndarray) -> float:
        z = float(np.dot(self.curve, evidence(p)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class _Block:
    """A stretch of the chain as rows of steps side by side: c[i, j] are the potentials of going from i to j."""

    def __init__(self, e: np.ndarray, first: np.ndarray, start: float, move: np.ndarray):
        self.n = len(e)
        self.steps = max(1, int(self.n**0.5))
        rows = -(-self.n // self.steps)
        phi, m, s = np.exp(np.clip(e, -30, 30)), np.exp(move), np.exp(np.clip(start, -30, 30))

        def aside(x: np.ndarray, rest: float) -> np.ndarray:
            out = np.full(rows * self.steps, rest)  # steps beyond the end change nothing
            out[: self.n] = x
            return np.ascontiguousarray(out.reshape(rows, -1).T)

        self.c = [[aside(np.where(first, 1.0, m[i, 0]), 1.0 - i), aside(np.where(first, s, m[i, 1]) * phi, float(i))] for i in (0, 1)]
        p = [[np.ones(rows), np.zeros(rows)], [np.zeros(rows), np.ones(rows)]]
        for t in range(self.steps):
            c = [[self.c[i][j][t] for j in (0, 1)] for i in (0, 1)]
            p = [[p[i][0] * c[0][j] + p[i][1] * c[1][j] for j in (0, 1)] for i in (0, 1)]
            whole = p[0][0] + p[0][1] + p[1][0] + p[1][1]
            p = [[x / whole for x in row] for row in p]
        self.whole = np.array(p).transpose(2, 0, 1)  # the product of every row

    def forward(self, f: float) -> tuple[np.ndarray, float]:
        """P(toxic) at every step given all before, from that of the step before the stretch; and that of its last."""
        at = []
        for (a, b), (c, d) in self.whole.tolist():
            at.append(f)
            one, zero = (1 - f) * b + f * d, (1 - f) * a + f * c
            f = one / (one + zero)
        x, out, (c0, c1) = np.array(at), np.empty((self.steps, len(at))), self.c
        for t in range(self.steps):
            one, zero = x * c1[1][t] + (1 - x) * c0[1][t], x * c1[0][t] + (1 - x) * c0[0][t]
            x = out[t] = one / (one + zero)
        return out.T.ravel()[: self.n], f

    def backward(self, q: float) -> tuple[np.ndarray, float]:
        """The weight of toxic at every step given all after, from that of the stretch's end; and that before it."""
        at = []
        for (a, b), (c, d) in self.whole[::-1].tolist():
            at.append(q)
            one, zero = c * (1 - q) + d * q, a * (1 - q) + b * q
            q = one / (one + zero)
        x, out, (c0, c1) = np.array(at[::-1]), np.empty((self.steps, len(at))), self.c
        for t in range(self.steps - 1, -1, -1):
            out[t] = x
            one, zero = c1[0][t] * (1 - x) + c1[1][t] * x, c0[0][t] * (1 - x) + c0[1][t] * x
            x = one / (one + zero)
        return out.T.ravel()[: self.n], q


def chain(e: np.ndarray, first: np.ndarray, start: float, move: np.ndarray) -> np.ndarray:
    """P(toxic) of every token; e: emissions of texts one behind the other, first: whether a text starts there."""
    cuts = range(0, len(e), SEGMENT)
    made = [_Block(e[k : k + SEGMENT], first[k : k + SEGMENT], start, move) for k in cuts] if len(cuts) == 1 else None
    block = lambda k: made[0] if made else _Block(e[k : k + SEGMENT], first[k : k + SEGMENT], start, move)
    p, f, q = np.empty(len(e)), 0.5, 0.5
    for k in cuts:
        p[k : k + SEGMENT], f = block(k).forward(f)
    for k in reversed(cuts):
        g = p[k : k + SEGMENT]
        b, q = block(k).backward(q)
        p[k : k + SEGMENT] = g * b / (g * b + (1 - g) * (1 - b))
    return p


def forward_backward(e: np.ndarray, active: np.ndarray, first: np.ndarray, start: float, move: np.ndarray):
    """e: emissions of toxic against plain, step by step, the longest rows first. Marginals, and those of (before,
    after) pairs summed, and sum of log Z."""
    phi, m = np.exp(np.clip(e, -30, 30)), np.exp(move)
    f, log_z, n = np.empty(len(e)), 0.0, len(active)
    s = np.exp(np.clip(start, -30, 30))
    for k in range(n):
        at, size = first[k], active[k]
        x = phi[at : at + size]
        if k:
            q = f[first[k - 1] : first[k - 1] + size]
            one, zero = (q * m[1, 1] + (1 - q) * m[0, 1]) * x, q * m[1, 0] + (1 - q) * m[0, 0]
        else:
            one, zero = s * x, np.ones(size)
        both = one + zero
        log_z += np.log(both).sum()
        f[at : at + size] = one / both
    p, pairs = f.copy(), np.zeros((2, 2))
    b = np.zeros(0)
    for k in range(n - 1, -1, -1):
        at, size = first[k], active[k]
        q = np.full(size, 0.5)
        if k + 1 < n:
            more = active[k + 1]
            x, g = phi[first[k + 1] : first[k + 1] + more], f[at : at + more]
            one, zero = m[1, 1] * x * b + m[1, 0] * (1 - b), m[0, 1] * x * b + m[0, 0] * (1 - b)
            q[:more] = one / (one + zero)
            z = g * one + (1 - g) * zero
            pairs += np.array([[((1 - g) * m[0, 0] * (1 - b) / z).sum(), ((1 - g) * m[0, 1] * x * b / z).sum()], [(g * m[1, 0] * (1 - b) / z).sum(), (g * m[1, 1] * x * b / z).sum()]])
        b = q
        g = f[at : at + size]
        p[at : at + size] = g * q / (g * q + (1 - g) * (1 - q))
    return p, pairs, log_z


def train(windows: list[tuple[list[str], list[bool]]]) -> Field:
    """A field without a curve, from token sequences and their labels."""
    windows = sorted((w for w in windows if w[0]), key=lambda w: -len(w[0]))
    numbers: dict[str, int] = {}
    rows = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in said), np.int64, len(said)) for said, _ in windows]
    if not rows:
        return Field({}, -4.0, -4.0, np.zeros((2, 2)), (0.0,) * 4)
    names, of = np.unique(np.array([features(w) for w in numbers], np.uint32), return_inverse=True)
    of = of.reshape(len(numbers), -1)
    at, of = np.repeat(np.arange(len(of)), of.shape[1]), of.ravel()
    vocabulary = len(numbers)
    sizes = np.array([len(r) for r in rows])
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    first = np.r_[0, np.cumsum(active)[:-1]]
    place = first[np.concatenate([np.arange(n) for n in sizes])] + np.repeat(np.arange(len(sizes)), sizes)
    word, y = np.empty(len(place), np.int64), np.empty(len(place), bool)
    word[place], y[place] = np.concatenate(rows), np.concatenate([np.asarray(w[1], bool) for w in windows])
    gold = np.zeros((2, 2))
    for k in range(1, len(active)):
        a, b = y[first[k - 1] : first[k - 1] + active[k]], y[first[k] : first[k] + active[k]]
        gold += np.array([[(~a & ~b).sum(), (~a & b).sum()], [(a & ~b).sum(), (a & b).sum()]])
    x = np.r_[np.zeros(len(names)), -4.0, -4.0, np.zeros(4)]  # weights, bias, start, moves
    got = np.bincount(word, y, vocabulary)
    target = np.r_[np.bincount(of, got[at], len(names)), got.sum(), y[: active[0]].sum(), gold.ravel()]
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        scores = np.bincount(at, x[of], vocabulary) + x[-6]
        p, pairs, _ = forward_backward(scores[word], active, first, x[-5], x[-4:].reshape(2, 2))
        each = np.bincount(word, p, vocabulary)
        grad = np.r_[np.bincount(of, each[at], len(names)), each.sum(), p[: active[0]].sum(), pairs.ravel()] - target + 0.02 * x
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        x -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
    kept = np.flatnonzero(np.abs(x[:-6]) > 0.05)
    heavy = dict(zip(names[kept].tolist(), x[kept].tolist()))
    weights = {f: heavy[h] for w in numbers for f, h in zip(named(w), features(w)) if h in heavy}
    return Field(weights, float(x[-6]), float(x[-5]), x[-4:].reshape(2, 2), (0.0,) * 4)


def fit_curve(z: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """The logistic curve over evidence z, by Newton steps; toxic rows weigh PRIOR of all."""
    weight = np.where(toxic, PRIOR / max(1, toxic.sum()), (1 - PRIOR) / max(1, (~toxic).sum())) * len(z)
    curve = np.zeros(z.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        curve -= np.linalg.solve(z.T @ (z * (weight * q * (1 - q))[:, None]) + 0.05 * np.eye(len(curve)), z.T @ (weight * (q - toxic)) + 0.05 * curve)
    return tuple(map(float, curve))


def _near_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.pieces(batches, "text"):
        marks = [_marks(tokens(t)) for t in common.col(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64())], names=["_id", "one", "two"])


def _marking_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.pieces(batches, "text"):
        for kind, text in zip(common.col(b, "_toxic"), common.col(b, "text")):
            found = sorted({f for w in set(tokens(text)) for f in features(w)[:MARKING]})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([kind] * len(found), pa.int32())], names=["feature", "toxic"])


def _windows(held):
    """At most WINDOWS windows of each text, those with marked tokens first, then by a hash; words and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, known = held.value, {}
        for b in common.pieces(batches, "text"):
            for i, kind, text in zip(common.col(b, "_id"), common.col(b, "_toxic"), common.col(b, "text")):
                said = tokens(text)
                hit = []
                for w in said if kind else ():
                    if w not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = any(f in marks for f in features(w)[:MARKING])
                    hit.append(known[w])
                hit = hit or [False] * len(said)
                starts = sorted(range(0, len(said), LENGTH), key=lambda k: (-any(hit[k : k + LENGTH]), zlib.crc32(f"{i}:{k}".encode())))[:WINDOWS]
                if starts:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array([said[k : k + LENGTH] for k in starts], pa.list_(pa.string())), pa.array([hit[k : k + LENGTH] for k in starts], pa.list_(pa.bool_()))], names=["_id", "at", "words", "labels"])

    return run


def _evidence(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches, "text"):
            z = [evidence(p) for p in held.value.of_texts(b.column(b.schema.get_field_index("text")))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.list_(pa.float64()))], names=["_id", "_toxic", "z"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Field | float:
    """Trains on at most SAMPLE labelled documents of each class that are not held out, chosen by a hash of the id."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic")).where(~common.held_out(F.col("_id")))
    totals = {r[0]: r[1] for r in known.groupBy((F.col("_toxic") > 0).cast("int").alias("_toxic")).count().collect()}
    if not totals.get(1) or not totals.get(0):
        return float(bool(totals.get(1)))
    picked = []
    for kind in (1, 0):
        picked += known.where((F.col("_toxic") > 0) == bool(kind)).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_id", F.lit(kind)).collect()
    few = F.broadcast(spark.createDataFrame([tuple(r) for r in picked], "_id long, _toxic int"))  # 2 * SAMPLE rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(few, F.col("doc_id") == F.col("_id"))
    sample = common.materialise(texts.groupBy("_id", "_toxic").agg(F.min("text").alias("text")), "toxic-sample")
    seen: dict[int, set] = {0: set(), 1: set()}
    once = []
    kinds = dict(tuple(r) for r in picked)
    for i, *marks in sorted(map(tuple, common.arrow_map(sample, _near_copies, "_id long, one long, two long").collect())):
        named = set(enumerate(marks))
        if not named & seen[kinds[i]]:
            once.append((i, kinds[i]))
        seen[kinds[i]] |= named
    n_toxic = sum(k for _, k in once)
    n_plain = len(once) - n_toxic
    if not n_toxic or not n_plain:
        return totals[1] / (totals[1] + totals[0])
    sample = sample.join(F.broadcast(spark.createDataFrame(once, "_once long, _kind int")), F.col("_id") == F.col("_once")).select("_id", "_toxic", "text")  # 2 * SAMPLE rows at most
    counts = common.arrow_map(sample, _marking_features, "feature long, toxic int").groupBy("feature").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    counts = common.materialise(counts.where("a > 0"), "toxic-features")
    marks = frozenset(r[0] for r in marking(counts, n_toxic, n_plain).orderBy(F.desc("chance"), "feature").limit(MARKS).select("feature").collect())
    context = spark.sparkContext
    cut = common.arrow_map(sample, _windows(context.broadcast(marks)), "_id long, at long, words array<string>, labels array<boolean>")
    field = train([(r[2], r[3]) for r in sorted(cut.collect(), key=lambda r: (r[0], r[1]))])
    found = sorted(common.arrow_map(sample, _evidence(context.broadcast(field)), "_id long, _toxic int, z array<double>").collect(), key=lambda r: r[0])
    field.curve = fit_curve(np.array([r[2] for r in found]), np.array([r[1] == 1 for r in found]))
    return field


def _scored(field, keep: bool):
    """keep: hand on the batches' own rows of a score below THRESHOLD, else score all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field | float = field.value
        for b in common.pieces(batches, "text", 6 << 20):
            texts = b.column(b.schema.get_field_index("text"))
            if isinstance(model, float):
                p, scores = None, [model] * b.num_rows
            else:
                p = model.of_texts(texts)
                scores = [model.score(x) for x in p]
            if keep:
                yield b.filter(pa.array([s < THRESHOLD for s in scores], pa.bool_()))
                continue
            spans = [offsets(texts[i].as_py(), p[i]) if p is not None and len(p[i]) and p[i].max() >= 0.5 else [] for i in range(b.num_rows)]
            ids = b.column(b.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([common.is_held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "held_out", "score", "predicted", "spans"],
            )

    return run


def offsets(text: str, p: np.ndarray) -> list[dict]:
    """Code points, end exclusive, of the tokens of a marginal of 0.5 or more."""
    return [{"start": m.start(), "end": m.end()} for m, q in zip(re.finditer(common.WORD, text), p) if q >= 0.5]


def score(docs: DataFrame, field: Field | float) -> DataFrame:
    """doc_id, held_out, score, predicted, spans array<struct<start,end>>; a row per row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(field)  # weights of features of the bounded sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.arrow_map(rows, _scored(model, False), "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: long, end: long>>")


def keep_clean(docs: DataFrame, field: Field | float) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns."""
    return common.arrow_map(docs, _scored(docs.sparkSession.sparkContext.broadcast(field), True), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))
