"""Byte-level BPE by a global distinct-word shuffle.

Pre-tokens are combined within chunks of a partition first, as a map-side combine does: a chunk keeps its distinct words
once, and each text as positions in that list. Only the distinct words travel, packed by a hash of the word. A task gets
all that chunks hold of a hash bucket, so it encodes every distinct word of the corpus exactly once; ids come back by
chunk, and texts are put together by position. Decoding joins the table of token bytes, which is fixed and so broadcast,
in the task that has the ids; decode() is the same join over exploded ids. No text is shuffled, and a word that is in
every text is sent once a chunk.

The numbers of buckets and partitions follow the bytes of text. A bucket's words have to fit a task's memory: they are
the distinct words of a corpus of `chunks` chunks (about chunks ** GROWTH times those of one) over that many buckets.

Null texts count as empty, an empty text has no tokens, an empty table gives no rows; repeated rows and null ids give a
row each; a text longer than a chunk is a chunk of its own. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common

#: Characters of text in a chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 16 << 20
#: Buckets for a corpus of one chunk, and the power of the number of chunks by which distinct words grow (Heaps' law).
BUCKETS, GROWTH = 8, 0.6
CODEC, LEVEL = "zstd", 12


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file, and the pattern of its pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec(CODEC, compression_level=LEVEL).compress(data, asbytes=True)


def _unpack(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=n, codec=CODEC, asbytes=True)


#: Numbers that are packed or unpacked at once; bounds what that needs besides the result.
BLOCK = 1 << 19


def _sevens(x: np.ndarray) -> bytes:
    size = np.ones(len(x), np.uint8)
    for k in range(1, 5):
        size += x >= np.uint64(1 << 7 * k)
    at = np.cumsum(size, dtype=np.int64) - size
    out = np.zeros(int(size.sum(dtype=np.int64)), np.uint8)
    for k in range(5):
        some = size > k
        if some.any():
            out[at[some] + k] = ((x[some] >> np.uint32(7 * k)) & np.uint32(127)) | ((size[some] > k + 1) * np.uint32(128))
    return out.tobytes()


def pack_ints(x: np.ndarray, names: np.ndarray | None = None) -> bytes:
    """Unsigned integers (names[x], if given), seven bits a byte, the last byte of each below 128: small ones are short."""
    parts = [x[k : k + BLOCK] for k in range(0, len(x), BLOCK)]
    return _pack(b"".join(_sevens((p if names is None else names[p]).astype(np.uint32)) for p in parts))


def unpack_ints(blob: bytes) -> np.ndarray:
    data, out, start = np.frombuffer(_unpack(blob), np.uint8), [], 0
    while start < len(data):
        end = min(start + BLOCK, len(data))
        while data[end - 1] >= 128:
            end += 1
        part = data[start:end]
        last = np.flatnonzero(part < 128)
        first = np.r_[0, last[:-1] + 1]
        x = np.zeros(len(last), np.uint32)
        for k in range(5):
            some = last - first >= k
            if not some.any():
                break
            x[some] |= (part[first[some] + k].astype(np.uint32) & np.uint32(127)) << np.uint32(7 * k)
        out.append(x)
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pack_words(words: list[bytes]) -> bytes:
    return _pack(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    data = _unpack(blob)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4)) + 4 + 4 * n
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


_ROWS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("blob", pa.binary()), ("places", pa.binary())])
_DDL = "chunk long, bucket int, doc_ids array<long>, lengths array<int>, blob binary, places binary"


def _chunks(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash

        find, part, made = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        known: dict[str, int] = {}
        ids: list = []
        lengths: list[int] = []
        seqs: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal known, ids, lengths, seqs, size, made
            if not ids:
                return
            chunk, made = (part << 32) | made, made + 1
            seq = np.concatenate(seqs)
            seqs = []
            count = np.bincount(seq, minlength=len(known)).tolist()
            listed = [w.encode() for w in known]
            known = {}
            of = [xxhash.xxh32_intdigest(w) % buckets for w in listed]
            # frequent words get small numbers; those of a single use are 0, and listed in the order of their uses
            often = sorted((i for i, n in enumerate(count) if n > 1), key=lambda i: (-count[i], of[i], listed[i]))
            rank = np.zeros(len(listed), np.uint32)
            rank[often] = np.arange(1, len(often) + 1)
            positions = pack_ints(seq, rank)
            del seq
            n_often = len(often)
            often += [i for i, n in enumerate(count) if n == 1]
            words = [listed[i] for i in often]
            at = np.array([of[i] for i in often], np.uint32)
            del listed, of, count, often
            out = [(chunk, -1, ids, lengths, positions, pack_ints(np.r_[np.uint32(n_often), at]))]
            order = np.argsort(at, kind="stable")
            bounds = np.searchsorted(at[order], np.arange(buckets + 1))
            for b in range(buckets):
                if bounds[b] < bounds[b + 1]:
                    out.append((chunk, b, None, None, pack_words([words[i] for i in order[bounds[b] : bounds[b + 1]]]), None))
            known, ids, lengths, seqs, size = {}, [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _ROWS.types)], schema=_ROWS)

        for b in common.pieces(batches, "text"):
            for doc_id, text in zip(common.col(b, "doc_id"), common.col(b, "text")):
                text = text or ""
                if size + len(text) > CHUNK_CHARS and ids:
                    yield from flush()
                tokens = find(text)
                add = known.setdefault
                seqs.append(np.fromiter((add(w, len(known)) for w in tokens), "<u4", len(tokens)))
                ids.append(doc_id)
                lengths.append(len(tokens))
                size += len(text)
        yield from flush()

    return run


def _encode(ranks_file, pattern: str):
    """Rows come by bucket; its distinct words are encoded once, whatever chunks they are from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(ranks_file.value), special_tokens={})._core_bpe.encode_single_piece
        at, coded = None, {}
        for b in batches:
            rows = []
            for chunk, bucket, blob in zip(common.col(b, "chunk"), common.col(b, "bucket"), common.col(b, "blob")):
                if bucket != at:
                    at, coded = bucket, {}
                ids: list[int] = []
                counts: list[int] = []
                for w in unpack_words(blob):
                    x = coded.get(w)
                    if x is None:
                        x = coded[w] = encode(w)
                    ids += x
                    counts.append(len(x))
                rows.append((chunk, bucket, None, None, pack_ints(np.array(ids, "<u4")), pack_ints(np.array(counts, "<u4"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ROWS.types)], schema=_ROWS)

    return run


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _assemble(ranks_file, with_ids: bool):
    """Rows come by chunk; the ids of its words first, by bucket, then its texts (bucket -1 is sorted last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {i: p for p, i in ranks_of(ranks_file.value).items()}
        table = [pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)]
        chunk, coded = None, {}
        for b in batches:
            for r in range(b.num_rows):
                at, bucket = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                if at != chunk:
                    chunk, coded = at, {}
                blob, places = b.column(4)[r].as_py(), b.column(5)[r].as_py()
                if bucket >= 0:
                    coded[bucket] = (unpack_ints(blob), unpack_ints(places))
                    continue
                of = unpack_ints(places)
                n_often, of = int(of[0]), of[1:]
                flat = np.concatenate([coded[k][0] for k in sorted(coded)]) if coded else np.zeros(0, "<u4")
                counts = np.concatenate([coded[k][1] for k in sorted(coded)]).astype(np.int64) if coded else np.zeros(0, np.int64)
                rank = np.empty(len(of), np.int64)
                rank[np.argsort(of, kind="stable")] = np.arange(len(of))
                n, first = counts[rank], (np.cumsum(counts) - counts)[rank]
                seq, start, out = unpack_ints(blob), 0, []
                once = seq == 0
                seq -= np.uint32(1)
                seq[once] = np.arange(n_often, len(of), dtype=np.uint32)
                del once
                for doc_id, length in zip(b.column(2)[r].as_py(), b.column(3)[r].as_py()):
                    s = seq[start : start + length]
                    start += length
                    k = n[s]
                    ids = flat[np.repeat(first[s] - np.cumsum(k) + k, k) + np.arange(k.sum())].astype("<u4")
                    row = [doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest()]
                    decoded = b"".join([table[i] for i in ids.tolist()])
                    row.append(hashlib.sha256(decoded).hexdigest())
                    out.append([*row, ids.tolist(), decoded.decode("utf-8", "replace")] if with_ids else row)
                    if len(out) >= 2000 or with_ids and len(out) >= 100:
                        yield from _emit(out, with_ids)
                        out = []
                if out:
                    yield from _emit(out, with_ids)
                coded = {}

    return run


def _emit(out: list, with_ids: bool) -> Iterator[pa.RecordBatch]:
    cols = list(zip(*out))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + ([pa.list_(pa.int32()), pa.string()] if with_ids else [])
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=names)


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per row of docs (doc_id, text): n_tokens and digests of the ids and of the decoded bytes.

    with_ids: also ids array<int> and the decoded text. vocabulary: a rank file, which the driver reads."""
    spark = docs.sparkSession
    path, default_pattern = default_vocabulary() if vocabulary is None or pattern is None else (vocabulary, pattern)
    path, pattern = vocabulary or path, pattern or default_pattern
    with open(path, "rb") as f:
        ranks_file = spark.sparkContext.broadcast(f.read())  # a fixed vocabulary, under 1 MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = max(1.0, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / CHUNK_CHARS)
    buckets = math.ceil(BUCKETS * chunks**GROWTH)
    made = common.materialise(common.arrow_map(rows, _chunks(pattern, buckets), _DDL), "bpe")
    words = made.where("bucket >= 0").select("chunk", "bucket", "blob").repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    coded = common.arrow_map(words, _encode(ranks_file, pattern), _DDL)
    parts = max(math.ceil(2 * chunks), int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = coded.unionByName(made.where("bucket < 0")).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("bucket") < 0, "bucket")
    return common.arrow_map(both, _assemble(ranks_file, with_ids), _OUT + (", ids array<int>, decoded string" if with_ids else ""))


def token_bytes(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """id int, piece binary: a row per token of the rank file."""
    with open(vocabulary or default_vocabulary()[0], "rb") as f:
        return spark.createDataFrame([(i, bytearray(p)) for p, i in ranks_of(f.read()).items()], "id int, piece binary")


def decode(encoded: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds decoded binary to rows with ids array<int>: exploded ids join the token bytes, which go back by position.

    Ids that are not in the table give no bytes; null ids give empty bytes. Repeated rows get their own."""
    rows = common.materialise(encoded.withColumn("_row", F.monotonically_increasing_id()), "encoded")
    each = rows.select("_row", F.posexplode("ids").alias("_at", "_id")).join(F.broadcast(tokens), F.col("_id") == F.col("id"))  # a fixed vocabulary
    said = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", F.hex("piece").alias("_hex")))).alias("_said"))  # the tokens of one text
    said = said.select(F.col("_row").alias("_of"), F.unhex(F.array_join("_said._hex", "")).alias("decoded"))
    return rows.drop("decoded").join(said, F.col("_row") == F.col("_of"), "left").select(*[c for c in encoded.columns if c != "decoded"], F.coalesce("decoded", F.lit(bytearray())).alias("decoded"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))
