"""The registered queries as they are called, on odd and on empty tables, and what the operators hold to by themselves."""

import base64
import hashlib
import itertools
import os
import random
import re
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillstream.llm import ann, bpe, chat, common, langid, licenses, pii, queries, simhash, toxicity

COLUMNS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def folder(spark, at, rows: dict) -> str:
    for name, ddl in COLUMNS.items():
        spark.createDataFrame(rows.get(name, []), ddl).write.mode("overwrite").parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    docs = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).collect()]
    labels = [(i, k % 2, k % 3 == 0 and 1 or 0) for k, i in enumerate([0, 1, 3, 3, 5, 6, 8, 9, 10])] + [(None, 1, 1), (4, None, None)]
    vectors = [(i, [float(i % 7), 1.0], 0) for i in range(0, 120, 10)] + [(50, [2.0, 2.0], 1), (None, [1.0, 1.0], 0), (7, None, 0), (8, [0.0, 0.0], None), (9, [float("nan"), 1.0], 0), (11, [1.0, 2.0, 3.0], 0)]
    said = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "x</s>"), (None, None, None, "y"), (2, 5, "assistant", "word " * 100_000)]
    return folder(spark, tmp_path_factory.mktemp("odd"), {"documents": docs, "embeddings": vectors, "labels": labels, "conversations": said})


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_on_odd_and_empty_tables(spark, odd, odd_dir, empty_dir, name):
    f = queries.queries()[name]
    got = f(spark, odd_dir).collect()
    want = {"op2_nearest": 3 * 5, "op3_chat_format": 4}.get(name, odd.count())
    assert len(got) == want
    empty = f(spark, empty_dir).collect()
    assert len(empty) == (1 if name == "op3_chat_format" else 0)


def test_pipeline_on_odd_and_empty_tables_leaves_only_its_last_tables(spark, odd_dir, empty_dir):
    first = common.written()
    out = cp.run(spark, odd_dir)
    assert common.written() - first <= 2  # the last stage's input and its words
    rows = out.collect()
    assert rows and all(r.decoded_sha256 for r in rows)
    common.release(first)
    assert common.written() == first
    assert cp.run(spark, empty_dir).count() == 0


# what is shared


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda key, default: default)
    away = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(away)
    here = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="local[4]"))
    assert common.shared_dir(here).startswith("file://")
    named = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default: "s3a://b/tmp/"), sparkContext=away.sparkContext)
    assert common.shared_dir(named) == "s3a://b/tmp"


def test_release_deletes_the_files(spark):
    first = common.written()
    common.materialise(spark.range(3), "gone")
    path = common._tables[-1][1].removeprefix("file:")
    assert os.path.isdir(path)
    common.release(first)
    assert not os.path.exists(path) and common.written() == first


# 2


def test_recall_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()["op2_nearest"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q, near in found.items():
        s = u @ u[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -2
        hit += len(near & set(ids[np.argsort(-s, kind="stable")[:5]].tolist()))
        total += 5
    assert set(found) == {int(i) for i in ids if i % 50 == 0} and hit >= 0.95 * total


def test_shards_stay_few_and_bounded():
    assert [ann.n_shards(n, 64) for n in (0, 10, 10_000, 100_000, 2_000_000, 10_000_000)] == [1, 1, 3, 16, 16, 77]
    assert all(n / ann.n_shards(n, 1024) * 4 * 1024 <= ann.SHARD_BYTES for n in (10**5, 10**7))


# 3


def test_repeated_messages_and_threads_into_cycles(spark):
    ddl = "tree_id long, msg_id long, parent_id long, role string, text string, score double"
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 2, 9, "assistant", "a", 1.0)]
    rows += [(2, 1, 2, "u", "x", 0.0), (2, 2, 1, "u", "y", 0.0), (2, 3, 1, "u", "tail", 0.0)]
    for order in (rows, rows[::-1]):
        got = {r.tree_id: chat.parse(r.formatted) for r in chat.format_trees(spark.createDataFrame(order, ddl)).collect()}
        assert got == {1: [("user", "q"), ("assistant", "a")]}


def test_branches_against_plain_python(spark):
    r = random.Random(4)
    rows, parent = [], {}
    for tree in range(6):
        for m in range(40):
            parent[tree, m] = r.choice([None, *range(m)]) if m else None
            rows.append((tree, m, parent[tree, m], "user", f"{tree}.{m}", float(r.randint(-8, 8))))
    score = {(t, m): s for t, m, _, _, _, s in rows}
    want = {}
    for tree in range(6):
        ways = {}
        for m in set(range(40)) - {p for (t, _), p in parent.items() if t == tree}:
            way = [m]
            while parent[tree, way[-1]] is not None:
                way.append(parent[tree, way[-1]])
            ways[m] = way[::-1]
        order = sorted(ways, key=lambda m: (-sum(score[tree, k] for k in ways[m]) / len(ways[m]), m))
        want |= {(tree, m): (b, [f"{tree}.{k}" for k in ways[m]]) for b, m in enumerate(order[:2], 1)}
    got = chat.format_trees(spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double"), 2).collect()
    assert {(g.tree_id, g.leaf_id): (g.branch, [t for _, t in chat.parse(g.formatted)]) for g in got} == want


# 4


def test_filter_against_exact_ngram_sets(spark, sf):
    """The filter never misses an n-gram that a language has, and its verdicts are those of exact sets."""
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = langid.fit(spark.createDataFrame(docs, "text string, lang string"))
    counts: dict = {}
    for text, lang in docs:
        if lang is not None:
            for h in langid.grams([text])[0].tolist():
                counts.setdefault(lang, {}).setdefault(h, 0)
                counts[lang][h] += 1
    totals = {x: sum(c.values()) for x, c in counts.items()}
    assert model.languages == sorted(totals)
    share = {x: {h: n / totals[x] for h, n in c.items()} for x, c in counts.items()}
    most: dict = {}
    for c in share.values():
        for h, n in c.items():
            most[h] = max(most.get(h, 0), n)
    has = {x: {h for h, n in c.items() if n >= langid.RATIO * most[h]} for x, c in share.items()}
    every = np.array(sorted(most), np.uint64)
    masks = None
    for s in langid.slots_of(every):
        masks = model.table[s] if masks is None else masks & model.table[s]
    for k, lang in enumerate(model.languages):
        bits = (masks[:, k // 8] >> (k % 8)) & 1
        exact = np.array([h in has[lang] for h in every.tolist()])
        assert bits[exact].all() and bits[~exact].mean() < 0.05
    same = total = 0
    for text, _ in docs:
        h = langid.grams([text])[0].tolist()
        n = {x: sum(g in has[x] for g in h) for x in model.languages}
        if h and max(n.values()):
            total += 1
            same += model.predict([text])[0][0] == max(sorted(n), key=n.get)
    assert same >= 0.99 * total


def test_a_language_of_a_single_short_text_is_learned(spark):
    model = langid.fit(spark.createDataFrame([("zyx wvu tsr", "aa"), ("lorem ipsum dolor", "bb"), ("", "cc")], "text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    assert [x[0] for x in model.predict(["zyx wvu", "ipsum dolor"])] == ["aa", "bb"]


@pytest.mark.parametrize("times", [1, 65_000])
def test_rare_ngrams_count_however_large_a_language_is(spark, times):
    """At 65,000 the language has over a million n-grams."""
    docs = [("lorem ipsum dolor " * times, "aa"), ("zyx wvu", "aa"), ("quick brown fox " * (2 * times), "bb")]
    model = langid.fit(spark.createDataFrame(docs, "text string, lang string"))
    assert model.common_one == "bb" and model.predict(["zyx wvu"]) == [("aa", 1.0)]


def test_the_filter_grows_with_the_ngrams(spark):
    """A language with 300,000 different n-grams is still told apart from n-grams that it has not."""
    r = np.random.default_rng(3)
    text, other = ("".join(map(chr, r.integers(0x4E00, 0x9F00, n).tolist())) for n in (300_000, 100_000))
    model = langid.fit(spark.createDataFrame([(text, "zh"), ("lorem ipsum", "la")], "text string, lang string"))
    has, has_not = (langid.grams([x])[0] for x in (text, other))
    zh = model.languages.index("zh")

    def found(h):
        a, b = (model.table[s, 0] >> zh & 1 for s in langid.slots_of(h, len(model.table)))
        return (a & b).mean()

    assert found(has) == 1 and found(has_not) < 0.02 and model.false[zh] < 0.02
    assert [x[0] for x in model.predict([text[5000:5050], "lorem"])] == ["zh", "la"]


# 5


def test_uses_against_a_plain_count(spark):
    r = random.Random(8)
    vocabulary = ["Tel:", "tel", "Call", "call.", "12", "34", "...", "ÄÖ", "x" * 90, "y" * 90 + "!", "a\u00a0b"]
    texts = [" \n".join(r.choices(vocabulary, k=r.randint(0, 30))) for _ in range(200)] + [None, "", "  tel"]
    want: dict = {}
    for t in texts:
        plain = pii.plain([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
        for k, w in enumerate(plain):
            for words in ([w] if w else []) + ([f"{plain[k - 1]} {w}"] if w and k and plain[k - 1] else []):
                want[words] = want.get(words, 0) + 1
    known = sorted(want)
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {x.words: x.uses for x in pii.count_uses(spark.createDataFrame([(w,) for w in known], "words string"), rows).collect()}
    assert {w: got[w] for w in known} == want
    assert pii.plain(["x" * 90]) != pii.plain(["x" * 91]) and len(pii.plain(["x" * 90])[0]) == 65


def test_long_contexts_and_values_are_not_cut():
    text = "Reach " + "w" * 200 + " at " + "1" * 100 + "@a.example"
    got = pii.mentions(text, pii.base_spans(text), [])
    assert [m["pattern"] for m in got] == ["email:at", f"email:{pii.plain(['w' * 200])[0]} at"] and got[0]["value"] != pii.mentions(text.replace("1@", "12@"), pii.base_spans(text.replace("1@", "12@")), [])[0]["value"]


# 6


def test_every_sentence_has_a_word_of_the_gate():
    assert all(re.search(licenses.GATE, s) for s in licenses.SENTENCES.values())


def test_longer_rules_consume_their_sentences(spark):
    k = licenses.SENTENCES
    bsd = ["bsd-redistribute", "bsd-source", "bsd-binary"]
    two = ". ".join(k[x] for x in bsd) + "."
    three = f"{two} Neither the name of Jo Doe, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.".replace("Inc. ", "Inc ")
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may\nnot use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n'
    rows = [(1, two), (2, three), (3, f"{three}\n{two}"), (4, apache), (5, "// SPDX-License-Identifier: GPL-2.0-or-later\ncode"), (6, k["zero-bsd-grant"] + "."), (7, k["isc-grant"] + ".")]
    got = {r.doc_id: r.licences for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "BSD-2-Clause,BSD-3-Clause", 4: "Apache-2.0", 5: "GPL-2.0-or-later", 6: "0BSD", 7: "ISC"}


def test_sentence_on_odd_tables(odd, nothing):
    assert licenses.recognise(nothing).count() == 0
    got = {r.doc_id: (r.n_sentences, r.licences) for r in licenses.recognise(odd).collect() if r.doc_id is not None}
    assert got[0] == got[1] == got[2] == (0, "") and got[10] == (2, "MIT")


# 8


def test_repeated_ids_keep_a_document_of_each_group(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "alpha beta gamma delta epsilon zeta"), (4, "four five"), (4, "four five")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted({t for _, t in rows}) and sorted(r.doc_id for r in got) == [1, 1, 4]


# 9


def merged(word: bytes, ranks: dict) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_encoding_against_a_plain_merge_loop_and_the_join(spark, sf):
    import regex

    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, "naïve ﷺ 你好 don't " + "x" * 300), (-2, None)], "doc_id long, text string"))
    got = bpe.encode(docs, with_ids=True)
    rows = got.collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known: dict = {}
    for r in rows:
        want = []
        for w in regex.findall(pattern, texts[r.doc_id]):
            if w not in known:
                known[w] = merged(w.encode(), ranks)
            want += known[w]
        assert list(r.ids) == want
    back = bpe.decode(got.drop("decoded"), bpe.token_bytes(spark)).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == texts
    assert all(hashlib.sha256(bytes(r.decoded)).hexdigest() == r.decoded_sha256 for r in back)


def test_every_word_is_encoded_once(spark, monkeypatch):
    import tiktoken

    calls = []
    real = tiktoken.Encoding

    class Spy:
        def __init__(self, *a, **k):
            self._core_bpe = types.SimpleNamespace(encode_single_piece=lambda w, f=real(*a, **k)._core_bpe.encode_single_piece: calls.append(w) or f(w))

    monkeypatch.setattr(tiktoken, "Encoding", Spy)
    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = types.SimpleNamespace(value=f.read())
    blobs = [(c, b, bpe.pack_words(w)) for b, c, w in ((0, 1, [b"a", b"bc"]), (0, 2, [b"bc", b"d"]), (1, 1, [b"x"]), (1, 2, [b"x", b"y"]))]
    batch = pa.RecordBatch.from_pylist([{"chunk": c, "bucket": b, "blob": x} for c, b, x in blobs])
    list(bpe._encode(ranks, pattern)(iter([batch])))
    assert sorted(calls) == [b"a", b"bc", b"d", b"x", b"y"]


# 10


def test_chain_against_steps():
    r = np.random.RandomState(1)
    start, move = 0.4, r.normal(size=(2, 2))
    rows = [r.normal(size=n) * 3 for n in (1, 5, 700, 2, 33)]
    field = toxicity.Field({}, 0.0, start, move, (0.0,) * 4)
    for got, e in zip(field.marginals(rows), rows):
        assert np.allclose(got, toxicity.forward_backward(e, np.ones(len(e), int), np.arange(len(e)), start, move)[0])


def test_chain_in_segments(monkeypatch):
    r = np.random.RandomState(2)
    rows = [r.normal(size=n) for n in (40, 3, 90)]
    field = toxicity.Field({}, 0.0, -1.0, r.normal(size=(2, 2)), (0.0,) * 4)
    whole = field.marginals(rows)
    monkeypatch.setattr(toxicity, "SEGMENT", 17)
    assert all(np.allclose(a, b) for a, b in zip(field.marginals(rows), whole))


def test_words_of_a_batch():
    texts = [None, "", " \n", " a b\x0bA  a\x1c\xa0 ", "b", "\ta"]
    words, at, sizes = common.words_of(pa.array(texts))
    said = [words[int(i)].as_py() for i in at]
    want = [toxicity.tokens(t) for t in texts]
    assert said == list(itertools.chain(*want)) and sizes.tolist() == [len(w) for w in want]


def test_emissions_are_sums_of_named_weights():
    r = random.Random(3)
    words = ["".join(r.choice("abÉß.'") for _ in range(r.randint(1, 11))) for _ in range(400)] + ["...", "a", "(x)"]
    weights = {f: r.random() for w in words[::2] for f in toxicity.named(w)}
    field = toxicity.Field(weights, -1.0, 0.0, np.zeros((2, 2)), (0.0,) * 4)
    assert np.allclose(field.emissions(words), [-1.0 + sum(weights.get(f, 0.0) for f in toxicity.named(w)) for w in words])
    assert len(field.emissions([])) == 0


def test_marking_features_are_counted_over_documents(spark):
    counts = spark.createDataFrame([(1, 30, 0), (2, 30, 60), (3, 2, 0), (4, 3, 0), (5, 20, 1)], "feature long, a long, b long")
    assert sorted(r.feature for r in toxicity.marking(counts, 60, 600).collect()) == [1, 4, 5]
