"""The ten operators against brute force, SQL and round trips, and on odd and empty tables."""

import hashlib
import re
from collections import Counter

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import ann, bpe, chat, common, langid, licenses, mixing, pii, quality, queries, simhash, toxicity


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    assert compare.differences(spark, sf, queries.queries()[name], queries.oracle_sql()[name]) == []


# 1


def test_mix_meets_targets_and_caps(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(nothing).count() == 0
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) < 1 for (_, target), t in by.items())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))


def test_water_filling_against_a_plain_loop(spark):
    words = {"a": 10, "b": 400, "c": 1000, "d": 0, "e": 30, None: 7}
    df = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(words.items())], "doc_id long, source string, text string")
    got = {r["size"]: r.target for r in mixing.mix(df).collect()}
    weight = dict(zip(sorted(words, key=lambda s: (s is None, s or "")), [5, 2, 1] * 2))
    total, fixed = sum(words.values()), {}
    while True:
        lam = (total - sum(fixed.values())) / sum(w for s, w in weight.items() if s not in fixed)
        more = {s: 3 * words[s] for s in words if s not in fixed and lam * weight[s] > 3 * words[s]}
        if not more:
            break
        fixed |= more
    assert got == pytest.approx({words[s]: fixed.get(s, lam * weight[s]) for s in words})


def test_remix_takes_whole_documents_and_keeps_columns(odd):
    out, taken = mixing.remix(odd), mixing.mix(odd)
    assert out.columns == odd.columns
    want = Counter()
    for r in taken.collect():
        if r.taken:
            want[(r.doc_id, r["size"])] += (2 * r.taken + r["size"]) // (2 * r["size"])
    n = lambda t: len((t or "").encode().split())
    got = out.collect()
    assert Counter((r.doc_id, n(r.text)) for r in got) == +want
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    assert {(r.doc_id, r.text) for r in got} <= texts


# 2


def brute(ids, x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in {int(i) for i in ids if i % 50 == 0}:
        s = u @ u[list(ids).index(q)]
        out[q] = sorted((-round(s[j], 12), int(ids[j])) for j in range(len(ids)) if ids[j] != q)[:k]
    return out


def test_nearest_recall_and_scores(spark):
    r = np.random.RandomState(0)
    x = r.normal(size=(900, 32))
    x[300:500] = x[300] + r.normal(size=(200, 32)) * 0.05  # near copies
    x[500:700] = x[500]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    rows = ann.usable(df, "v")
    got = ann.search(ann.build_index(rows, 256), rows.where("vec_id % 50 = 0")).collect()
    want = brute(np.arange(900), x)
    assert Counter(g.query_id for g in got) == {q: 5 for q in want}
    hits = sum((g.vec_id in {i for _, i in want[g.query_id]}) for g in got)
    assert hits >= 0.95 * len(got)
    same = sorted((g.rank, g.vec_id) for g in got if g.query_id == 650)
    assert same == [(k + 1, 500 + k) for k in range(5)]


def test_nearest_on_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (None, [1.0, 2.0]), (100, [1.0, 2.0, 3.0])]
    use = ann.usable(spark.createDataFrame(rows, "vec_id long, v array<double>"), "v")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(ann.build_index(use), use.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 5), (0, 2, 50), (50, 1, 0), (50, 2, 5)]
    empty = use.where("false")
    assert ann.search(ann.build_index(empty), empty).count() == 0


# 3


def test_template_reads_back():
    for t in ("", "\\", "</s>[INST] ok [/INST]", "\\<|turn|>\\\\<|over|>x<<SYS>>", "<\\|turn|>", "<<s>>[[INST]"):
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
        text, spans = chat.render([(t, "x"), ("assistant", t)])
        assert chat.parse(text) == [(t, "x"), ("assistant", t)] and chat.unescape(text[slice(*spans[-1])]) == t


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 1.0), (1, 4, 3, "user", None, None), (2, 5, 99, None, None, None), (3, 6, 7, "a", "x", 0.0), (3, 7, 6, "b", "y", 0.0), (None, 1, None, "user", "n", 0.0)]
    rows += [(9, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)]
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {r.tree_id: chat.parse(r.formatted) for r in chat.format_trees(df).collect()}
    assert got == {1: [("user", "q"), ("assistant", "good"), ("user", "")], 2: [("", "")], None: [("user", "n")], 9: [("user", str(i)) for i in range(37)]}
    assert chat.format_trees(df, None).count() == 5 and chat.format_trees(df.where("false")).count() == 0


# 4


def test_languages(spark, docs, odd, nothing):
    model = langid.fit(docs.where(~common.held_out(F.col("doc_id"))))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert langid.predict(odd, model).count() == odd.count()
    assert model.predict([None, "", "12 !?"]) == [("und", 0.0)] * 3
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(nothing)).collect()} == {"und"}


def test_ngrams_do_not_cross_texts():
    h, n = langid.grams(["abcd", "", None, "ab", "xyz abcd"])
    whole, m = langid.grams(["abcd"])
    assert n.sum() == len(h) and n[0] == m[0] and (h[: n[0]] == whole).all() and n.tolist() == [2, 0, 0, 0, 6]


# 5

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_plain_patterns(texts):
    hard = ["a@b.c@d.e.f", "@@x@y.z", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "+1 (555) 010-9999...", "+12345", "4111 1111 1111 1111 1", "4111-1111-1111-1111", "..@a.b-.c", "a@b.c.", "+1 +1 555 010 9999 "]
    for t in hard + [t or "" for _, t in texts]:
        assert pii.base_spans(t) == plain_spans(t), t[:80]


def test_context_finds_what_the_patterns_miss(spark):
    rows = [(i, f"Report {i}. Reach staff under {1 + i}.{20 + i}.30.40 today, the rest is prose.") for i in range(12)]
    rows += [(99, "Notice. Reach staff under 300.40.500.60 today."), (100, "We sold 300.40.500.61 of them."), (None, None)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99].spans == "ip:26:39" and got[99].n_ip == 0 and got[100].spans == "" and got[None].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(got[i].n_ip == 1 for i in range(12))


def test_masking(odd, nothing):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text like '%mail me at [EMAIL] or [PHONE].%'").count() == 1
    assert pii.digest(nothing).count() == 0 and pii.redact(nothing).count() == 0


# 6


def test_rules_need_their_sentences_in_order(spark, odd):
    s = licenses.SENTENCES
    rows = [(1, f"{s['gpl-free']}.\n{s['gpl-hope']}."), (2, f"{s['gpl-hope']}.\n{s['gpl-free']}."), (3, "Some prose. Licensed under CC BY-NC 4.0. RELEASED UNDER THE MIT LICENSE!"), (4, None), (5, f"{s['mit-grant']}: x.\n{s['mit-keep']}.")]
    got = {r.doc_id: (r.n_known, r.licences) for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, "GPL-3.0-or-later"), 2: (2, ""), 3: (2, "CC-BY-NC-4.0,MIT"), 4: (0, ""), 5: (1, "")}
    assert licenses.recognise(odd).count() == odd.count()


# 7


def test_measures_against_plain_python(texts):
    for _, t in texts + [(0, None), (0, "a b a b a b a"), (0, " x\n x\n\n\nx")]:
        words = re.findall(common.WORD, t or "")
        at = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i in range(len(words) - 2) for k in range(3) if at[tuple(words[i : i + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if re.search(common.WORD, x)]
        assert quality.measure(t)[:5] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside))


def test_em_learns_which_rules_are_right():
    r = np.random.RandomState(1)
    truth = r.rand(4000) < 0.7
    acc = np.array([0.95, 0.9, 0.85, 0.8, 0.6])
    right = r.rand(4000, 5) < acc
    votes = np.where(right == truth[:, None], 1, -1) * (r.rand(4000, 5) < 0.8)
    pats, inv, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, got, post = quality.expectation_maximisation(pats, n)
    assert abs(prior - 0.7) < 0.1 and abs(got.mean(0) - acc).max() < 0.12
    assert ((post[inv.ravel()] >= 0.5) == truth).mean() > 0.85


def test_quality_on_odd_rows(odd, nothing):
    rows = quality.label(odd).collect()
    assert len(rows) == odd.count() and not any(r.kept and r.base_failed for r in rows) and quality.label(nothing).count() == 0


# 8


def plain_components(fps):
    x, to = np.array(fps, np.uint64), list(range(len(fps)))

    def find(a):
        while to[a] != a:
            a = to[a]
        return a

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 4) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            to[b] = a
    return [find(i) for i in range(len(x))]


def test_masks_cover_every_pair_within_the_radius():
    r = np.random.RandomState(3)
    for level in (0, 1, 2):
        masks = [m % (1 << 64) for m in simhash.masks(level)]
        for _ in range(2000):
            diff = sum(1 << int(b) for b in r.choice(64, simhash.RADIUS, replace=False))
            assert any(m & diff == 0 for m in masks)


def test_near_duplicates_against_brute_force(docs):
    rows = sorted(simhash.near_duplicates(docs).collect(), key=lambda r: r.doc_id)
    groups = plain_components([int(r.fingerprint, 16) for r in rows])
    least = {}
    for r, g in zip(rows, groups):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert [r.component_id for r in rows] == [least[g] for g in groups]


def test_large_buckets_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 8)
    r = np.random.RandomState(0)
    base = int(r.randint(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in r.choice(62, int(r.randint(0, 9)), replace=False)) for _ in range(200)})
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    groups = plain_components(fps)
    sizes = Counter(groups)
    assert {r.node: r.root for r in found} == {f: fps[g] for f, g in zip(fps, groups) if sizes[g] > 1}


def test_fingerprint_by_hand():
    import xxhash

    t = "Aa bb CC dd ee\tff Éé"
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(common.WORD, t)]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("Aa bb") == xxhash.xxh64_intdigest(b"aa bb", 42) and simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def test_one_of_each_group_stays(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {0}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({r.component_id for r in rows if r.doc_id is not None}) and simhash.near_duplicates(nothing).count() == 0


# 9


def test_tokens_are_those_of_the_library(spark, odd, texts, nothing):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=bpe.ranks_of(open(path, "rb").read()), special_tokens={})
    more = ["a\x1cb \x1f\x85 c", "é é ﷺ", "  \n\n  x", "<|endoftext|> it's I'LL we'd", "　 x", "١٢٣ ½ 12"]
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)] + texts, "doc_id long, text string"))
    got = sorted((r.decoded, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, with_ids=True).collect())
    want = []
    for r in df.collect():
        t = r.text or ""
        ids = enc.encode_ordinary(t)
        want.append((t, tuple(ids), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want) and bpe.encode(nothing).count() == 0


def test_packing():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1], np.uint32)
    assert (bpe.unpack_ints(bpe.pack_ints(x)) == x).all() and len(bpe.unpack_ints(bpe.pack_ints(x[:0]))) == 0
    assert bpe.unpack_words(bpe.pack_words([b"", b"ab", b"c"])) == [b"", b"ab", b"c"]


# 10


def test_forward_backward_against_all_labellings():
    import itertools

    r = np.random.RandomState(5)
    e, start, move = r.normal(size=6), 0.3, r.normal(size=(2, 2))
    weight = {y: np.exp(sum(e[i] for i in range(6) if y[i]) + start * y[0] + sum(move[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=6)}
    z = sum(weight.values())
    want = [sum(w for y, w in weight.items() if y[i]) / z for i in range(6)]
    p, pairs, log_z = toxicity.forward_backward(e, np.ones(6, int), np.arange(6), start, move)
    assert np.allclose(p, want) and np.isclose(log_z, np.log(z))
    assert np.allclose(pairs, [[sum(w * sum((a, b) == (i, j) for a, b in zip(y, y[1:])) for y, w in weight.items()) / z for j in (0, 1)] for i in (0, 1)])


def test_toxicity(spark, odd, nothing):
    r = np.random.RandomState(2)
    plain = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        words = list(r.choice(plain, 60))
        if i % 4 == 0:
            words[int(r.randint(60))] = ("foul", "vile", "nastyish", "nastyest")[int(r.randint(4))]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    field = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {x.doc_id: x for x in toxicity.score(df, field).collect()}
    assert sum(got[i].predicted == y for i, _, y in rows if got[i].held_out) >= 0.97 * sum(x.held_out for x in got.values())
    bad = next(t for i, t, y in rows if y and "nastyest" in t)
    p = field.marginals([field.emissions(toxicity.tokens(bad))])[0]
    assert [bad[s["start"] : s["end"]] for s in toxicity.offsets(bad, p)] == ["nastyest"]
    assert toxicity.score(odd, field).count() == odd.count() and toxicity.keep_clean(odd, field).columns == odd.columns
    assert {x.score for x in toxicity.score(odd, toxicity.fit(df, nothing.select("doc_id", F.lit(1).alias("toxic")))).collect()} == {0.0}


def test_marginals_of_rows_of_all_lengths():
    f = toxicity.Field({}, -1.0, 0.5, np.array([[0.2, -0.3], [0.1, 0.4]]), (0.0,) * 4)
    rows = [[0.1, 2.0, -1.0], [], [0.5], [1.0, -2.0, 0.3, 0.4], [0.5]]
    alone = [f.marginals([r])[0] for r in rows]
    assert all(np.allclose(a, b) for a, b in zip(f.marginals(rows), alone))
