"""The pipeline's stages against brute force on what each was given."""

from collections import Counter

import corpus_pipeline as cp
import pytest

from quillstream.llm import common, mixing, pii, simhash, toxicity


@pytest.fixture(scope="session")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        made = common.materialise(stage(spark, docs, sf), "test")
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_the_columns_of_documents(steps):
    assert len(steps) == 5
    for _, docs, made in steps[:-1]:
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go_and_all_others_stay(spark, sf, steps):
    _, docs, made = steps[0]
    field = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(docs, field).collect() if r.predicted == 0}
    assert {r.doc_id for r in made.collect()} == want


def test_one_of_each_group_stays(steps):
    _, docs, made = steps[1]
    assert sorted(r.doc_id for r in made.collect()) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})


def test_masks(steps):
    _, docs, made = steps[2]
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in made.collect():
        if not pii.candidates(before[r.doc_id], pii.base_spans(before[r.doc_id])):
            spans = [{"start": a, "kind": k, "end": b} for a, k, b in pii.base_spans(before[r.doc_id])]
            assert r.text == pii.mask(before[r.doc_id], spans)


def test_mix(steps):
    """Whole documents, as often as the mix takes them, half a document or more as one."""
    _, docs, made = steps[3]
    want = Counter()
    for r in mixing.mix(docs).collect():
        if r.taken:
            want[r.doc_id] += (2 * r.taken + r["size"]) // (2 * r["size"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = made.collect()
    assert Counter(r.doc_id for r in got) == +want
    assert all(texts[r.doc_id] == r.text for r in got)


def test_tokens(spark, sf, steps):
    import hashlib

    _, docs, made = steps[4]
    assert sorted(r.decoded_sha256 for r in made.collect()) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    assert cp.run(spark, sf).count() == made.count()
