"""Uses of a pattern count once each, over all texts."""

from collections import Counter

import pytest

from quillstream.llm import pii


def added(spark, rows):
    return {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_context_that_stands_often_in_each_text_is_sure(spark):
    line = "host {}.{}.30.40 is up; "
    rows = [(i, "".join(line.format(10 + i, 3 * i + k) for k in range(3))) for i in range(6)]
    assert added(spark, rows + [(99, "host 300.40.500.60 is up")])[99] == "ip:5:18"


@pytest.mark.parametrize("n,want", [(2, "ip:5:18"), (40, "")])
def test_bare_uses_in_texts_without_mentions_count(spark, n, want):
    rows = [(i, f"host {10 + i}.{i}.30.40") for i in range(6)] + [(99, "host 300.40.500.60")]
    assert added(spark, rows + [(100 + i, "the host is up, said Host.") for i in range(n // 2)])[99] == want


@pytest.mark.parametrize("bits,most", [(pii.BITS, pii.MOST), (pii.BLOCK, 2)])
def test_uses_against_plain_counts(spark, monkeypatch, bits, most):
    """Also with a filter that is too small, and with counts passed on at once."""
    monkeypatch.setattr(pii, "BITS", bits)
    texts = [None, "", "A b, a B! c (a) . b", "b  a\nb", " x a b " * 50]
    plain = [[pii._plain(w) for w in (t or "").split()] for t in texts]
    want = Counter(w for p in plain for w in p) + Counter(f"{a} {b}" for p in plain for a, b in zip(p, p[1:]))
    asked = ["a", "b", "a b", "b a", "zz", "zz b"]
    words = spark.createDataFrame([(w,) for w in asked], "words string")
    got = {r.words: r.uses for r in pii.count_uses(words, spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert {w: got.get(w, 0) for w in asked} == {w: want[w] for w in asked}
