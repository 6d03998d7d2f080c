"""Ranked search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from runframe.llm import ranking

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def naive(docs, items, k):
    """Sorted (item_id, rank, doc_id, score) of rows (id, text)."""
    held = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, i is not None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, slice string, term int, score long"),
            spark.createDataFrame([(i, t, "x", 3) for i, t in items], "item_id long, text string, row string, bundle int"))


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("k,owners,bundle,slice_docs,block", [(5, 4, 256, 8192, 1 << 18), (5, 3, 2, 16, 40), (1, 5, 3, 40, 1 << 18), (300, 2, 1, 7, 9)])
def test_equals_brute_force(spark, k, owners, bundle, slice_docs, block):
    rng = np.random.default_rng(k)
    draw = lambda n: " ".join(f"T{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 60))
    docs = [(int(i), draw(rng.integers(0, 60))) for i in rng.permutation(240)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties
    items = [(i, draw(rng.integers(1, 12))) for i in range(9)]
    got = ranking.search(*tables(spark, docs, items), k=k, owners=owners, bundle=bundle, slice_docs=slice_docs, block=block)
    assert rows(got) == naive(docs, items, k)


def test_pruning_drops_accumulators_and_no_result():
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 1000, (3, 500))
    keep = ranking.kept(scores, np.array([0, 50, 10_000]), 10)
    for row, k, rest in zip(scores, keep, (0, 50, 10_000)):
        least = sorted(row)[-10]
        assert (k == ((row > 0) & (row + rest >= least))).all() and k.sum() >= 10
    assert keep[0].sum() < 15 and keep[2].sum() == (scores[2] > 0).sum()


def test_odd_rows_and_empty_tables(spark):
    docs = [(1, None), (2, ""), (3, " .,"), (4, "a b a"), (5, "a b a"), (5, "a b a"), (None, "a b a"), (6, "A_Bé c3 " * 5000), (7, "x\x00y z")]
    items = [(1, "a B"), (1, "a B"), (1, "c3"), (2, None), (3, ""), (4, "nowhere"), (None, "é bé Z y"), (5, "A A a")]
    d, i = tables(spark, docs, items)
    for k in (3, 50):
        got = ranking.search(d, i, k=k)
        assert rows(got) == naive(docs, items, k)
        assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.where("doc_id < 4"), i)):
        got = ranking.search(a, b)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
    with pytest.raises(ValueError):
        ranking.search(d, i, slice_docs=1 << 17)
