"""Chunks, vectors and retrieval against plain Python."""

import hashlib
import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import runframe as rf
from runframe.operators import text as text_ops


def python_chunks(text, size=500, step=400):
    out, at = [], 0
    while text:
        out.append(text[at:at + size])
        if at + size >= len(text):
            break
        at += step
    return out


def python_vector(text, dim=128):
    vec = [0] * dim
    for token in [t for t in re.split(r"\s+", text.lower()) if t]:
        h = hashlib.sha256(token.encode()).digest()
        vec[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] & 1 else -1
    return vec


def test_chunks_match_slicing(spark):
    texts = ["", "a", "x" * 499, "x" * 500, "x" * 501, "ab\U0001F600" * 300, "x" * 900, "x" * 901, "é" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in rf.chunk(df).collect():
        got.setdefault(r.doc_id, {})[r.chunk_no] = r.text
    for i, t in enumerate(texts):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == python_chunks(t)


def test_vectors(spark):
    texts = ["the cat The  dog\tcat", "", "   ", "É é e\x1cf", "one two three four five one"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    for r in rf.to_dense(rf.embed(df)).collect():
        expected = python_vector(texts[int(r.chunk_id)])
        assert list(r.vec) == expected
        assert r.n2 == sum(x * x for x in expected)


def corpus(spark):
    words = ["red", "green", "blue", "cat", "dog", "sun", "moon"]
    texts = [" ".join(words[(i * k) % 7] for k in range(1, 6)) for i in range(60)] + ["", "cat cat cat"]
    chunks = rf.embed(spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string"))
    chunks = chunks.selectExpr("*", "cast(substr(chunk_id, 2) AS long) AS pos")
    ask = ["cat dog", "sun", "", "purple"]
    queries = rf.embed(spark.createDataFrame(list(enumerate(ask)), "query_id long, text string"), "query_id")
    return texts, chunks, ask, queries


def expected_hits(texts, ask, k=5):
    out = {}
    for q, question in enumerate(ask):
        a = np.array(python_vector(question), float)
        scores = []
        for pos, t in enumerate(texts):
            b = np.array(python_vector(t), float)
            size = math.sqrt((a @ a) * (b @ b))
            scores.append((-(a @ b / size if size else 0.0), pos))
        out[q] = [pos for _, pos in sorted(scores)[:k]]
    return out


def hits(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append(r.pos)
    return out


def test_retrieval_small_blocked_and_dense(spark, monkeypatch):
    texts, chunks, ask, queries = corpus(spark)
    expected = expected_hits(texts, ask)
    assert hits(rf.retrieve(queries, chunks)) == expected
    assert hits(rf.retrieve(queries, chunks.repartition(6))) == expected
    dense = [rf.to_dense(df).drop("idx", "cnt") for df in (queries, chunks)]
    assert hits(rf.retrieve(*dense)) == expected
    monkeypatch.setattr(text_ops, "QUERY_BLOCK", 2)
    monkeypatch.setattr(text_ops, "CHUNK_BLOCK", 13)
    assert hits(rf.retrieve(queries, chunks)) == expected


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(1, 6))
def test_best_keeps_order_and_ties(scores, k):
    values = np.array(scores, float)
    pos = np.arange(len(values))[::-1].copy()
    got = text_ops._best(values, pos, k)
    assert list(pos[got]) == [p for _, p in sorted(zip(-values, pos))[:k]]


def test_bucket_segments(spark):
    df = spark.range(500).selectExpr("concat('c', id) AS chunk_id", "id AS pos")
    rows = rf.bucket_index(df, segment=100).collect()
    assert sorted(p for r in rows for p in r.positions) == list(range(500))
    for r in rows:
        assert all(p // 100 == r.segment and int(hashlib.md5(f"c{p}".encode()).hexdigest()[:2], 16) == r.bucket for p in r.positions)


def test_block_manifest(spark):
    blobs = [("a", b""), ("b", b"x" * 64), ("c", bytes(range(256)) * 3)]
    got = {}
    for r in rf.block_manifest(spark.createDataFrame(blobs, "path string, content binary"), block=64).collect():
        got.setdefault(r.path, {})[r.block] = r.sha256
    for name, content in blobs:
        expected = {n: hashlib.sha256(content[n * 64:n * 64 + 64]).hexdigest() for n in range(-(-len(content) // 64))}
        assert got.get(name, {}) == expected
