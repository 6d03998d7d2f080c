"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from runframe.llm import queries, resample

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n=2):
    words = WORD.findall((text or "").encode().lower())
    return len(words), [b" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def naive(docs, target, n=2, buckets=10_000, percent=25, min_words=20, seed=7):
    """Sorted (id, n_features, weight, score, rank) of rows (id, text); ids are unique."""
    s, t = [0] * buckets, [0] * buckets
    for table, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for g in features(text, n)[1]:
                table[zlib.crc32(g) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows, able = {}, []
    for i, text in docs:
        words, grams = features(text, n)
        weight = sum(gain[zlib.crc32(g) % buckets] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows[i] = (len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        if words >= min_words:
            able.append(i)
    able.sort(key=lambda i: (-rows[i][2], i is not None, i))
    rank = {i: k + 1 for k, i in enumerate(able[:percent * len(able) // 100])}
    return sorted(((i, *r, rank.get(i)) for i, r in rows.items()), key=repr)


def test_whole_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    target = [t for t, in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    got = queries.QUERIES["op13_resample"](spark, FOLDER)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == naive(docs, target)


@pytest.mark.parametrize("size", [64, 1 << 18])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_stretches_lose_no_run(size, n):
    rng = np.random.default_rng(n)
    texts = [b"", b" ,; ", b"x" * 500, *(" ".join(f"W{x}é" for x in rng.integers(0, 50, k)).encode() for k in (1, 2, 3, 700, 5))]
    found = [Counter() for _ in texts]
    words = [0] * len(texts)
    for grams, parts in resample.stretches(texts, n, size):
        at = 0
        for i, w, f in parts:
            found[i].update(grams[at:at + f])
            words[i] += w
            at += f
        assert at == len(grams)
    want = [features(t.decode(), n) for t in texts]
    assert [(w, c) for w, c in zip(words, found)] == [(w, Counter(f)) for w, f in want]


def test_table_compares_bytes():
    """Grams of one key share a slot only when their bytes are equal."""
    rng = np.random.default_rng(0)
    grams = [b"g%d" % x for x in rng.integers(0, 40, 300)]
    for keys in (None, np.zeros(300, np.uint64), np.array([int(g[1:]) % 3 for g in grams], np.uint64)):
        table = resample.GramTable(grams, 97, keys)
        first = {}
        for g, s in zip(grams, table.slots.tolist()):
            assert first.setdefault(s, g) == g
        assert len(first) == len(set(grams)) == len(table.count)
        assert [table.count[s] for s in first] == [grams.count(g) for g in first.values()]
        assert [table.bucket[s] for s in first] == [zlib.crc32(g) % 97 for g in first.values()]
    assert len(resample.GramTable([], 97).count) == 0


def test_odd_rows_ties_and_empty_tables(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(i, t, "a", "b", 1, 2) for i, t in [(1, None), (2, ""), (3, " ,. "), (4, words), (5, words.upper()), (6, words + " target words here"),
                                                (None, words), (7, "target " * 5000)]]
    schema = "doc_id long, text string, importance string, _place string, _row int, rank int"
    docs = spark.createDataFrame(rows, schema)
    target = spark.createDataFrame([("target words here",), (None,), ("",)], "text string")
    for goal, texts in ((target, ["target words here", None, ""]), (target.limit(0), [])):
        found = resample.importance(docs, goal, out="found")
        flat = found.selectExpr("doc_id", "text", "_place", "_row", "found.n_words", "found.n_features", "found.weight", "found.score")
        drawn = resample.draw(flat, flat["n_words"] >= 20, 60)
        got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in drawn.collect()]
        assert sorted(got, key=repr) == naive([(r[0], r[1]) for r in rows], texts, percent=60)
        kept = resample.resample(docs, goal, percent=60)
        assert kept.columns == docs.columns
        assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(g[0]) for g in got if g[4])
    assert sorted(resample.importance(docs, target).columns) == sorted(docs.columns)
    empty = docs.limit(0)
    assert resample.resample(empty, target).count() == 0
    assert resample.resample_report(empty.select("doc_id", "text"), target).count() == 0


def test_equal_rows_take_consecutive_ranks(spark):
    rows = spark.createDataFrame([(1, 5)] * 40 + [(2, 9)] + [(3, 5)] * 3, "doc_id long, score long").repartition(5)
    got = resample.draw(rows, rows["score"] > 0, 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 23))
    assert [r["rank"] for r in got if r["doc_id"] == 2] == [1] and all(r["rank"] is None for r in got if r["doc_id"] == 3)
