"""Text operators against brute force, with nulls, empty tables, repeated rows and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runframe.llm import (
    brown, common, decontaminate, licenses, line_dedup, multi_index, ngram_join, queries, sampling, suffixes, tokenfile, toxicity)

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, contamination string, score string, lines string, _key string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty, blank and repeated texts, repeated rows, a long text, and clashing column names."""
    long = " ".join(f"word{i} thing" for i in range(4000))
    texts = [None, "", "   ", "short", "the same text here twice over again\nsecond line of some length",
             "the same text here twice over again\nsecond line of some length", "the same text here twice over agaim\nother", long,
             long + " end", "né \U0001F600 ≠\n\nAll rights reserved."]
    rows = [(i, t, "x", "y", "z", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", "x", "y", "z", "k"), (None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(name="documents"):
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = [c for c in (want.columns[0], "rank") if c in want.columns]
    for c in want.columns:
        assert got.sort_values(key)[c].tolist() == want.sort_values(key)[c].tolist(), c


# decontamination

def test_contamination_joined_equals_broadcast(spark, odd):
    items = spark.createDataFrame([(1, "word5 thing word6"), (1, "word5 thing word6"), (2, "short"), (3, ""), (4, None), (None, "second line of")],
                                  "item_id long, text string")
    one = decontaminate.find_contamination(odd, items, out="found").select("doc_id", "text", "found").collect()
    two = decontaminate.find_contamination(odd, items, out="found", broadcast_chars=0).select("doc_id", "text", "found").collect()
    order = lambda r: repr(r)
    assert sorted(one, key=order) == sorted(two, key=order)
    hit = {r["doc_id"]: r["found"] for r in one if r["doc_id"] is not None}
    assert hit[3]["items"] == ["2"] and hit[3]["n_hit"] == 1 and hit[7]["items"] == ["1"] and hit[4]["n_hit"] == 3 and hit[4]["items"] == []
    kept = decontaminate.decontaminate(odd, items, remove="spans")
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert kept.where("doc_id = 3").first()["text"] == ""
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == odd.count()


def test_windows_cover_short_items(spark):
    docs = spark.createDataFrame([(1, "A b, c d e"), (2, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "a B c"), ("q", "zz")], "item_id string, text string")
    c = decontaminate.find_contamination(docs, items, n=2).orderBy("doc_id").collect()
    assert [(r["contamination"]["n_hit"], r["contamination"]["items"]) for r in c] == [(3, ["p"]), (2, ["p"])]


# n-gram join

def naive_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,percent,k,starts", [(3, 90, 10, 2), (1, 60, 2, 1), (2, 75, 1, 3)])
def test_jaccard_components(spark, n, percent, k, starts):
    rng = np.random.default_rng(n)
    base = [[f"w{x}" for x in rng.integers(0, 30, rng.integers(1, 40))] for _ in range(40)]
    rows = []
    for i in range(160):
        words = list(base[rng.integers(0, 40)])
        for _ in range(rng.integers(0, 3)):
            words[rng.integers(0, len(words))] = f"w{rng.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    rows += [(160, None), (161, ""), (162, "\t\n")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent, k=k, starts=starts)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == naive_components(rows, n, percent)


def test_jaccard_family(spark):
    """A document beyond the reach of its family's middle shows no common token to documents of about its size."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        words = [f"w{x}" for x in range(150)]
        for at in rng.choice(150, i % 8, replace=False):
            words[at] = f"n{i}-{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(docs, 3, 90)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == naive_components(rows, 3, 90)
    # of 148 tokens 9 or more are its own, and the others follow
    shown = spark.createDataFrame([(i, i, 148, pos, pos) for i in range(2) for pos in range(9, 15)], "id long, g long, n long, pos int, t long")
    asked, stored = ngram_join._bands(shown, 90, 1, bands=4)
    assert asked.count() == 0 and stored.where("lo = hi AND pos > 9").count() == 0
    sets = [rng.choice(4000, 300, replace=False) for _ in range(40)]
    sketch = ngram_join.parities(np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(40), 300), 40)
    for a in range(40):
        for b in range(a):
            bits = sum(int(x).bit_count() for x in (sketch[a] ^ sketch[b]).view(np.uint64))
            assert bits <= len(np.setxor1d(sets[a], sets[b]))


def test_jaccard_odd_rows(odd, empty):
    got = ngram_join.jaccard_components(odd)
    assert got.count() == odd.count() and got.where("doc_id IS NULL AND component_id IS NOT NULL").count() == 0
    assert {r["component_id"] for r in got.where("doc_id IN (4, 5)").collect()} == {4}
    assert ngram_join.jaccard_components(empty).count() == 0
    assert ngram_join.deduplicate(odd).columns == odd.columns


# vectors

def test_vectors_recall_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 8))
    x = np.concatenate([base, base[:100] + rng.standard_normal((100, 8)) * 0.12, base[:20]])
    rows = [(i, [float(v) for v in r], int(i % 3 if i < 150 else (i - 150) % 3)) for i, r in enumerate(x[:250])]
    rows += [(250 + i, [float(v) for v in r], i % 3) for i, r in enumerate(base[:20])]
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [None] + [1.0] * 7, 1),
           (904, [1.0] * 8, None), (None, [1.0] * 8, 1), (905, [1.0] * 5, 1), (906, [2.0] * 5, 1), (907, [], 1)]
    got = {r[0]: r for r in multi_index.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"),
                                                    block=37, codes=4).collect()}
    u = multi_index.unit(np.array([r[1] for r in rows]))
    label = np.array([r[2] for r in rows])
    linked = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert linked.sum() > 100 and found.sum() / linked.sum() >= 0.9 and (found <= linked.sum(1)).all()
    assert (found == linked.sum(1)).all()
    reach = np.linalg.matrix_power((linked | np.eye(len(rows), dtype=bool)).astype(np.int64), 12) > 0
    assert [got[i]["component_id"] for i in range(len(rows))] == [int(np.flatnonzero(r)[0]) for r in reach]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, 907))
    assert got[905]["n_links"] == 1 and not got[906]["kept"] and got[None]["n_links"] == 0 and not got[None]["kept"]


def test_vectors_sample_does_not_change_the_links(spark):
    """One tight family gives nearly all links of a small sample; lone pairs near the threshold lie in other cells."""
    rng = np.random.default_rng(4)
    family = rng.standard_normal(16) + rng.standard_normal((200, 16)) * 0.005
    lone = multi_index.unit(rng.standard_normal((300, 16)))
    aside = rng.standard_normal((300, 16))
    aside = multi_index.unit(aside - (aside * lone).sum(1)[:, None] * lone)
    cosine = rng.uniform(0.9802, 0.984, 300)[:, None]
    x = np.concatenate([family, lone, cosine * lone + np.sqrt(1 - cosine ** 2) * aside]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    u = multi_index.unit(x)
    linked = u @ u.T >= 0.98
    np.fill_diagonal(linked, False)
    for kind in ("float", "double"):
        docs = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
        got = dict(multi_index.near_vectors(docs, sample=120, block=64, codes=8).select("vec_id", "n_links").collect())
        assert [got[i] for i in range(len(rows))] == linked.sum(1).tolist() and linked[200:].sum() >= 600


# token files

def test_variable_length_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.random(n) * 2.0 ** rng.integers(0, 33, n)).astype(np.uint32)
        assert (tokenfile.unpack(*tokenfile.pack(x), n) == x).all()


def test_token_file(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    own, at = Tokenizer.from_file(path), 0
    rows = sorted(documents())
    got = tokenfile.token_file_report(common.table(spark, FOLDER, "documents"), path).orderBy("doc_id").collect()
    for r, d in zip(got, rows):
        ids = own.encode(d[1], add_special_tokens=False).ids + [2]
        assert tuple(r) == (d[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    some = tokenfile.token_file_report(odd, path)
    assert some.count() == odd.count() and some.where("doc_id = 1").first()["n_tokens"] == 1
    assert tokenfile.token_file_report(empty, path).count() == 0


# language model

def test_class_model(spark, odd, empty):
    docs = common.table(spark, FOLDER, "documents")
    got = {r["doc_id"]: r for r in brown.score_report(docs).collect()}
    words = {d[0]: d[1].encode().lower().split() + [b" "] for d in documents()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    seen = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, types = sum(seen.values()), len(seen)
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(ws), total)
        assert r["n_known"] == sum(seen[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (total + types + 1)) for w in ws))
    out = [r for i, r in got.items() if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert brown.score_report(odd).count() == odd.count() and brown.score_report(empty).count() == 0


def test_exchange_gain_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(3)
    words, k = 12, 5
    n = rng.integers(0, 5, (words, words)).astype(float)
    of = rng.integers(0, k, words)

    def score(of):
        table = np.zeros((k, k))
        np.add.at(table, (of[:, None].repeat(words, 1), of[None].repeat(words, 0)), n)
        unigram = np.bincount(of, n.sum(0), k)
        return brown._xlogx(table).sum() - 2 * brown._xlogx(unigram).sum(), table, unigram

    now, table, unigram = score(of)
    for w in range(words):
        left = np.bincount(of, n[:, w] * (np.arange(words) != w), k)
        right = np.bincount(of, n[w] * (np.arange(words) != w), k)
        best, better = brown._best_classes(left, right, table, of[w], unigram, n[:, w].sum(), n[w, w], 0)
        changes = [score(np.where(np.arange(words) == w, c, of))[0] - now for c in range(k)]
        assert better == pytest.approx(max(changes)) and changes[best] == pytest.approx(max(changes))


def test_many_words_move_at_once(monkeypatch):
    """Gains of many words from looked-up rows equal those word by word, and a word that goes on in the next block counts once."""
    rng = np.random.default_rng(4)
    k, count = 40, 60
    both = rng.poisson(2, (k, k)).astype(float)
    left, right = (rng.integers(1, 15, (count, k)) * (rng.random((count, k)) < 0.2) * 1.0 for _ in "ab")
    twice, old = rng.integers(0, 3, count) * 1.0, rng.integers(2, k, count)
    for i, c in enumerate(old):
        both[:, c] += left[i]
        both[c] += right[i]
        both[c, c] += twice[i]
    total, own = both.sum(0) + 1, left.sum(1) + twice
    table = brown._Table(both, total, size=3 * 2 * k * k)
    best, better = brown._best_of_many(left, right, old, own, twice, table, 2)
    one = [brown._best_classes(left[i], right[i], both, old[i], total, own[i], twice[i], 2) for i in range(count)]
    assert table.steps == 3 and best.tolist() == [b for b, _ in one] and better == pytest.approx([g for _, g in one])
    computed = []
    plain = brown._xlogx
    monkeypatch.setattr(brown, "_xlogx", lambda x: computed.append(np.size(x)) or plain(x))
    few = np.minimum(left, 3), np.minimum(right, 3)
    brown._best_of_many(*few, old, few[0].sum(1), twice * 0, table, 2)
    assert sum(computed) < k * (np.count_nonzero(few[0]) + np.count_nonzero(few[1])) / 2  # no logarithms of a row for each neighbour
    monkeypatch.undo()

    import zstandard
    word = np.repeat([9, 4, 7], [5, 3, 4])
    other, before = np.array([1, 2, 3, 9, 5, 1, 2, 3, 7, 1, 2, 3]), np.zeros(12, int)
    n = np.arange(1, 13)
    blocks = [zstandard.compress(word[a:b].astype(np.uint32).tobytes() + (2 * other + before)[a:b].astype(np.uint32).tobytes()
                                 + n[a:b].astype(np.int64).tobytes()) for a, b in ((0, 2), (2, 6), (6, 9), (9, 12))]
    got = list(brown._words_of_blocks([pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["data"])], np.arange(10), 10, lambda w: w > 0))
    assert [(w, right.tolist(), own) for w, _, right, own in got] == [
        (9, [0, 1, 2, 3, 0, 5, 0, 0, 0, 0], 4.0), (4, [0, 6, 7, 8, 0, 0, 0, 0, 0, 0], 0.0), (7, [0, 10, 11, 12, 0, 0, 0, 0, 0, 0], 9.0)]


def test_every_repeated_word_has_a_class_at_any_size(spark):
    rare = [f"rare{i}" for i in range(300)]
    rows = [(i, "the of and to " * 15_000) for i in range(8)]  # 480,000 tokens, so that two are less than 1/200,000
    rows += [(8 + i, " ".join(f"{w} follows" for w in rare)) for i in range(2)] + [(10, "once only")]
    model, rest = brown.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert (model.known[2:] == 2).sum() == len(rare) and model.known[brown.OPEN] == 2
    assert {bytes(r["word"]): r["n"] for r in rest.collect()} == {b"once": 1, b"only": 1}
    # "follows" comes after rare words only, which the classes now tell
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in brown.score(spark.createDataFrame(
        [(0, "rare7 follows rare8 follows"), (1, "rare7 the rare8 the")], "doc_id long, text string"), model, rest).collect()}
    assert got[0] > got[1]
    assert brown.class_number(30_000) < brown.class_number(170_000) < brown.class_number(10 ** 7)


def test_neighbours_lie_together(spark):
    """Both sides of every pair, each word in one partition, and a turn reads them without a shuffle of pairs."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), 30))) for i in range(50)] + [(50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    import xxhash
    hashes = np.sort(np.array([xxhash.xxh64_intdigest(c) for c in "abcdef"], np.uint64).view(np.int64))
    number = {c: int(np.searchsorted(hashes, np.uint64(xxhash.xxh64_intdigest(c)).view(np.int64))) + 2 for c in "abcdef"}
    want: dict = {}
    ends = [brown.END]
    for r in docs.collect():
        ends += [number.get(c, brown.OPEN) for c in (r["text"] or "").split()] + [brown.END]
    pairs = brown._neighbours(docs, "text", hashes)
    got, homes = {}, {}
    for part, batch in enumerate(pairs.rdd.glom().collect()):
        block = pa.RecordBatch.from_arrays([pa.array([bytes(r["data"]) for r in batch], pa.binary())], ["data"])
        for columns in brown._blocks([block]):
            for w, o, before, n in zip(*(c.tolist() for c in columns)):
                got[w, o, before] = got.get((w, o, before), 0) + n
                homes.setdefault(w, set()).add(part)
    for v, w in zip(ends[:-1], ends[1:]):
        want[v, w, False] = want.get((v, w, False), 0) + 1
        if w >= 2 and v != w:
            want[w, v, True] = want.get((w, v, True), 0) + 1
    inner = {k: n for k, n in want.items() if k[0] >= 2}
    assert {k: n for k, n in got.items() if k[0] >= 2} == inner
    assert sum(n for (w, _, before), n in got.items() if not before) == len(ends) - 1
    assert all(len(h) == 1 for h in homes.values())
    of = np.arange(8)
    once = list(brown._words_of_blocks([pa.RecordBatch.from_arrays([pa.array(
        [bytes(r["data"]) for r in pairs.collect()], pa.binary())], ["data"])], of, 8, lambda w: w >= 2))
    assert sorted(w for w, *_ in once) == list(range(2, 8))
    for w, left, right, own in once:
        assert own == want.get((w, w, False), 0) and right.sum() + own == sum(n for (v, _, b), n in want.items() if v == w and not b)
        assert left.sum() == sum(n for (v, _, b), n in want.items() if v == w and b)


# toxicity

def test_network_gradients():
    net = toxicity.Network({b"bad": 0, b"good": 1}, seed=2)
    rng = np.random.default_rng(0)
    net.w = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in net.w.items()}
    net.w["word"][-1] = 0
    words, rows, starts = toxicity._numbered([b"bad good other", b"good bad bad x y", b""])
    placed, length, owner = toxicity.windows(starts, rows, len(words))
    label, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        z = net.forward(net.gates(net.vectors(words)[0].astype(np.float64)), placed, length)
        return float(np.mean(np.logaddexp(0, z) - label * z))

    x, made = net.vectors(words)
    g = net.gradients(x, made, placed, length, label, weight)
    for name in ("xf", "ub", "att", "attv", "out", "bias", "cf"):
        at = tuple(rng.integers(0, s) for s in net.w[name].shape)
        net.w[name][at] += 1e-4
        up = loss()
        net.w[name][at] -= 2e-4
        down = loss()
        net.w[name][at] += 1e-4
        assert g[name][at] == pytest.approx((up - down) / 2e-4, abs=2e-3), name


def test_toxicity_learns(spark, odd, empty):
    rng = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(500):
        words = list(rng.choice(plain, rng.integers(5, 90)))
        if i % 4 == 0:
            for _ in range(1 + len(words) // 20):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["vile", "nasty"])))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    got = toxicity.toxicity_report(docs.select("doc_id", "text"), labels).toPandas().merge(docs.toPandas())
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.95
    net = toxicity.train(docs, toxicity.learn_only(labels))
    scored = toxicity.toxicity(odd, net, out="score")
    assert scored.count() == odd.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.toxicity(empty, net).count() == 0
    assert toxicity.keep_civil(empty, labels.limit(0)).count() == 0


# line dedup

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits, letters="abcé"):
    out = list(text)
    for _ in range(edits):
        i, how = int(rng.integers(0, len(out))), rng.integers(0, 3)
        if how == 0:
            out.insert(i, str(rng.choice(list(letters))))
        elif how == 1 and len(out) > 1:
            out.pop(i)
        else:
            out[i] = str(rng.choice(list(letters)))
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = np.random.default_rng(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice(list("abé"), rng.integers(1, 14)))
        a, b = sorted((a, edited(rng, a, rng.integers(0, 5))), key=len, reverse=True)
        if len(a) - len(b) <= edits:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), edits).alias("d")).collect():
        assert min(r["d"], edits + 1) == min(distance(r["a"], r["b"]), edits + 1)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_line_keys(spark, edits):
    """Near lines share a key, also across the limits of length buckets; a line has few keys."""
    rng = np.random.default_rng(edits)
    pairs = []
    for size in [1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 18, 20, 31, 32, 33, 63, 64, 65, 66, 79, 80, 81, 95, 96, 97, 98] * 12:
        a = "".join(rng.choice(list("abé "), size))
        pairs.append((a, edited(rng, a, edits)))

    def keys(c):
        own = F.length(c)
        line = F.struct(F.col(c).alias("line"), own.alias("len"), line_dedup._bucket(own, edits).alias("own"),
                        line_dedup._bucket(F.greatest(own - edits, F.lit(0)), edits).alias("lower"))
        return spark.createDataFrame(pairs, "a string, b string").select(line.alias("x")).select("x.*").select(
            line_dedup._line_keys(edits).alias("k")).collect()

    for (a, b), x, y in zip(pairs, keys("a"), keys("b")):
        assert set(x["k"]) & set(y["k"]), (a, b)
        assert len(x["k"]) <= 2 * (1, 2, 4, 6)[edits]


def test_distance_of_long_lines_is_linear(spark):
    """Each line is split once, not again for every character of the other one."""
    a = "abcdé " * 3_400
    got = spark.createDataFrame([(a + "x", a[:9_000] + "y" + a[9_001:])], "a string, b string").select(
        line_dedup.edit_distance(F.col("a"), F.col("b"), 2)).first()[0]
    assert got == 2


def test_near_lines(spark):
    rng = np.random.default_rng(9)
    base = ["".join(rng.choice(list("abcdé "), rng.integers(8, 20))) for _ in range(25)]
    rows = [(i, "\n".join(edited(rng, base[rng.integers(0, 25)], rng.integers(0, 4)) for _ in range(3))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n"))]
    group = {x: x for _, _, x in lines if len(x) >= 8}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in list(group):
        for b in list(group):
            if distance(a, b) <= 2:
                group[find(a)] = find(b)
    first = {}
    for i, k, x in lines:
        if len(x) >= 8:
            first.setdefault(find(x), (i, k))
    want = {i: "\n".join(x for j, k, x in lines if j == i and (len(x) < 8 or first[find(x)] == (j, k))) for i, _ in rows}
    got = line_dedup.dedup_lines(docs, 2, 8)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_equal_short_lines(spark):
    """Equal lines go at every length; near ones, blank and empty lines below the length bound don't."""
    rows = [(1, "}\n\nreturn x\nreturn y\n}"), (2, "return x\n\n\n}"), (3, "return z\n  \na line of twenty-five char"),
            (4, "a line of twenty-five chars\nreturn z")]
    got = {r["doc_id"]: (r["text"], *r["lines"]) for r in line_dedup.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("}\n\nreturn x\nreturn y", 5, 1, 0), 2: ("\n", 4, 2, 0),
                   3: ("return z\n  \na line of twenty-five char", 3, 0, 0), 4: ("", 2, 1, 1)}


def test_lines_odd_rows(odd, empty):
    got = line_dedup.dedup_lines(odd, min_chars=5)
    assert got.count() == odd.count() and set(got.columns) == set(odd.columns)
    rows = {r["doc_id"]: r for r in got.where("doc_id IS NOT NULL").collect()}
    assert rows[0]["text"] is None and rows[0]["lines"]["n_lines"] == 0 and rows[5]["text"] == "" and rows[5]["lines"]["n_exact"] == 2
    assert rows[6]["lines"]["n_near"] == 1
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.drop_repeated_lines(odd).columns == odd.columns


# repeated bytes

@pytest.mark.parametrize("hot", [2000, 2])
def test_repeated_windows(spark, monkeypatch, hot):
    rng = np.random.default_rng(hot)
    passage = "".join(rng.choice(list("abcdefgh é"), 700))
    rows = [(i, "".join(rng.choice(list("abcdefgh "), 300)) + passage[rng.integers(0, 300):][:rng.integers(150, 400)]
             + "".join(rng.choice(list("xyz"), 50))) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "ab" * 400), (23, "a" * 199), (24, rows[0][1]), (24, rows[0][1])]
    from functools import partial
    monkeypatch.setattr(suffixes, "repeated_windows", partial(suffixes.repeated_windows, hot=hot))
    got = sorted(map(tuple, suffixes.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    raws = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[k:k + 200] for _, b in raws for k in range(len(b) - 199))
    want = []
    for i, b in raws:
        mark = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if times[b[k:k + 200]] > 1:
                mark[k:k + 200] = True
        mark = mark[:-1]
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes()
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        want.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


def test_loser_tree():
    rng = np.random.default_rng(2)
    runs = [sorted({bytes(rng.choice([97, 98], rng.integers(1, 9)).tolist()) for _ in range(rng.integers(0, 30))}) for _ in range(7)]
    coded = [suffixes._read_run(suffixes._front_coded([(s, [(i, 0, 0)]) for s in run])) for i, run in enumerate(runs)]
    out = list(suffixes.LoserTree(coded))
    assert [s for _, s, _ in out] == sorted(s for run in runs for s in run)
    for (_, a, _), (shared, b, _) in zip(out, out[1:]):
        assert shared == suffixes.common_prefix(a, b, 0)


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats_in_texts_beyond_the_position_bits(spark, monkeypatch, hot):
    """Texts of five stretches of 1,023 bytes; passages cross their borders."""
    from functools import partial

    rng = np.random.default_rng(hot)
    passage = "".join(rng.choice(list("abcdefgh "), 900))
    filler = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    rows = [(0, filler(700) + passage + filler(2500) + passage[100:] + filler(300)), (1, filler(40) + passage[50:600]),
            (2, filler(3000) + passage), (3, "ab" * 1100), (4, filler(1024)), (5, "short"), (6, None)]
    monkeypatch.setattr(suffixes, "repeated_windows", partial(suffixes.repeated_windows, hot=hot, bits=10))
    got = sorted(map(tuple, suffixes.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    raws = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[k:k + 200] for _, b in raws for k in range(len(b) - 199))
    want = []
    for i, b in raws:
        gone = sorted({j for k in range(len(b) - 199) if times[b[k:k + 200]] > 1 for j in range(k, k + 200)})
        inside = set(gone)
        kept = bytes(c for j, c in enumerate(b) if j not in inside)
        want.append((i, len(b), len(gone), sum(j - 1 not in inside for j in gone), hashlib.sha256(kept).hexdigest()))
    assert got == want


def test_repeats_odd_rows(odd, empty):
    got = suffixes.remove_repeats(odd)
    assert got.count() == odd.count() and suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("length", [64, 200, 319, 500, 1000])
def test_windows_of_any_width(spark, length):
    rng = np.random.default_rng(length)
    common = "".join(rng.choice(list("abcdefgh "), 1552))
    filler = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    rows = [(0, filler(30) + common + filler(70)), (1, common), (2, filler(400) + common[300:300 + length] + filler(9)), (3, filler(2000)),
            (4, common[:length - 1])]
    got = {r["doc_id"]: (r["repeats"]["n_removed"], r["repeats"]["n_spans"], bytes(r["repeats"]["kept"])) for r in suffixes.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string"), length).collect()}
    raws = [(i, t.encode()) for i, t in rows]
    times = Counter(b[k:k + length] for _, b in raws for k in range(len(b) - length + 1))
    for i, b in raws:
        inside = {j for k in range(len(b) - length + 1) if times[b[k:k + length]] > 1 for j in range(k, k + length)}
        assert got[i] == (len(inside), sum(j - 1 not in inside for j in inside), bytes(c for j, c in enumerate(b) if j not in inside))


def test_width_is_checked(odd):
    for length in (63, 5000):
        with pytest.raises(ValueError):
            suffixes.remove_repeats(odd, length)


#: Names that operators use inside.
INSIDE = ("doc", "key", "h", "f", "k", "n", "_k", "_n", "_u", "_f", "_gone", "_same", "_spans", "_there", "_items", "_key", "_doc", "_w", "_at", "_packed",
          "first", "last", "no", "line", "own", "rows", "tokens", "known", "term", "slice", "rank", "score")


def test_given_columns_may_have_any_name(spark):
    """Every operator gives the same result beside columns named like its own."""
    texts = ["one line of text that comes twice here\nand another line", "one line of text that comes twice here\nend", None, "", "x" * 300, "x" * 300 + " y",
             "Licensed under the Apache License, Version 2.0", "word5 thing word6 and so on"]
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    crowded = plain.select("doc_id", "text", *[F.lit("x").alias(c) for c in INSIDE])
    items = spark.createDataFrame([("p", "word5 thing word6")], "item_id string, text string")
    model = licenses.train(plain)
    lm, rest = brown.train(plain)
    calls = {
        "lines": lambda d: line_dedup.dedup_lines(d, out="out"), "kept lines": line_dedup.drop_repeated_lines,
        "licences": lambda d: licenses.license_scan(d, model=model, out="out"), "repeats": lambda d: suffixes.remove_repeats(d, out="out"),
        "joined hits": lambda d: decontaminate.find_contamination(d, items, out="out", broadcast_chars=0),
        "hits": lambda d: decontaminate.find_contamination(d, items, out="out"), "clean": lambda d: decontaminate.decontaminate(d, items),
        "copies": lambda d: ngram_join.deduplicate(d),
        "model": lambda d: brown.score(d, lm, rest, keep=tuple(c for c in INSIDE if c in d.columns and c not in ("score",)))}
    for name, call in calls.items():
        a, b = call(plain), call(crowded)
        shared = [c for c in a.columns if c not in ("rows", "own", "tokens", "known") or name != "model"]
        assert set(a.columns) <= set(b.columns) and (name == "model" or set(b.columns) == set(a.columns) | set(INSIDE)), name
        order = lambda rows: sorted(map(repr, rows))
        assert order(a.select(*shared).collect()) == order(b.select(*shared).collect()), name


# sampled segmentations

def test_sampling_follows_the_lattice():
    own = sampling.Pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    text = "abc é\n"
    own.prepare([text])
    every = [((), 0.0)]
    for unit in own.units(text):
        def ways(node, done, logp):
            first = own.edges.values[node]
            if first < 0:
                yield done, logp
                return
            for e in range(first, first + own.count.values[node]):
                yield from ways(own.to.values[e], (*done, e), logp + math.log(own.p.values[e]))
        every = [(a + b, x + y) for a, x in every for b, y in ways(own.first.values[own.unit[unit]], (), 0.0)]
    chance = {a: math.exp(x) for a, x in every}
    assert sum(chance.values()) == pytest.approx(1)
    n, first, second, inverse = 8000, Counter(), Counter(), Counter()
    for found in sampling.sample(own, [text] * n, [sampling.seed_of(i, 0) for i in range(n)], 2):
        a, b = (tuple(x[0]) for x in found)
        assert a != b and found[0][2] > found[1][2] and math.exp(found[0][1]) == pytest.approx(chance[a])
        first[a] += 1
        second[b] += 1
        inverse[a] += 1 / found[0][3]
        inverse[b] += 1 / found[1][3]
    for a in sorted(chance, key=chance.get)[-2:]:  # rarer ones need more draws than this
        after = sum(chance[b] * chance[a] / (1 - chance[b]) for b in chance if b != a)
        assert first[a] / n == pytest.approx(chance[a], abs=0.025) and second[a] / n == pytest.approx(after, abs=0.025)
        assert inverse[a] / n == pytest.approx(1, abs=0.15)
    whole = sampling.sample(own, [text], [5], 10_000)[0]
    assert len({tuple(x[0]) for x in whole}) == len(chance) and all(x[3] == 1 for x in whole)


def test_segmentations_decode(spark, odd, empty):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    found = sampling.sample_segmentations(odd, path, k=3, out="samples")
    flat = found.select("doc_id", "text", F.explode("samples").alias("s")).select("doc_id", "text", "s.ids")
    back = sampling.decode_segmentations(flat, path, out="back")
    assert back.where("back <> coalesce(text, '')").count() == 0
    assert flat.groupBy("doc_id", "text").agg((F.countDistinct("ids") == F.size(F.collect_set("ids"))).alias("x")).where("NOT x").count() == 0
    own = sampling.pieces(path, 1.0)
    ids = [r["ids"] for r in flat.limit(20).collect()]
    assert [sampling.decode(own, x) for x in ids] == [own.model.decode(x) for x in ids]
    one = sampling.segmentation_report(odd.where("doc_id = 3"), path).collect()
    assert one == sampling.segmentation_report(odd.where("doc_id IN (3, 7)"), path).where("doc_id = 3").collect()
    assert sampling.segmentation_report(empty, path).count() == 0


# licences

def test_licences(spark, odd, empty):
    docs = common.table(spark, FOLDER, "documents")
    model = licenses.train(docs)
    got = {r["doc_id"]: r["licences"] for r in licenses.license_scan(docs, model=model).collect()}
    marks = {"apache-2.0": "Apache License", "cc-by-nc": "CC BY-NC", "gpl-3.0": "GNU General", "mit": "MIT License", "reserved": "All rights reserved"}
    for d in documents():
        assert got[d[0]]["families"] == sorted(f for f, m in marks.items() if m in d[1])
    made = spark.createDataFrame([(1, "licensed under the foo bar license"), (2, "plain words of no notice\n\nmore"), (3, None)],
                                 "doc_id long, text string")
    rows = {r["doc_id"]: r["licences"] for r in licenses.license_scan(made, model=model).collect()}
    assert rows[1]["n_unknown"] == 1 and rows[1]["families"] == [] and rows[2]["n_notices"] == 0 and rows[2]["n_paragraphs"] == 2
    assert rows[3]["n_paragraphs"] == 0
    assert licenses.license_scan(odd, model=model).count() == odd.count()
    assert licenses.license_scan(empty, model=model).count() == 0


# pipeline

def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, FOLDER, "documents")
    items = common.table(spark, FOLDER, "benchmark")
    kept = corpus_pipeline.drop_copies(spark, docs, FOLDER).collect()
    want = naive_components([(d[0], d[1]) for d in documents()], 5, 80)
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, (_, root) in want.items() if i == root)
    clean = corpus_pipeline.drop_benchmarks(spark, docs, FOLDER)
    bad = {r["doc_id"] for r in decontaminate.contamination_report(docs, items).where("contaminated").collect()}
    assert bad and {r["doc_id"] for r in clean.collect()} == {d[0] for d in documents()} - bad
    lines = corpus_pipeline.drop_lines(spark, docs, FOLDER)
    assert clean.columns == lines.columns == docs.columns
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "sample", "ids", "log_prob", "key", "inclusion"] and out.count() > 0
