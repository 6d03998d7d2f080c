"""Packing against the tokenizers library and against exhaustive search."""

import zlib
from itertools import product

import duckdb
import numpy as np
import pytest

from runframe.llm import packing, queries
from runframe.llm.wordpieces import WordEncoder

FOLDER = "/root/testdata/sf0.001"
PATH = queries.tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "it's ISN'T 'sam ...'s we'll're", "a\x1cb\x00c", "<|endoftext|> x<|startoftext|>y <|z", "é é    x　y",
       "Ünïcödé×÷ß ẞ İ ı ſ", "日本語 テキスト 12 ½ ²³ ١٢", "x" * 5000, "\t\n\r", "👍🏽 a👍b", "ÀÉ.!,1a2", "a\u0085b", "K Å ª º µ", "a b\x1f"]


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("size,limit", [(1 << 20, 400_000), (300, 50)])
def test_encoder_equals_the_library(size, limit):
    texts = [t or "" for t, in duckdb.sql(f"SELECT text FROM '{FOLDER}/documents.parquet'").fetchall()] + ODD
    own = WordEncoder(PATH, limit)
    assert own.short
    got = []
    for _, _, ids, sizes in own.encode_all(texts, size):
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == library(texts)


def test_encoder_falls_back_to_whole_texts():
    own = WordEncoder(queries.tokenizer_path("byte_bpe_50k.json"))
    assert not own.short
    ids, sizes = own.encode(["two  words", "", "x"])
    assert sizes.tolist() == [len(x) for x in (e.ids for e in own.tokenizer.encode_batch(["two  words", "", "x"], add_special_tokens=False))]


def check(rows, docs, size, end=0):
    """Pieces are the documents' ids in order, and every sequence is filled from 0 without a gap."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = dict(zip([i for i, _ in docs], library([t or "" for _, t in docs])))
    assert sorted(by_doc, key=repr) == sorted(want, key=repr)
    for i, ids in want.items():
        ids, at = [*ids, end], 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            own = ids[at:at + size]
            assert (r["piece"], r["start"], r["length"]) == (n, at, len(own))
            assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            at += len(own)
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), sum(n for p in by_sequence.values() for _, n in p)


def test_whole_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    got = queries.QUERIES["op12_packing"](spark, FOLDER)
    assert dict(got.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                                "sequence_id": "bigint", "offset": "bigint"}
    bins, total = check(got.collect(), docs, 2048)
    assert bins <= -(-total // 2048) + 1


@pytest.mark.parametrize("group", [7, 40, 1000])
def test_rounds_join_underfull_bins(spark, group):
    rng = np.random.default_rng(group)
    lengths = [int(x) for x in rng.integers(1, 60, 300)] + [64] * 5
    pieces = spark.createDataFrame(list(enumerate(lengths)), "piece_key long, length long")
    got = packing.pack(pieces, 64, group).collect()
    assert sorted(r["piece_key"] for r in got) == list(range(305))
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], lengths[r["piece_key"]]))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 64
    assert len(places) <= -(-sum(lengths) // 64) * {7: 1.13, 40: 1.06, 1000: 1.01}[group] + 1  # few choices in small groups


def fewest(lengths, size):
    best = len(lengths)
    for where in product(range(len(lengths)), repeat=len(lengths) - 1):
        fill = np.bincount((0, *where), lengths, len(lengths))
        if fill.max() <= size:
            best = min(best, int((fill > 0).sum()))
    return best


def test_packs_as_few_as_exhaustive_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = [int(x) for x in rng.integers(2, 14, 6)]
        assert len(packing.pack_lengths(lengths, 16)) == fewest(lengths, 16)


def test_exchanges_raise_the_squared_fill_and_empty_bins():
    # best fit leaves 3 bins; exchanging two pieces for one empties the last
    rng = np.random.default_rng(4)
    better = 0
    for _ in range(60):
        lengths = [int(x) for x in rng.integers(24, 40, 40)]
        before = packing.best_fit(lengths, 100)
        search = packing.LocalSearch(before, lengths, 100)
        sums = [int((search.fill ** 2).sum())]
        while any(0 < f < 100 and search._give(g) for g, f in enumerate(search.fill)):
            sums.append(int((search.fill ** 2).sum()))
        assert sums == sorted(set(sums))
        after = packing.LocalSearch(before, lengths, 100).run()
        assert sorted(i for b in after for i in b) == list(range(40)) and max(sum(lengths[i] for i in b) for b in after) <= 100
        assert len(after) <= len(before)
        better += len(after) < len(before)
    assert better


def test_odd_rows_and_empty_tables(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate([None, *ODD, "word " * 9000])] + [(None, "no id", "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, piece_key long, length long")
    placed = packing.pack_documents(docs, PATH, size=100)
    got = [r.asDict() | {"ids_crc32": zlib.crc32(bytes(r["ids"]))} for r in placed.collect()]
    bins, total = check(got, [(r[0], r[1]) for r in rows], 100)
    assert bins <= -(-total // 100) + 2
    whole = packing.sequences(placed).collect()
    assert len(whole) == bins and all(len(s["ids"]) == 4 * s["length"] for s in whole)
    assert all(s["length"] == sum(p["length"] for p in s["pieces"]) for s in whole)
    twice = packing.pack_documents(docs.union(docs), PATH, size=100)
    assert twice.count() == 2 * len(got) and twice.select("piece_key").distinct().count() == 2 * len(got)
    assert packing.packing_report(docs.limit(0), PATH).count() == 0
