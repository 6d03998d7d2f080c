"""Ranked lexical search by pipelined term partitioning.

One pass over the documents inverts those terms that some item asks for. The documents of a task form slices, and a
posting row holds one term's documents of one slice with their occurrences. The terms are dealt to ``owners``, the rarest to the
first, and the items to bundles. A bundle travels through the owners: at every stage its
sparse accumulators of a slice (documents and scores of each item) meet the owner's postings by cogroup, which adds integer contributions, and go on to
the next owner. The last stage leaves the best documents of a slice, from which the final selection is made.

Results are exact. An accumulator is dropped only when the contributions its item may still get cannot lift it to the
score that the item's k-th best document of the slice has already. A term's later contribution is bounded by its weight, its greatest
number of occurrences and its shortest document. A document that is dropped and met again starts too low, and stays below those k documents.

Items are a stated set and go in blocks of at most ``block`` (item, term) pairs (one larger item is a block of its own), so what the
driver and the broadcasts hold is bounded; documents are read once per block. A (bundle, slice) group holds at most
``bundle`` x ``slice_docs`` scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runframe.functions.runtime import cut, work_folder
from runframe.llm.common import lengths_to_starts, texts
from runframe.llm.resample import stretches

SCALE = 1_000_000_000
POSTINGS = "slice long, term int, n long, total long, top long, shortest long, docs binary, counts binary, ids array<long>"
CARRIED = "bundle int, slice long, item int, rest long, docs binary, scores binary"
FOUND = "bundle int, slice long, item int, doc_id long, score long"
#: The posting row that holds the documents of a slice instead of a term's.
DOCUMENTS = -1


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The share of a document's length in the score: 50 for an empty one, 100 for one of average length."""
    return 50 + (50 * lengths * n_docs) // max(n_terms, 1)


def impacts(counts: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (SCALE * counts) // (1000 * counts + 20 * norm)


# --- items ------------------------------------------------------------------------------------

def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(row, item, term): the distinct terms of every distinct item row, numbered once and for all."""
    rows = cut(items.select(F.col(item).alias("item_id"), F.col(text).alias("text")).distinct()
               .withColumn("row", F.monotonically_increasing_id()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[set[bytes]] = [set() for _ in range(batch.num_rows)]
            for words, parts in stretches(texts(batch, "text"), 1):
                at = 0
                for i, n, _ in parts:
                    held[i].update(words[at:at + n])
                    at += n
            sizes = np.array([len(h) for h in held], np.int64)
            place = pa.array(np.repeat(np.arange(len(held)), sizes))
            terms = pa.array([t for h in held for t in sorted(h)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(place), batch.column("item_id").take(place), terms],
                                             ["row", "item_id", "term"])

    kind = rows.schema["item_id"].dataType.simpleString()
    return cut(rows.mapInArrow(split, f"row long, item_id {kind}, term binary"))


@dataclass
class Block:
    """The items of one block: their rows, the numbers of their terms, and (item, term) pairs by number."""
    rows: list[int]
    terms: dict[bytes, int]
    item_of: np.ndarray
    term_of: np.ndarray


def blocks_of(pairs: DataFrame, size: int) -> Iterator[Block]:
    parts = max(1, -(-pairs.count() // size))
    dealt = pairs.withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(parts)))
    for k in range(parts):
        held = dealt.where(F.col("_block") == k).select("row", "term").toArrow()
        rows, items = np.unique(held["row"].to_numpy(), return_inverse=True)
        found = held["term"].to_pylist()
        terms = {t: i for i, t in enumerate(dict.fromkeys(found))}
        if terms:
            yield Block(rows.tolist(), terms, items, np.array([terms[t] for t in found], np.int64))


# --- postings ---------------------------------------------------------------------------------

class Slice:
    """Documents of one slice and the (document, term) counts found in them."""

    def __init__(self, n_terms: int):
        self.n_terms, self.ids, self.lengths, self.keys, self.counts, self.pairs = n_terms, [], [], [], [], 0

    def add(self, doc: np.ndarray, term: np.ndarray) -> None:
        keys, counts = np.unique(doc * self.n_terms + term, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.pairs += len(keys)

    def rows(self, number: int) -> pa.RecordBatch:
        """The document row and one row per term; documents are numbered by ascending id (null ids first)."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)[order]
        keys, back = np.unique(np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64), return_inverse=True)
        counts = np.bincount(back, np.concatenate(self.counts) if self.counts else None, len(keys)).astype(np.int64)
        docs, terms = place[keys // self.n_terms], keys % self.n_terms
        by_term = np.lexsort((docs, terms))
        docs, terms, counts = docs[by_term], terms[by_term], counts[by_term]
        own, first, sizes = np.unique(terms, return_index=True, return_counts=True)

        def packed(values: np.ndarray, kind: str, head: np.ndarray) -> pa.Array:
            raw = [head.tobytes(), *(x.tobytes() for x in np.split(values.astype(kind), first[1:]) if len(own))]
            return pa.array(raw, pa.binary())

        def stat(of, head: int) -> pa.Array:
            return pa.array(np.concatenate([[head], of if len(own) else []]).astype(np.int64))

        none = np.zeros(0, np.uint8)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(own) + 1, number)), pa.array(np.concatenate([[DOCUMENTS], own]).astype(np.int32)),
            stat(sizes, int((lengths > 0).sum())), stat(sizes * 0, int(lengths.sum())),
            stat(np.maximum.reduceat(counts, first) if len(own) else [], 0),
            stat(np.minimum.reduceat(lengths[docs], first) if len(own) else [], 0),
            packed(docs, "<u2", none), packed(counts, "<u4", lengths.astype("<i8")),
            pa.array([[self.ids[i] for i in order], *[None] * len(own)], pa.list_(pa.int64()))],
            ["slice", "term", "n", "total", "top", "shortest", "docs", "counts", "ids"])


def invert(docs: DataFrame, terms: dict[bytes, int], id: str, text: str, slice_docs: int, slice_pairs: int = 1 << 20) -> DataFrame:
    """Postings of ``terms``: one row per (slice, term) and one per slice with its documents' ids and lengths."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, known = TaskContext.get().partitionId() << 36, shared.value
        held = Slice(len(known))
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), texts(batch, text)
            for begin in range(0, len(ids), slice_docs):
                for a in range(begin, min(begin + slice_docs, len(ids)), 256):
                    b = min(a + 256, begin + slice_docs, len(ids))
                    if held.ids and (len(held.ids) + b - a > slice_docs or held.pairs > slice_pairs):
                        yield held.rows(number)
                        number, held = number + 1, Slice(len(known))
                    base, lengths = len(held.ids), np.zeros(b - a, np.int64)
                    for words, parts in stretches(values[a:b], 1):
                        which, n_words, _ = np.array(parts).T
                        np.add.at(lengths, which, n_words)
                        term = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                        hit = term >= 0
                        held.add(base + np.repeat(which, n_words)[hit], term[hit])
                    held.ids += ids[a:b]
                    held.lengths += lengths.tolist()
        if held.ids:
            yield held.rows(number)

    return docs.select(F.col(id).cast("long"), text).mapInArrow(run, POSTINGS)


# --- routes and stages ------------------------------------------------------------------------

ROUTES = "term int, bundle int, owner int, weight long, items array<int>, rests array<long>"


def routes_of(block: Block, stats: dict[int, tuple[int, int, int]], n_docs: int, n_terms: int, bundle: int, owners: int) -> list[tuple]:
    """Where each term's postings go: its owner, weight, and the items of a bundle with what later owners may add to them."""
    t = len(block.terms)
    df, top, shortest = (np.array([stats.get(i, (0, 0, 0))[k] for i in range(t)], np.int64) for k in range(3))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    most = weight * impacts(top, norms(shortest, n_docs, n_terms))
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) - df[order]
    owner = np.empty(t, np.int64)
    owner[order] = before * owners // max(int(df.sum()), 1)
    rest = np.zeros((len(block.rows), owners + 1), np.int64)
    np.add.at(rest, (block.item_of, owner[block.term_of]), most[block.term_of])
    rest = rest[:, ::-1].cumsum(1)[:, ::-1]  # what this owner and those after it may add
    out = [(DOCUMENTS, b, s, 0, [], []) for b in range(-(-len(block.rows) // bundle)) for s in range(owners)]
    by = np.lexsort((block.item_of, block.item_of // bundle, block.term_of))
    key = block.term_of[by] * (len(block.rows) + 1) + block.item_of[by] // bundle
    for own in np.split(by, np.flatnonzero(np.diff(key)) + 1):
        term, items = int(block.term_of[own[0]]), block.item_of[own]
        if df[term]:
            out.append((term, int(items[0]) // bundle, int(owner[term]), int(weight[term]), (items % bundle).tolist(),
                        rest[items, owner[term] + 1].tolist()))
    return out


def visit(carried: pa.Table, postings: pa.Table, n_docs: int, n_terms: int, bundle: int):
    """Scores of a bundle in a slice after one owner, with what later owners may add, and the slice's document ids."""
    is_docs = np.asarray(postings["term"]) == DOCUMENTS
    head = int(np.flatnonzero(is_docs)[0])
    lengths = np.frombuffer(postings["counts"][head].as_py(), "<i8")
    norm = norms(lengths, n_docs, n_terms)
    scores, rest = np.zeros((bundle, len(lengths)), np.int64), np.zeros(bundle, np.int64)
    for item, left, docs, own in zip(*(carried[c].to_pylist() for c in ("item", "rest", "docs", "scores"))):
        scores[item, np.frombuffer(docs, "<u2")] = np.frombuffer(own, "<i8")
        rest[item] = left
    columns = (postings[c].to_pylist() for c in ("docs", "counts", "weight", "items", "rests"))
    for n, (docs, counts, weight, items, rests) in enumerate(zip(*columns)):
        if n == head:
            continue
        at = np.frombuffer(docs, "<u2").astype(np.int64)
        added = weight * impacts(np.frombuffer(counts, "<u4").astype(np.int64), norm[at])
        scores[np.array(items)[:, None], at] += added
        rest[items] = rests
    return scores, rest, postings["ids"][head].as_py()


def kept(scores: np.ndarray, rest: np.ndarray, k: int) -> np.ndarray:
    """Accumulators that may still be among the ``k`` best of their item, ties included."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(scores), np.int64)
    return (scores > 0) & (scores + rest[:, None] >= least[:, None])


def search(docs: DataFrame, items: DataFrame, k: int = 50, id: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", owners: int = 4, bundle: int = 256, slice_docs: int = 8192, block: int = 1 << 18) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0, equal scores by ascending id.

    Null and empty texts hold no term. Repeated items count once, a null item id stands for itself; repeated documents are
    ranked each, null document ids come first among ties. Empty tables give no rows. Other columns are not read.
    """
    if not 0 < slice_docs <= 1 << 16:
        raise ValueError("slice_docs is between 1 and 65,536")
    spark = docs.sparkSession
    pairs = item_terms(items, item, item_text)
    found = []
    for own in blocks_of(pairs, block):
        folder = f"{work_folder(spark)}/postings"
        invert(docs, own.terms, id, text, slice_docs).write.parquet(folder)
        postings = spark.read.schema(POSTINGS).parquet(folder)
        n_docs, n_terms = postings.where(F.col("term") == DOCUMENTS).agg(F.sum("n"), F.sum("total")).first()
        if not n_terms:
            continue
        held = (postings.where(F.col("term") != DOCUMENTS).groupBy("term")
                .agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.min("shortest").alias("shortest")).toArrow())  # a row per term of the block
        stats = {t: own_stats for t, *own_stats in zip(*(held[c].to_pylist() for c in ("term", "n", "top", "shortest")))}
        routes = spark.createDataFrame(routes_of(own, stats, n_docs, n_terms, bundle, owners), ROUTES)
        rows = spark.createDataFrame([(i // bundle, i % bundle, r) for i, r in enumerate(own.rows)], "bundle int, item int, row long")
        found.append(_stages(postings, routes, n_docs, n_terms, k, owners, bundle).join(F.broadcast(rows), ["bundle", "item"]))
    names = pairs.select("row", "item_id").distinct()
    out = f"item_id {names.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    if not found:
        return spark.createDataFrame([], out)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(names, "row").select("item_id", "rank", "doc_id", "score")


def _stages(postings: DataFrame, routes: DataFrame, n_docs: int, n_terms: int, k: int, owners: int, bundle: int) -> DataFrame:
    """(bundle, slice, item, doc_id, score): the ``k`` best of every slice after all owners."""
    def pass_on(key: Sequence[pa.Scalar], carried: pa.Table, own: pa.Table) -> pa.Table:
        scores, rest, _ = visit(carried, own, n_docs, n_terms, bundle)
        keep = kept(scores, rest, k)
        items = np.flatnonzero(keep.any(1))
        docs = [np.flatnonzero(keep[i]) for i in items]
        return pa.table([
            pa.array([key[0].as_py()] * len(items), pa.int32()), pa.array([key[1].as_py()] * len(items), pa.int64()),
            pa.array(items, pa.int32()), pa.array(rest[items]), pa.array([d.astype("<u2").tobytes() for d in docs], pa.binary()),
            pa.array([scores[i, d].tobytes() for i, d in zip(items, docs)], pa.binary())],
            names=["bundle", "slice", "item", "rest", "docs", "scores"])

    def finish(key: Sequence[pa.Scalar], carried: pa.Table, own: pa.Table) -> pa.Table:
        scores, rest, ids = visit(carried, own, n_docs, n_terms, bundle)
        keep = kept(scores, np.zeros_like(rest), k)
        best = [(i, d[np.argsort(-scores[i, d], kind="stable")[:k]]) for i, d in ((i, np.flatnonzero(keep[i])) for i in range(bundle))]
        items = np.repeat(np.arange(bundle), [len(d) for _, d in best])
        docs = np.concatenate([d for _, d in best]).astype(np.int64)
        return pa.table([
            pa.array([key[0].as_py()] * len(items), pa.int32()), pa.array([key[1].as_py()] * len(items), pa.int64()),
            pa.array(items, pa.int32()), pa.array(ids, pa.int64()).take(pa.array(docs)), pa.array(scores[items, docs])],
            names=["bundle", "slice", "item", "doc_id", "score"])

    carried = postings.sparkSession.createDataFrame([], CARRIED)
    for s in range(owners):
        own = postings.join(F.broadcast(routes.where(F.col("owner") == s)), "term").select(
            "bundle", "slice", "term", "weight", "items", "rests", "docs", "counts", "ids")
        step, schema = (finish, FOUND) if s == owners - 1 else (pass_on, CARRIED)
        carried = carried.groupBy("bundle", "slice").cogroup(own.groupBy("bundle", "slice")).applyInArrow(step, schema)
    return carried


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
c AS (SELECT b.item_id, d.doc_id, CAST(sum(t.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM b JOIN t USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY b.item_id, d.doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 50
"""
