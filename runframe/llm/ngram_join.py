"""Jaccard self-join of documents on word n-grams with a token-group matrix.

Similar documents form groups. A row (token, sizes, group) of the matrix says that a document of the group holds the token
among those it shows to documents of a smaller size band. A query's overlap with a group is bounded by the rows it meets,
so only groups whose bound reaches the needed overlap are opened and compared with their documents.

Only as many tokens of a document take part as the threshold and the two sizes need: all documents put their tokens in
one order; of two documents that must share ``o`` tokens, the ``k`` first common ones lie in the first ``n - o + k`` tokens
of both. Tokens that many documents share come last in that order, so they seldom decide, and tokens that no other
document shows are left out. What meets then is compared by parities of the sets (256 bits, then 1,024) before any text is
read: sets differ in no fewer tokens than their parities in bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runframe.functions.runtime import cut
from runframe.llm.common import HashedWords, free_name, groups, lengths_to_starts, list_array, mixed, packed_texts, texts, unpacked
from runframe.operators.graph import connected_components


#: Characters of texts that are hashed at once.
CHARS = 1_000_000
#: Columns of 64 parities each, 256 of a set; the column s holds 1,024.
PARITIES = ["s0", "s1", "s2", "s3"]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space."""
    return text.lower().split()


def shingles(words: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each text, with the text's number; a shorter, non-empty text is one run."""
    sizes = np.array([len(w) for w in words], np.int64)
    starts = lengths_to_starts(sizes)
    flat = np.concatenate(words) if len(words) else np.zeros(0, np.uint64)
    runs = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(words)), runs)
    at = starts[owner] + np.arange(runs.sum()) - lengths_to_starts(runs)[owner]
    long = sizes[owner] >= n
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = long | (k < sizes[owner])
        step = mixed(value * np.uint64(31) + flat[np.minimum(at + k, len(flat) - 1)] + np.uint64(k + 1)) if len(flat) else value
        value = np.where(inside, step, value)
    return value, owner


def distinct_shingles(batch: list[bytes], memory: HashedWords, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of distinct shingles, sorted by text and hash."""
    value, owner = shingles([memory.of(words_of(t)) for t in batch], n)
    cuts = np.searchsorted(owner, np.arange(len(batch) + 1)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def common_shingles(docs: DataFrame, n: int, text: str, at_most: int, seen: int = 3) -> np.ndarray:
    """Up to ``at_most`` shingles that repeat within tasks, the most frequent ones first, sorted by value.

    They only move to the end of the order of tokens: any choice gives the same links.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = HashedWords()
        for batch in batches:
            own, parts = texts(batch, text), [np.zeros(0, np.uint64)]
            for a, b in groups(own, CHARS):
                parts.append(shingles([memory.of(words_of(t)) for t in own[a:b]], n)[0])
            value, times = np.unique(np.concatenate(parts), return_counts=True)
            often = times >= seen
            yield pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(times[often])], ["t", "n"])

    rows = (docs.select(text).mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "t").limit(at_most).select("t").toArrow())
    return np.sort(rows.column("t").to_numpy().view(np.uint64))


def _needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of that size with any set it links to."""
    return -(-sizes * percent // 100)


def parities(value: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """16 words a set: every token flips one of 1,024 bits."""
    bits = np.bincount(owner * 1024 + (mixed(value) >> np.uint64(54)).astype(np.int64), minlength=1024 * rows) & 1
    return np.packbits(bits.astype(np.uint8).reshape(rows, 1024), axis=1).view(np.int64)


def _profiles(docs: DataFrame, id: str, text: str, n: int, percent: int, k: int, common: np.ndarray) -> DataFrame:
    """Per row: id, size of its set, a 128-bit print and the parities of the set, and its first tokens in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, late = HashedWords(), shared.value
        for batch in batches:
            ids, own = batch.column(0), texts(batch, text)
            for a, b in groups(own, CHARS):
                value, owner = distinct_shingles(own[a:b], memory, n)
                sizes = np.bincount(owner, minlength=b - a).astype(np.int64)
                starts = lengths_to_starts(sizes)
                prints = []
                for salt in range(2):
                    total = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(mixed(value ^ np.uint64(0x9E3779B97F4A7C15 >> salt)), out=total[1:])
                    prints.append(pa.array((total[starts[1:]] - total[starts[:-1]]).view(np.int64)))
                is_late = late[np.minimum(np.searchsorted(late, value), len(late) - 1)] == value if len(late) else np.zeros(len(value), bool)
                # late tokens follow the others of their set
                early = lengths_to_starts(~is_late)
                before = early[:-1] - early[starts[owner]]
                own_place = np.arange(len(value)) - starts[owner]
                place = np.where(is_late, (early[starts[1:]] - early[starts[:-1]])[owner] + own_place - before, before)
                taken = np.minimum(sizes, sizes - _needed(sizes, percent) + k)
                first, first_starts = place < taken[owner], lengths_to_starts(taken)
                tokens = np.zeros(first_starts[-1], np.int64)
                tokens[first_starts[owner[first]] + place[first]] = value[first].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sizes), *prints, list_array(pa.array(parities(value, owner, b - a).ravel()), np.full(b - a, 16)),
                     pa.ListArray.from_arrays(pa.array(first_starts.astype(np.int32)), pa.array(tokens))],
                    ["id", "n", "f", "h", "s", "tokens"])

    return docs.select(F.col(id).cast("long").alias("id"), text).mapInArrow(
        profile, "id long, n long, f long, h long, s array<long>, tokens array<long>")


def _verified(pairs: DataFrame, texts_: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. A set that meets many others in a row is made once."""
    both = (pairs.join(texts_.withColumnsRenamed({"id": "a", "t": "ta"}), "a")
            .join(texts_.withColumnsRenamed({"id": "b", "t": "tb"}), "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, last, known = HashedWords(), None, None
        for batch in batches:
            linked = []
            for b, first, second in zip(batch.column("b").to_pylist(), unpacked(batch, "ta"), unpacked(batch, "tb")):
                if last != b:
                    last, known = b, distinct_shingles([second], memory, n)[0]
                own = distinct_shingles([first], memory, n)[0]
                common = len(np.intersect1d(own, known, assume_unique=True))
                linked.append(100 * common >= percent * (len(own) + len(known) - common))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _texts_of(docs: DataFrame, ids: DataFrame, id: str, text: str, at_most: int = 500_000) -> DataFrame:
    """Packed texts of some documents. Up to ``at_most`` ids are broadcast; more of them meet the texts in a shuffle."""
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"))
    if ids.count() <= at_most:
        return cut(packed_texts(own.join(F.broadcast(ids), "id", "left_semi"), "id", "t"))
    return cut(packed_texts(own, "id", "t").join(ids, "id", "left_semi"))


def _fits(a: str, b: str, percent: int):
    return (F.col(a) * percent <= F.col(b) * 100) & (F.col(b) * percent <= F.col(a) * 100)


def _overlap(a: str, b: str, percent: int) -> str:
    """Least overlap of linked sets of sizes ``a`` and ``b``."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _may_link(a: str, b: str, percent: int, other: str = "m"):
    """Whether parities allow a link; those of the set of size ``b`` have the prefix ``other``."""
    apart = " + ".join(f"bit_count({s} ^ {other}{s})" for s in PARITIES)
    return F.expr(f"{apart} <= {a} + {b} - 2 * {_overlap(a, b, percent)}")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose 1,024 parities allow a link."""
    both = (pairs.join(sets.selectExpr("id AS a", "n", "s"), "a").join(sets.selectExpr("id AS b", "n AS mn", "s AS ms"), "b"))
    apart = "aggregate(zip_with(s, ms, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    return both.where(f"{apart} <= n + mn - 2 * {_overlap('n', 'mn', percent)}").select("a", "b")


def _bands(rows: DataFrame, percent: int, k: int, bands: int = 1) -> tuple[DataFrame, DataFrame]:
    """(asked, stored) rows of (id, g, n, pos, t) for every pair (lo, hi) of size bands in which the token can count.

    Band b holds the sizes from r^b on; sizes that fit span ``bands`` of them. The smaller set asks with its band as
    ``lo``, sets of at least its size answer with theirs as ``hi``. Either shows the tokens that the least overlap of the two bands needs.
    """
    r = max(100 / percent, 1.01) ** (1 / bands)
    least = f"(cast(ceil(power({r!r}D, b)) AS long) - 1)"  # no size of band b is smaller
    own = rows.withColumn("c", F.expr(f"cast(floor(ln(n) / ln({r!r}D)) AS int)"))
    asked = (own.withColumn("lo", F.col("c")).withColumn("b", F.explode(F.expr(f"sequence(c, c + {bands + 1})")))
             .where(f"{least} * {percent} <= n * 100 AND pos < n - {_overlap('n', f'greatest({least}, n)', percent)} + {k}")
             .withColumnRenamed("b", "hi"))
    smallest = f"greatest({least}, (n * {percent} + 99) div 100)"
    stored = (own.withColumn("hi", F.col("c")).withColumn("b", F.explode(F.expr(f"sequence(greatest(c - {bands + 1}, 0), c)")))
              .where(f"{least} <= n AND (power({r!r}D, b + 1) + 1) * 100 >= n * {percent} AND pos < n - {_overlap('n', smallest, percent)} + {k}")
              .withColumnRenamed("b", "lo"))
    return tuple(x.select("id", "g", "n", "pos", "t", "lo", "hi") for x in (asked, stored))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id: str = "doc_id", text: str = "text",
                       k: int = 1, common: int = 100_000, starts: int = 2) -> DataFrame:
    """(id, n_shingles, component_id) of every row: components of documents with 100 * overlap >= percent * union.

    Documents with equal sets are compared once. Groups: documents with one of their ``starts`` first shared tokens in
    common meet the one among them that has the fewest tokens before it, the middle of a family, and what links so far is a
    group. The matrix then holds the tokens of each group by size bands, and a document opens another group only if
    enough of its tokens are there; it meets the members that share as many. Pairs inside a group can't change a
    component, so no link is lost.
    Null and empty texts have size 0 and stand alone; a null id has a null component. Rows that share an id
    are one node of the graph, each row with its own size.
    """
    late = common_shingles(docs, n, text, common)
    rows = cut(_profiles(docs, id, text, n, percent, k, late))
    full = rows.where("n > 0 AND id IS NOT NULL")
    # equal sets have equal sizes and first tokens
    sets = cut(full.groupBy("f", "h").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "s", "tokens")]))
    member = full.select("id", "f", "h").join(sets.select(F.col("id").alias("rep"), "f", "h"), ["f", "h"]).where("id <> rep")
    # folded bits are parities as well
    sketch = sets.select("id", *[F.expr(" ^ ".join(f"s[{j}]" for j in range(i, 16, 4))).alias(c) for i, c in enumerate(PARITIES)])
    tokens = sets.select("id", F.posexplode("tokens").alias("pos", "t"))
    several = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("t")
    tokens = cut(tokens.join(several, "t").join(sets.select("id", "n"), "id").select("id", "n", "pos", "t"))

    home = tokens.groupBy("id", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "t"))), 1, starts).alias("x")).select(
        "id", "n", F.inline("x"))
    pivot = home.groupBy("t").agg(F.min(F.struct("pos", "id", "n")).alias("p"), F.count(F.lit(1)).alias("members")).where("members > 1")
    pairs = cut(_near(home.join(pivot, "t").selectExpr("id AS a", "n", "p.id AS b", "p.n AS mn").where("a <> b")
                      .where(_fits("n", "mn", percent)).select("a", "b").distinct(), sets, percent))
    links = cut(_verified(pairs, _texts_of(docs, _ends(pairs), id, text), n, percent))
    linked = cut(connected_components(sets.select("id"), links).withColumnRenamed("component", "g"))

    # only tokens of several groups can open one
    tokens = tokens.join(linked, "id")
    between = tokens.groupBy("t").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("t")
    tokens = cut(tokens.join(between, "t"))
    asked, stored = _bands(tokens, percent, k)
    need = f"least({k}, (n * {percent} + 99) div 100)"
    meets = F.expr(f"n <= mn AND mn * {percent} <= n * 100 AND pos < n - {_overlap('n', 'mn', percent)} + {k}"
                   f" AND mpos < mn - {_overlap('n', 'mn', percent)} + {k}")
    stored = stored.withColumnsRenamed({"id": "m", "g": "to", "n": "mn", "pos": "mpos"})
    matrix = stored.drop("m").distinct()
    opened = cut(asked.join(matrix, ["t", "lo", "hi"]).where("g <> to").where(meets).groupBy("id", "n", "to", "mn", "hi").agg(
        F.count_distinct("t").alias("bound")).where(f"bound >= {need}").select("id", "to", "mn", "hi"))
    asked = asked.drop("g").join(opened, ["id", "hi"]).join(sketch, "id")
    answers = stored.join(opened.select("to", "mn").distinct(), ["to", "mn"], "left_semi").join(_renamed(sketch, "m"), "m")
    pairs = cut(_near(asked.join(answers, ["to", "mn", "t", "lo", "hi"]).where(meets).where(_may_link("n", "mn", percent))
                .groupBy("id", "n", "m").agg(F.count(F.lit(1)).alias("bound"))
                .where(f"bound >= {need}").select(F.greatest("id", "m").alias("a"), F.least("id", "m").alias("b")).distinct(), sets, percent))
    found = _verified(pairs, _texts_of(docs, _ends(pairs), id, text), n, percent)
    edges = links.unionByName(found).unionByName(member.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    parts = connected_components(rows.where("id IS NOT NULL").select("id"), edges)
    return rows.join(parts, "id", "left").select(F.col("id").alias(id), F.col("n").alias("n_shingles"),
                                                 F.col("component").alias("component_id"))


def _renamed(sketch: DataFrame, id: str) -> DataFrame:
    return sketch.withColumnsRenamed({"id": id} | {s: "m" + s for s in PARITIES})


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def deduplicate(docs: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """Keeps the document with the smallest id of each group; of rows that share an id every one stays or goes alike.

    Rows without an id stay.
    """
    found = jaccard_components(docs, id=id, **options)
    name = free_name(docs, "_gone")
    gone = found.where(F.col("component_id") != F.col(id)).select(F.col(id).alias(name)).distinct()
    return docs.join(gone, F.col(id).cast("long") == F.col(name), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) c ON c.a = d.doc_id
"""
