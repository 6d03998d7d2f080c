"""Near-equal lines over all documents, by DataFrame operations only.

Lines of similar length share a bucket, whose least length is cut into edits + 1 parts: the first ones counted from the
start of a line, the others from its end. Two lines of at most ``edits`` edits share one part, moved by no more characters
than edits fit before it (or behind it). So a distinct line has few keys: a hash of each part, for the middle ones
at a few places. Lines with a common key are compared by letter counts inside the join; the rest is
verified by a banded bit-parallel edit distance: a band of 2 * edits + 1 rows in one integer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runframe.functions.runtime import cut, work_folder
from runframe.llm.common import RESULT, apart, free_name, row_key
from runframe.operators.graph import connected_components

#: Letter classes whose counts are compared; an edit changes two of the counts by one at most.
LETTERS = ("e", "n", "i", "s", "r", "a", "t", "o", "u", "d", "l", "h", "c", "m", "g", " ")


def _bucket(length: Column, edits: int) -> Column:
    """Least length of a length's bucket. Buckets are at least ``edits`` wide, so a line and a shorter one within ``edits`` edits
    share a bucket if the longer one also enters that of its length less ``edits``."""
    step = max(edits, 1)
    width = F.when(length < 32 * step, 2 * step).otherwise(8 * step)
    return (length - length % width).cast("int")


def _part_hashes(line: Column, length: Column, bucket: Column, edits: int) -> list[Column]:
    """Hashes of a line's parts in a bucket.

    Of the parts of the shorter of two near lines take the first one such that the parts up to it hold no more edits than
    its number: it holds none, and as many as its number lie before it. A part with a lead of ``shifts`` either way is stored
    shorter by that, at the places 0 … ``shifts``; of two lines one has at place 0 what the other has further on.
    """
    short = F.floor(bucket / (edits + 1)).cast("int")
    hashes = []
    for i in range(edits + 1):
        shifts = min(i, edits - i)
        size = (bucket - short * edits if i == edits // 2 else short) - shifts
        start = short * i if i <= edits - i else length - short * (edits + 1 - i)
        hashes += [F.xxhash64(bucket, F.lit(i), line.substr(start + (1 + shift), size)) for shift in range(shifts + 1)]
    return hashes


def _line_keys(edits: int) -> Column:
    """Keys of the line ``line`` of ``len`` characters in its bucket ``own``, and in ``lower`` if that is another one."""
    own, lower = (_part_hashes(F.col("line"), F.col("len"), F.col(c), edits) for c in ("own", "lower"))
    return F.when(F.col("own") == F.col("lower"), F.array(*own)).otherwise(F.array(*own, *lower))


def _letter_counts(line: Column) -> Column:
    """An integer with sixteen counts of four bits each."""
    size = F.octet_length(line)
    total = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        n = (size - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))) % 16
        total = total.bitwiseOR(F.shiftleft(n.cast("long"), 4 * k))
    return total


def _letters_differ(a: str, b: str) -> Column:
    """A lower bound of twice the edits: the counts' differences, each modulo 16."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        pick = lambda c: F.shiftright(F.col(c), 4 * k).bitwiseAND(15).cast("int")  # noqa: E731, B023
        gap = F.abs(pick(a) - pick(b))
        total = total + F.least(gap, 16 - gap)
    return total


def edit_distance(longer: Column, shorter: Column, edits: int) -> Column:
    """Edit distance of two lines whose lengths differ by at most ``edits``; right up to ``edits``, else larger than it.

    Column j of the table is kept as vertical differences of the rows j - edits … j + edits, one bit each.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    m, n = F.length(longer), F.length(shorter)

    def masks(both: Column) -> Column:
        def equal(c: Column, j: Column) -> Column:
            mask = F.lit(0)
            for b in range(width):
                mask = mask + F.when(F.get(both["pattern"], j - edits + b) == c, 1 << b).otherwise(0)
            return mask

        return F.transform(both["line"], equal)

    def step(state: Column, mask: Column) -> Column:
        vp, vn = state["vp"], state["vn"]

        def rest(d: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)))
            hn = d.bitwiseAND(vp)
            down = F.shiftright(d.bitwiseAND(full), 1)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(full).alias("vp"),
                down.bitwiseAND(hp).bitwiseAND(full).alias("vn"),
                (state["score"] + 1 - F.call_function("shiftright", d, state["diagonal"]).bitwiseAND(1)).alias("score"),
                state["diagonal"].alias("diagonal"))

        d0 = (((mask.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(mask).bitwiseOR(vn)
        return _bound(d0, rest)

    begin = F.struct(F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), (m - n).alias("score"),
                     (F.lit(edits) + m - n).alias("diagonal"))
    letters = F.struct(F.split(longer, "(?!^)(?!$)").alias("pattern"), F.split(shorter, "(?!^)(?!$)").alias("line"))
    return F.aggregate(_bound(letters, masks), begin, step, lambda s: s["score"])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(key, doc, line, no) of every non-empty line; ``key`` tells rows of other content apart."""
    return docs.select(F.col(id).cast("long").alias("doc"), row_key(id, text).alias("key"),
                       F.posexplode(F.split(text, "\n")).alias("no", "line")).where(F.length("line") > 0)


def line_classes(docs: DataFrame, edits: int = 2, min_chars: int = 20, id: str = "doc_id", text: str = "text",
                 ) -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes: hash pair (f, h) of a distinct line with the class ``f0, h0`` it belongs to, the
    place (doc, key, no) where the class first occurs, and how often the line occurs. links: pairs of distinct lines.

    Equal lines are one class at every length. Only lines of ``min_chars`` characters or more are compared with others,
    since two edits would join unlike short lines; the first place is the smallest (doc, key, no), a
    null id before all others.
    """
    sized = line_rows(docs, id, text).withColumn("len", F.length("line"))
    hashed = (sized.withColumn("own", _bucket(F.col("len"), edits)).withColumn("lower", _bucket(F.greatest(F.col("len") - edits, F.lit(0)), edits))
              .select(F.xxhash64("line").alias("f"), F.xxhash64(F.lit(1), "line").alias("h"), "doc", "key", "no",
                      F.when(F.col("len") >= min_chars, _line_keys(edits)).alias("keys")))
    folder = f"{work_folder(docs.sparkSession)}/lines"
    hashed.groupBy("f", "h").agg(F.min(F.struct("doc", "key", "no")).alias("first"), F.count(F.lit(1)).alias("n"),
                                 F.first("keys").alias("keys")).write.parquet(folder)
    found = docs.sparkSession.read.parquet(folder)
    distinct = found.drop("keys")
    # few lines share a key with another one; only those are read and compared
    shared = cut(found.select("f", F.explode("keys").alias("k")).withColumn("sharers", F.count(F.lit(1)).over(Window.partitionBy("k")))
                 .where("sharers > 1").select("f", "k"))
    text_of = cut(_lines_at(docs, distinct.join(shared.select("f").distinct(), "f", "left_semi"), id, text)
                  .withColumn("len", F.length("line")).withColumn("letters", _letter_counts(F.col("line"))))
    asked = shared.join(text_of.drop("line"), "f")
    stored = asked.select("k", *[F.col(c).alias(f"{c}2") for c in ("f", "h", "len", "letters")])
    near = cut(asked.join(stored, "k").where(f"len - len2 BETWEEN 0 AND {edits}")
               .where("len > len2 OR struct(f, h) > struct(f2, h2)")
               .where(_letters_differ("letters", "letters2") <= 2 * edits).select("f", "h", "f2", "h2").distinct())
    text_of = text_of.select("f", "h", "line")
    both = near.join(text_of, ["f", "h"]).join(text_of.selectExpr("f AS f2", "h AS h2", "line AS line2"), ["f2", "h2"])
    links = cut(both.where(edit_distance(F.col("line"), F.col("line2"), edits) <= edits).select("f", "h", "f2", "h2"))
    # components over one number per line; the numbers of linked lines only
    linked = cut(links.select("f", "h").unionByName(links.select(F.col("f2").alias("f"), F.col("h2").alias("h"))).distinct()
                 .withColumn("node", F.monotonically_increasing_id()))
    edges = (links.join(linked.withColumnRenamed("node", "a"), ["f", "h"])
             .join(linked.selectExpr("f AS f2", "h AS h2", "node AS b"), ["f2", "h2"]).select("a", "b"))
    parts = connected_components(linked.select(F.col("node").alias("id")), edges).withColumnRenamed("id", "node")
    grouped = linked.join(parts, "node").join(distinct, ["f", "h"])
    firsts = grouped.groupBy("component").agg(F.min("first").alias("first"))
    changed = grouped.drop("first").join(firsts, "component").select("f", "h", F.col("first").alias("class_first"))
    classes = distinct.join(changed, ["f", "h"], "left").select(
        "f", "h", "n", "first", F.coalesce("class_first", "first").alias("class_first"), F.col("class_first").isNotNull().alias("near"))
    return classes, links


def _lines_at(docs: DataFrame, lines: DataFrame, id: str, text: str, at_most: int = 500_000) -> DataFrame:
    """(f, h, line) of distinct lines, each read where it first occurs. Up to ``at_most`` of them go to the texts by broadcast."""
    lines = cut(lines.select("f", "h", "first.doc", "first.key", "first.no"))
    places = lines.groupBy("doc", "key").agg(F.collect_list(F.struct("no", "f", "h")).alias("at"))
    places = F.broadcast(places) if lines.count() <= at_most else places
    own = docs.select(F.col(id).cast("long").alias("doc"), row_key(id, text).alias("key"), F.split(text, "\n").alias("lines"))
    met = own.join(places, (own.key == places.key) & own.doc.eqNullSafe(places.doc))
    return (met.select("lines", F.explode("at").alias("x")).select("x.f", "x.h", F.get("lines", F.col("x.no")).alias("line"))
            .dropDuplicates(["f", "h"]))


def dedup_lines(docs: DataFrame, edits: int = 2, min_chars: int = 20, id: str = "doc_id", text: str = "text",
                out: str = "lines") -> DataFrame:
    """``docs`` with every line but the first of its class cut out, and a struct ``out``: n_lines, n_exact, n_near.

    ``n_exact`` counts removed lines equal to an earlier line, ``n_near`` those that are only near one. Lines of less than
    ``min_chars`` characters go only if they are equal to an earlier line; empty lines stay. A null text stays null with no lines, an empty one is one empty line. Repeated rows:
    rows of equal id and text are one document and get the same result. A column named ``out`` is replaced.
    """
    return apart(docs, id, text, out, lambda own: _without_lines(own, edits, min_chars))


def _without_lines(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    id, text, out = "doc_id", "text", RESULT
    classes, _ = line_classes(docs, edits, min_chars, id, text)
    # only lines that occur again or are near another one can be removed
    again = classes.where("n > 1 OR near")
    rows = line_rows(docs, id, text).select(
        "doc", "key", "no", F.xxhash64("line").alias("f"), F.xxhash64(F.lit(1), "line").alias("h"))
    place = F.struct("doc", "key", "no")
    removed = (rows.join(again, ["f", "h"]).where(~place.eqNullSafe(F.col("class_first")))
               .groupBy("doc", "key").agg(F.collect_set("no").alias("_gone"), F.collect_set(
                   F.when(place != F.col("first"), F.col("no"))).alias("_same")))
    key, doc = "_key", "_doc"
    base = docs.withColumn(key, row_key(id, text)).withColumn(doc, F.col(id).cast("long"))
    gone, same = F.col("_gone"), F.size("_same")
    joined = base.join(removed, (F.col(key) == removed["key"]) & F.col(doc).eqNullSafe(removed["doc"]), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(gone, i))
    size = F.when(gone.isNull(), 0).otherwise(F.size(gone))
    exact = F.when(gone.isNull(), 0).otherwise(same)
    report = F.struct(F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                      exact.cast("long").alias("n_exact"), (size - exact).cast("long").alias("n_near"))
    cut_text = F.when(gone.isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[cut_text.alias(c) if c == text else F.col(c) for c in base.columns if c not in (key, doc)],
                         report.alias(out))


def line_report(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs.select("doc_id", "text"), out="lines")
    return done.select("doc_id", "lines.n_lines", "lines.n_exact", "lines.n_near",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without repeated lines; documents that had text and lose all of it go, all others stay."""
    name = free_name(docs, "lines")
    done = dedup_lines(docs, out=name, **options)
    emptied = (F.col(name)["n_exact"] + F.col(name)["n_near"] > 0) & (F.trim("text") == "")
    return done.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)
