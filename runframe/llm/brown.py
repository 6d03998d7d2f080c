"""Class-based bigram language model with exchange clustering.

log10 p(text) = sum of log10 p(class | class before) + log10 p(word | class) over the tokens.

Every word that occurs ``least`` times in the training texts (twice, at every size) gets a class by exchange, and the number
of classes grows with the root of their number. Words below that, unknown ones too, form one open class whose emissions
come from their counts over the whole corpus. The end of a text is a token with a class of its own.

Words are numbered by the order of their 64-bit hashes. The driver and each task hold arrays of about 20 bytes a word and
the class table; words, pairs and neighbour counts stay in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.functions.runtime import cut
from runframe.llm.common import fold, groups, lengths_to_starts, row_key, texts

END, OPEN = 0, 1  # token numbers; words with classes follow
END_WORD = b" "  # no word holds a blank


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class _Tokens(NamedTuple):
    """The words of some texts: distinct ones with their hashes, and which of them follow each other."""

    distinct: pa.Array
    hashes: np.ndarray
    which: np.ndarray
    sizes: np.ndarray


def _tokens(batch: list[bytes], hashed: bool = True) -> Iterator[_Tokens]:
    """Words of stretches of a batch; each distinct word of a stretch is hashed once."""
    import xxhash

    for a, b in groups(batch):
        words = [words_of(t) for t in batch[a:b]]
        coded = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
        distinct = coded.dictionary
        of = map(xxhash.xxh64_intdigest, distinct.to_pylist()) if hashed else ()
        yield _Tokens(distinct, np.fromiter(of, np.uint64, len(distinct) if hashed else 0).view(np.int64), coded.indices.to_numpy(),
                      np.fromiter(map(len, words), np.int64, len(words)))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts, with one end for each; counted per batch first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [pa.table({"word": t.distinct, "n": np.bincount(t.which, minlength=len(t.distinct))}) for t in _tokens(texts(batch, text), False)]
            parts.append(pa.table({"word": pa.array([END_WORD], pa.binary()), "n": pa.array([batch.num_rows], pa.int64())}))
            own = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
            yield from own.select(["word", "n"]).combine_chunks().to_batches()

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbers(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Numbers of words by the places of their hashes among the sorted ``known``; any other word is ``OPEN``."""
    if not len(known):
        return np.full(len(hashes), OPEN, np.int32)
    at = np.minimum(known.searchsorted(hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 2, OPEN).astype(np.int32)


def _numbered(tokens: _Tokens, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all texts in a row, an end before the first and after each; where each text starts."""
    starts = lengths_to_starts(tokens.sizes + 1) + 1
    out = np.full(starts[-1], END, np.int32)
    inner = np.ones(starts[-1], bool)
    inner[0] = False
    inner[starts[1:] - 1] = False
    out[inner] = _numbers(tokens.hashes, known)[tokens.which]
    return out, starts


def _pairs(ids: np.ndarray, parts: int, width: int) -> np.ndarray:
    """Keys of neighbouring tokens, both ways, see ``_neighbours``: the word's place among the parts above its neighbour's code."""
    v, w = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    place = lambda word: (word % parts * width + word // parts) << 32
    before = (w >= 2) & (v != w)
    return np.concatenate([place(v) | w << 1, place(w[before]) | v[before] << 1 | 1])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts; the given runs are sorted, so a stable sort only merges them."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = key.argsort(kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _packed(key: np.ndarray, n: np.ndarray, parts: int, width: int) -> bytes:
    word = key >> 32
    word = word % width * parts + word // width
    return word.astype(np.uint32).tobytes() + key.astype(np.uint32).tobytes() + n.astype(np.int64).tobytes()


def _neighbours(docs: DataFrame, text: str, hashes: np.ndarray, tokens: int = 0) -> DataFrame:
    """Neighbouring token numbers over all texts with their counts, in compressed blocks of (word, code, n), see ``_blocks``.

    ``code`` is twice the neighbour's number, and one more if it comes before the word. Each word has all that follow it; words with a
    class also have those before, but themselves. All blocks of a word lie in one partition, in the order of words, so
    that every turn of ``exchange`` reads them where they are. Words are dealt to parts by their numbers; a task counts the pairs of a
    batch, sends each part its own in one row, and a part's rows are merged as they come, so that a task holds a part's distinct pairs.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hashes)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // 4_000_000)
    parts = 4 * tasks
    width = -(-(len(hashes) + 2) // parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            found = [np.unique(_pairs(_numbered(t, shared.value)[0], parts, width), return_counts=True) for t in _tokens(texts(batch, text))]
            if not found:
                continue
            key, n = _merged(*zip(*found))
            cuts = np.append(np.flatnonzero(np.diff((key >> 32) // width, prepend=-1)), len(key))
            for at in range(0, len(cuts) - 1, 64):
                some = list(zip(cuts[at:at + 64], cuts[at + 1:at + 65]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(key[a] >> 32) // width for a, _ in some], pa.int32()),
                    pa.array([own.compress(key[a:b].tobytes() + n[a:b].astype(np.int64).tobytes()) for a, b in some], pa.binary())], ["part", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, other = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

        def blocks(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, n = _merged(keys, counts)
            for at in range(0, len(key), 300_000):
                data = own.compress(_packed(key[at:at + 300_000], n[at:at + 300_000], parts, width))
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        keys, counts, last, settled = [], [], -1, 0
        for batch in batches:
            for part, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if part != last and keys:
                    yield from blocks(keys, counts)
                    keys, counts, settled = [], [], 0
                last, data = part, other.decompress(packed)
                keys.append(np.frombuffer(data, np.int64, len(data) // 16))
                counts.append(np.frombuffer(data, np.int64, len(data) // 16, len(data) // 2))
                if sum(map(len, keys)) > 2 * settled + 1_000_000:
                    key, n = _merged(keys, counts)
                    keys, counts, settled = [key], [n], len(key)
        if keys:
            yield from blocks(keys, counts)

    rows = docs.select(text).mapInArrow(count, "part int, data binary")
    return cut(rows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(pack, "data binary"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(word, neighbour, whether it comes before the word, n) of the blocks of ``_neighbours``."""
    import zstandard

    own = zstandard.ZstdDecompressor()
    for batch in batches:
        for x in batch.column(0).to_pylist():
            data = own.decompress(x)
            rows = len(data) // 16
            code = np.frombuffer(data, np.uint32, rows, 4 * rows)
            yield (np.frombuffer(data, np.uint32, rows).astype(np.int64), (code >> 1).astype(np.int64), (code & 1).astype(bool),
                   np.frombuffer(data, np.int64, rows, 8 * rows))


def _class_table(pairs: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """Counts of neighbouring classes: k * k cells."""
    shared = pairs.sparkSession.sparkContext.broadcast(of)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = shared.value.astype(np.int64), np.zeros(k * k)
        for word, other, before, n in _blocks(batches):
            after = ~before
            table += np.bincount(now[word[after]] * k + now[other[after]], n[after], k * k)
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], ["cell", "n"])

    table = np.zeros(k * k)
    cells = pairs.mapInArrow(by_class, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return table.reshape(k, k)


def _cells_of_blocks(batches: Iterator[pa.RecordBatch], now: np.ndarray, k: int, wanted: Callable[[np.ndarray], np.ndarray],
                     cells: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, a row of 2 * k + 1 counts for each): what follows it by class, what is before it by class, itself after it.

    The last word of a block may go on in the next one: its counts wait.
    """
    width = 2 * k + 1

    def dense(word: np.ndarray, near: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        step = max(1, cells // width)
        for at in range(0, len(begins), step):
            own = begins[at:at + step]
            rows = slice(own[0], begins[at + step] if at + step < len(begins) else len(word))
            place = np.repeat(np.arange(len(own)), np.diff(np.append(own, rows.stop)))
            yield word[own], np.bincount(place * width + near[rows], n[rows], len(own) * width).reshape(len(own), width)

    last: tuple[np.ndarray, ...] = tuple(np.empty(0, np.int64) for _ in range(3))
    for word, other, before, n in _blocks(batches):
        kept = wanted(word)
        word, other, before, n = word[kept], other[kept], before[kept], n[kept]
        if not len(word):
            continue
        near = np.where(word == other, 2 * k, now[other] + k * before)
        word, near, n = (np.concatenate(x) for x in zip(last, (word, near, n)))
        end = int(np.flatnonzero(np.diff(word, prepend=-1))[-1])  # where the last word begins
        yield from dense(word[:end], near[:end], n[:end])
        held = np.bincount(near[end:], n[end:], width)
        at = np.flatnonzero(held)
        last = np.full(len(at), word[-1]), at, held[at]
    yield from dense(*last)


def _words_of_blocks(batches: Iterator[pa.RecordBatch], now: np.ndarray, k: int, wanted: Callable[[np.ndarray], np.ndarray],
                     ) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(word, counts before it by class, counts after it by class, count of itself after it), one word at a time."""
    for words, counts in _cells_of_blocks(batches, now, k, wanted):
        for word, row in zip(words.tolist(), counts):
            yield word, row[k:2 * k], row[:k], float(row[2 * k])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _rise(x: np.ndarray, by: np.ndarray | float) -> np.ndarray:
    return _xlogx(x + by) - _xlogx(x)


class _Table:
    """The class table of a turn: what a cell gains by one pair, two pairs and so on is looked up, not computed for each word."""

    def __init__(self, both: np.ndarray, total: np.ndarray, size: int = 4_000_000):
        self.both, self.total = both, total
        k = len(both)
        self.steps = int(np.clip(size // (2 * k * k), 1, 8))
        logs = _xlogx(both)
        rises = [_xlogx(both + l) - logs for l in range(1, self.steps + 1)]
        self.sides = [(both, np.concatenate(rises)), (np.ascontiguousarray(both.T), np.concatenate([r.T for r in rises]))]
        self.logs = [logs, np.ascontiguousarray(logs.T)]
        self.by_count: dict[float, np.ndarray] = {}

    def unigram(self, n: float) -> np.ndarray:
        """What all classes gain by a word of ``n`` tokens; most words have one of a few counts."""
        if n not in self.by_count:
            if len(self.by_count) >= 256:
                self.by_count.clear()
            self.by_count[n] = _rise(self.total, n)
        return self.by_count[n]


def _add_rows(gain: np.ndarray, line: np.ndarray, table: np.ndarray, row: np.ndarray, most: int = 16, span: int = 64) -> None:
    """``gain[line] += table[row]`` for ascending ``line``: the j-th rows of ``span`` lines at once, the rest of long lines at their own."""
    begins = np.flatnonzero(np.diff(line, prepend=-1))
    sizes = np.diff(np.append(begins, len(line)))
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), span):
        own, long = begins[order[at:at + span]], sizes[order[at:at + span]]
        sums = table[row[own]]
        for j in range(1, min(most, int(long[0]))):
            lines = int(np.searchsorted(-long, -j))
            sums[:lines] += table[row[own[:lines] + j]]
        gain[line[own]] += sums
    for begin, size in zip(begins[sizes > most], sizes[sizes > most]):
        gain[line[begin]] += table[row[begin + most:begin + size]].sum(0)


def _best_of_many(left: np.ndarray, right: np.ndarray, old: np.ndarray, own: np.ndarray, self_n: np.ndarray, table: _Table,
                  movable: int) -> tuple[np.ndarray, np.ndarray]:
    """Best class of each word against the bigram table of classes, all other words fixed, and how much better it is.

    ``left[i, c]``: pairs (word of class c, word i); ``right[i, c]``: (word i, word of class c), both without the pairs of
    the word with itself. The score is sum N(c,d) log N(c,d) - 2 sum N(c) log N(c). For a class that is not the word's own only a
    row for each class nearby counts; the cells that the word itself is in are mended one by one.
    """
    count, k = left.shape
    gain, stay, lines = np.zeros((count, k)), np.zeros(count), np.arange(count)
    left, right = np.ascontiguousarray(left), np.ascontiguousarray(right)
    filled = [np.nonzero(left), np.nonzero(right)]
    # column c gains left, row c gains right; the cell (c, c) gets both. Only neighbours' rows and columns change
    for near, far, (both, rises), logs, own_cells, far_cells in zip((left, right), (right, left), table.sides, table.logs, filled, filled[::-1]):
        line, cls = own_cells
        n = near[line, cls]
        few = n <= table.steps
        _add_rows(gain, line[few], rises, (n[few].astype(np.int64) - 1) * k + cls[few])
        many = np.flatnonzero(~few)
        step = max(1, 500_000 // k)
        for at in range(0, len(many), step):  # each pair of class and count once
            pick = many[at:at + step]
            pairs, row = np.unique(np.stack([cls[pick], n[pick].astype(np.int64)]), axis=1, return_inverse=True)
            _add_rows(gain, line[pick], _xlogx(both[pairs[0]] + pairs[1][:, None]) - logs[pairs[0]], row.ravel())
        home = old[line]
        without = both[cls, home] - n - np.where(cls == home, far[line, home] + self_n[line], 0)
        stay += np.bincount(line, _rise(without, n), count)
        # the row of the own class holds the word's other side
        line, cls = far_cells
        home = old[line]
        n, extra = far[line, cls], near[line, home]
        met = (extra > 0) & (cls != home)
        line, cls, home, n, extra = (x[met] for x in (line, cls, home, n, extra))
        cell = both[home, cls]
        np.add.at(gain, (line, cls), _rise(cell - n, extra) - _rise(cell, extra))
    diagonal = table.both.diagonal()
    twice = self_n > 0
    gain[twice] += _rise(diagonal, self_n[twice][:, None])
    line, cls = np.divmod(np.union1d(*[at * k + c for at, c in filled]), k)
    cell, l, r, s = diagonal[cls], left[line, cls], right[line, cls], self_n[line]
    np.add.at(gain, (line, cls), _rise(cell + s, l + r) - _rise(cell, l) - _rise(cell, r))
    l, r = left[lines, old], right[lines, old]
    cell = diagonal[old] - l - r - self_n
    stay += _rise(cell, l + r + self_n) - _rise(cell, l) - _rise(cell, r)
    counts, place = np.unique(own, return_inverse=True)
    gain -= 2 * np.stack([table.unigram(float(n)) for n in counts])[place]
    stay -= 2 * _rise(table.total[old] - own, own)
    gain[lines, old] = stay
    best = movable + gain[:, movable:].argmax(1)
    return best, gain[lines, best] - stay


def _best_classes(left: np.ndarray, right: np.ndarray, both: np.ndarray, old: int, total: np.ndarray, own: float,
                  self_n: float, movable: int) -> tuple[int, float]:
    """``_best_of_many`` for one word."""
    best, better = _best_of_many(left[None], right[None], np.array([old]), np.array([own], float), np.array([self_n], float),
                                 _Table(both, total), movable)
    return int(best[0]), float(better[0])


def exchange(pairs: DataFrame, counts: np.ndarray, classes: int, rounds: int, turns: int = 3) -> np.ndarray:
    """Class of every token number. The end and the open class stay; all other words are exchanged.

    Each round works in ``turns``: one part of the words moves against the class table of the moment, all its words at
    once. Their neighbours lie together (``_neighbours``), so a turn shuffles no more than the class table; only class numbers,
    at most one for each word, and the class table return to the driver.
    """
    spark = pairs.sparkSession
    size = len(counts)
    of = np.zeros(size, np.int32)
    of[OPEN] = 1
    of[2 + np.argsort(-counts[2:], kind="stable")] = 2 + np.arange(size - 2) % classes  # frequent words apart
    k = classes + 2
    words_n = counts.astype(np.float64)
    for turn in range(rounds * turns if size > 2 else 0):
        frozen = spark.sparkContext.broadcast((of, _class_table(pairs, of, k), np.bincount(of, words_n, k)))

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, both, total = frozen.value
            table, now = _Table(both, total), now.astype(np.int64)
            mine = lambda word: (word >= 2) & (word % turns == turn % turns)
            for words, counts in _cells_of_blocks(batches, now, k, mine):
                right, left, own = counts[:, :k], counts[:, k:2 * k], counts[:, 2 * k]
                best, better = _best_of_many(left, right, now[words], words_n[words], own, table, 2)
                moves = (best != now[words]) & (better > 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array(x[moves].astype(np.int32)) for x in (words, best)], ["word", "class"])

        new = of.copy()
        moved = pairs.mapInArrow(move, "word int, class int").toArrow()  # at most one row for each word
        new[moved["word"].to_numpy()] = moved["class"].to_numpy()
        if (new == of).all() and turn >= turns:
            break
        of = new
    return of


class Model:
    """What scoring needs in every task: hashes and classes of words, their emissions, class transitions."""

    def __init__(self, hashes: np.ndarray, of: np.ndarray, counts: np.ndarray, table: np.ndarray, tokens: int, types: int,
                 open_types: int, discount: float = 0.5):
        self.hashes, self.of, self.tokens, self.types = hashes, of, tokens, types
        size = np.bincount(of, counts, len(table))
        # absolute discounting over classes, the rest by class frequency
        seen = (table > 0).sum(1)
        after = table.sum(1)
        prior = (size + 1) / (size + 1).sum()
        p = (np.maximum(table - discount, 0) + (discount * np.maximum(seen, 1))[:, None] * prior) / np.maximum(
            after, discount)[:, None]
        p[after == 0] = prior
        self.step = np.log10(p / p.sum(1, keepdims=True))
        with np.errstate(divide="ignore"):
            self.emission = np.where(counts > 0, np.log10(np.maximum(counts, 1) / np.maximum(size[of], 1)), 0.0)
        self.emission[OPEN] = 0.0  # looked up by the word's count
        self.open_scale = np.log10(size[OPEN] + open_types + 1)
        self.known = counts
        self.base = np.log10((counts + 1) / (tokens + types + 1))


def class_number(words: int) -> int:
    """Half the root of the number of words, so that the class table stays smaller than the vocabulary; 48 at least."""
    return max(48, round(words ** 0.5 / 2))


def train(docs: DataFrame, text: str = "text", least: int = 2, classes: int | None = None, rounds: int = 2,
          ) -> tuple[Model, DataFrame]:
    """(model, counts of the words outside it). Learns from every row of ``docs``; words that occur ``least`` times
    get one of ``classes`` classes, by default ``class_number`` of them."""
    words = cut(word_counts(docs, text))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = total["n"], total["v"]
    often = (F.col("n") >= least) & (F.col("word") != F.lit(END_WORD))
    found = _hash_words(words.where(often)).toArrow()
    order = np.argsort(found["h"].to_numpy())
    hashes = found["h"].to_numpy()[order]
    ends = words.where(F.col("word") == F.lit(END_WORD)).select("n").first()
    counts = np.concatenate([[ends["n"] if ends else 0, 0], found["n"].to_numpy()[order]]).astype(np.float64)
    counts[OPEN] = tokens - counts.sum()
    rest = words.where(~often & (F.col("word") != F.lit(END_WORD)))
    pairs = _neighbours(docs, text, hashes, tokens)
    classes = classes or class_number(len(hashes))
    of = exchange(pairs, counts, classes, rounds)
    table = _class_table(pairs, of, classes + 2)
    open_types = types - len(hashes) - (1 if ends else 0)
    model = Model(hashes, of, counts, table, tokens, types, open_types)
    return model, rest.select("word", "n")


def score(docs: DataFrame, model: Model, rest: DataFrame, id: str = "doc_id", text: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Scores are log10 probabilities of the whole text with its end, by single words (add-one) and by the class
    model. A null text is empty. Repeated rows each get their result. Words outside the model meet their corpus counts
    in a join by hash; each of them has one row there.
    """
    inside = {c: f"_apart{i}" for i, c in enumerate((id, *keep))}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()], F.col(text).alias("_text"))
    scored = _scores(own, model, rest, inside[id], "_text", tuple(inside[c] for c in keep))
    named = {n: c for c, n in inside.items()}
    return scored.select(*[F.col(c).alias(named.get(c, c)) for c in scored.columns])


def _scores(docs: DataFrame, model: Model, rest: DataFrame, id: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.hashes, model.of, model.step, model.emission, model.base, model.known))
    hashed = _hash_words(rest)
    rows = docs.select(id, text, *keep, row_key(id, text, *keep).alias("_key"))
    fields = [rows.schema[c] for c in (id, *keep, "_key")]
    parts = T.StructType([*fields, T.StructField("tokens", T.LongType()), T.StructField("known", T.LongType()),
                          T.StructField("base", T.DoubleType()), T.StructField("path", T.DoubleType()),
                          T.StructField("open", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, of, step, emission, base, known = shared.value
        for batch in batches:
            at = 0
            for tokens in _tokens(texts(batch, text)):
                count = len(tokens.sizes)
                ids, starts = _numbered(tokens, hashes)
                inside = ids != OPEN
                own = np.where(inside, base[ids], 0.0)[1:]
                path = step[of[ids[:-1]], of[ids[1:]]] + emission[ids[1:]]
                cuts = starts[:-1] - 1
                seen = (inside & (known[ids] > 0))[1:]
                # distinct open words of each text with their counts
                rare = _numbers(tokens.hashes, hashes)[tokens.which] == OPEN
                size = max(1, len(tokens.hashes))
                place = np.repeat(np.arange(count) * size, tokens.sizes)[rare] + tokens.which[rare]
                place, times = np.unique(place, return_counts=True)
                offsets = pa.array(lengths_to_starts(np.bincount(place // size, minlength=count)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name).slice(at, count) for f in fields] + [
                        pa.array(np.diff(starts)), pa.array(np.add.reduceat(seen.astype(np.int64), cuts)),
                        pa.array(np.add.reduceat(own, cuts)), pa.array(np.add.reduceat(path, cuts)),
                        pa.ListArray.from_arrays(offsets, pa.array(tokens.hashes[place % size])),
                        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))], parts.names)
                at += count

    walked = rows.mapInArrow(walk, parts)
    # a row for the text itself (placed by its own key), and one for each of its distinct rare words
    group = [id, *keep, "_key"]
    flat = walked.select(*group, "tokens", "known", "base", "path", F.explode(
        F.concat(F.array(F.struct(F.col("_key").alias("h"), F.lit(0).alias("t"))),
                 F.transform(F.arrays_zip("open", "times"), lambda x: F.struct(x["open"].alias("h"), x["times"].alias("t"))))
    ).alias("x")).select(*group, F.when(F.col("x.t") == 0, F.struct("tokens", "known", "base", "path")).alias("own"), "x.h", "x.t")
    n = F.coalesce("n", F.lit(0))
    sums = flat.join(hashed, "h", "left").groupBy(*group).agg(
        F.first("own", ignorenulls=True).alias("own"), F.count("own").alias("rows"),
        F.sum(F.when(n > 0, F.col("t")).otherwise(0)).alias("known"),
        F.sum(F.col("t") * F.log10(n + 1)).alias("logs"), F.sum("t").alias("times"))
    times = F.col("times") / F.col("rows")
    logs = F.col("logs") / F.col("rows")
    out = sums.select(
        id, *keep, F.col("own.tokens").alias("n_tokens"), (F.col("own.known") + F.expr("known div rows")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("own.base") + logs - times * float(np.log10(model.tokens + model.types + 1))).alias("base_score"),
        (F.col("own.path") + logs - times * float(model.open_scale)).alias("score"), "rows")
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows")


def _hash_words(rest: DataFrame) -> DataFrame:
    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1)], ["h", "n"])

    return rest.mapInArrow(hash_all, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def score_report(docs: DataFrame) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    model, rest = train(docs.where(~held_out))
    return score(docs, model, rest).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                           "base_score", "score")
