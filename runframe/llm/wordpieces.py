"""Token ids of whole texts by a tokenizer file whose words are independent, each word and each part of it encoded once.

The tokenizers library spends most of its time per call and per word. Where a file lower-cases, splits at white space and
into runs of letters, single digits and other runs, and marks the last piece of each run, equal runs always give equal ids:
new runs are joined by blanks, encoded in one call and told apart by the mark. Words beyond ASCII and Latin-1 letters, with
control characters or with the start of a special token are encoded whole by the library; so are all texts under any other file.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from runframe.llm.common import groups, lengths_to_starts, ranges

#: Fixed value: the split rule of the files that the short way understands.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same rule for lower-cased words of printable ASCII and Latin-1 letters.
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+| ")
OTHER = re.compile(r"[^ -~À-ÖØ-öø-ÿ]|<\|")
#: Blanks for Python's split, but not for the tokenizer.
ODD_BLANKS = "\x1c\x1d\x1e\x1f"
CALL = 100


class Numbers(dict):
    """Strings numbered by order of arrival; those not yet learnt wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, name: str) -> int:
        self.new.append(name)
        self[name] = number = len(self)
        return number

    def of(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, strings), np.int64, len(strings))


class Store:
    """Id sequences by number, ids in one array."""

    def __init__(self):
        self.number, self.n = Numbers(), 0
        self.ids, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        used, n = int(self.starts[self.n]), self.n + len(sizes)
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[used:used + len(flat)] = flat
        self.starts[self.n + 1:n + 1] = used + np.cumsum(sizes)
        self.n = n

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids of each)."""
        first = self.starts[numbers]
        sizes = self.starts[numbers + 1] - first
        return self.ids[ranges(first, sizes)], sizes


class WordEncoder:
    """Ids of whole texts, as the tokenizers library gives them without special tokens of its own."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        mark = rules["model"].get("end_of_word_suffix")
        self.short = bool(mark) and steps[0].get("pattern") == {"Regex": SPLIT}
        if self.short:
            vocabulary = rules["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for piece, i in vocabulary.items() if piece.endswith(mark)]] = True
            # runs are lower-cased and split already
            self.by_run = Tokenizer.from_file(path)
            self.by_run.normalizer = normalizers.Sequence([])
            self.by_run.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.clear()

    def clear(self) -> None:
        self.words, self.runs = Store(), Store()
        self.blank = self.runs.number[" "]  # stands between words and has no ids
        self.runs.number.new.clear()
        self.runs.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _library(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, sizes.sum()), sizes

    def _learn_runs(self, runs: list[str]) -> None:
        joined = [" ".join(runs[i:i + CALL]) for i in range(0, len(runs), CALL)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.by_run.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[flat])
        if len(ends) != len(runs):
            raise ValueError("the tokenizer file does not mark the last piece of every run")
        self.runs.add(flat, np.diff(ends, prepend=-1))

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are made of known kinds of runs."""
        number = self.runs.number
        runs = number.of(RUNS.findall(" ".join(words).lower()))
        if number.new:
            self._learn_runs(number.new)
            number.new = []
        flat, sizes = self.runs.of(runs)
        ends = np.append(np.flatnonzero(runs == self.blank), len(runs))
        return flat, np.diff(lengths_to_starts(sizes)[ends], prepend=0)

    def _learn(self, words: list[str]) -> None:
        if not OTHER.search(" ".join(words)):
            self.words.add(*self._plain(words))
            return
        odd = np.array([OTHER.search(w) is not None for w in words])
        sizes, flat = np.zeros(len(words), np.int64), []
        for which, ids_of in ((odd, self._library), (~odd, self._plain)):
            if which.any():
                ids, sizes[which] = ids_of([w for w, x in zip(words, which) if x])
                flat.append(ids)
        # both kinds back in the order of the words
        starts = np.empty(len(words), np.int64)
        order = np.concatenate([np.flatnonzero(odd), np.flatnonzero(~odd)])
        starts[order] = lengths_to_starts(sizes[order])[:-1]
        self.words.add(np.concatenate(flat)[ranges(starts, sizes)], sizes)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each text)."""
        if not self.short:
            return self._library(texts)
        if len(self.words.number) > self.limit:
            self.clear()
        words = [t.split() if not any(c in t for c in ODD_BLANKS) else re.findall(r"[^ \n]+", t) for t in texts]
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        number = self.words.number
        which = number.of([w for ws in words for w in ws])
        if number.new:
            self._learn(number.new)
            number.new = []
        ids, sizes = self.words.of(which)
        return ids, np.diff(lengths_to_starts(sizes)[lengths_to_starts(per_text)])

    def encode_all(self, texts: Sequence[str], size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, ids, ids of each) for stretches of ``texts``; a text beyond ``size`` goes in parts cut at blanks."""
        for a, b in groups(texts, size):
            parts, owner = [], []
            for i in range(a, b):
                text, begin = texts[i], 0
                while self.short and len(text) - begin > size and (end := text.find(" ", begin + size)) >= 0:
                    parts.append(text[begin:end])
                    owner.append(i - a)
                    begin = end
                parts.append(text[begin:] if begin else text)
                owner.append(i - a)
            flat, sizes = [], np.zeros(b - a, np.int64)
            for c, d in groups(parts, size):
                ids, own = self.encode(parts[c:d])
                flat.append(ids)
                np.add.at(sizes, owner[c:d], own)
            yield a, b, np.concatenate(flat) if flat else np.zeros(0, np.uint32), sizes


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
    return WordEncoder(path)
