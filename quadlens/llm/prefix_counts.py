"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

count(0) = 0, and count(i) = count(i - length of the last token of prefix i) + 1: a prefix is encoded as a shorter prefix and one
more token, and of the vocabulary's tokens that end at i just one can follow the last token of what is left. So one pass over a
text gives the count of each of its prefixes, and a stored table of them answers how many tokens a prefix has, which prefix
fits a budget, and where to truncate, without encoding anything again.

The vocabulary splits texts into words first, so the table of a text is made of its words' tables; a word's table is made once in a
task. A prefix that ends inside a word need not be split as the whole text is: blanks before a word, endings such as 're and
special tokens are split in another way when they are cut. Those places are put right, so each entry is what the library gives
for that prefix alone. Counts may fall from one prefix to the next.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlens.llm.bpe_trie import BLANK, WORD, Trie, default_vocabulary
from quadlens.llm.common import map_texts

#: Words whose tables a task keeps.
CACHED_WORDS = 400_000
#: Blanks before a word: all but the last are a word of their own, which they are not while the text ends with them.
RUN = regex.compile(f"[{BLANK}]{{2,}}(?=[^{BLANK}])")
#: fixed values: word endings that are only split off when whole
ENDINGS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """A vocabulary, and steps of the counts of all prefixes: the count of a prefix is the sum of the steps up to its end."""

    def __init__(self, path: str) -> None:
        trie = Trie(path)
        self.tokens, self.crossed, self.crossing, self.special = trie.tokens, trie.crossed, trie.crossing, trie.special
        self.longest = max(map(len, self.tokens))
        self.cache: dict[str, bytes] = {}
        self.late: dict[str, int] = {}

    def counts(self, word: bytes) -> list[int]:
        """Tokens of each prefix of one word, by bytes; entry 0 is the empty prefix.

        Just one token can end a prefix, so any order of trying finds it: first the last token grown by a byte, then short ones.
        """
        n = len(word)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        token_of, crossed, never = self.tokens.get, self.crossed.get, float("inf")
        start = 0
        for end in range(1, n + 1):
            tried = end
            while True:
                token = token_of(word[start:end])
                if token is not None:
                    if not start:
                        break
                    pair = last[start], token
                    gap = crossed(pair)
                    if (self.crossing(*pair) if gap is None else gap) == never:
                        break
                start = tried = tried - 1
                if end - start > self.longest or start < 0:
                    raise ValueError("the vocabulary lacks a byte")
            last[end] = token
            count[end] = count[start] + 1
        return count

    def made(self, word: str) -> bytes:
        spelled = word.encode("utf-8")
        count = self.counts(spelled)
        if word in ENDINGS:  # cut short, the apostrophe is a word and the letter another
            count[2] = 1 + self.counts(spelled[1:2])[1]
        if len(spelled) > len(word):
            count = [0, *(count[i] for i in range(1, len(spelled)) if spelled[i] & 0xC0 != 0x80), count[-1]]
        return array("h", map(sub, count[1:], count)).tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """The step of the count at each character of the words not seen yet, as 16-bit numbers: a token of n bytes can lower a count by
        n - 1."""
        words = set(words)
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache.clear()
            new = words
        for word in new:
            self.cache[word] = self.made(word)

    def steps(self, word: str) -> bytes:
        found = self.cache.get(word)
        return self.made(word) if found is None else found

    def total(self, word: str) -> int:
        return int(np.frombuffer(self.steps(word), np.int16).sum())

    def whole_run(self, run: str) -> int:
        """How many more tokens blanks have where they end the text than as one word and the first character of the next."""
        found = self.late.get(run)
        if found is None:
            found = self.total(run) - self.total(run[:-1]) - self.total(run[-1])
            if len(self.late) >= CACHED_WORDS:
                self.late.clear()
            self.late[run] = found
        return found

    def plain(self, text: str) -> np.ndarray:
        """Steps of a text without special tokens."""
        joined = []
        for words in Trie.listed(text):
            try:
                joined.append(b"".join(map(self.cache.__getitem__, words)))
            except KeyError:
                self.learn(words)
                joined.append(b"".join(map(self.cache.__getitem__, words)))
        steps = np.frombuffer(bytearray(b"".join(joined)), np.int16)
        for m in RUN.finditer(text):
            end, more = m.end(), self.whole_run(m[0])
            if more:
                steps[end - 1] += more
                steps[end] -= more
        return steps

    def text(self, text: str) -> np.ndarray:
        """Steps of any text, one for each character."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            before = self.plain(text[at:m.start()])
            out.append(before)
            # while a special token is not whole, its characters are text that may join the last word before it
            back = self.last_word(text[at:m.start()])
            stay, total = int(before[:back].sum()), int(before.sum())
            tail = text[at + back:m.end() - 1]
            cut = np.cumsum(self.plain(tail))[len(tail) - (len(m[0]) - 1):] + stay
            out.append(np.diff(np.r_[total, cut, total + 1]).astype(np.int16))
            at = m.end()
        out.append(self.plain(text[at:]))
        return np.concatenate(out)

    @staticmethod
    def last_word(text: str) -> int:
        """Where the last word of a text starts."""
        start = 0
        for m in WORD.finditer(text):
            start = m.start()
        return start


@lru_cache(2)
def counter_of(path: str) -> PrefixCounter:
    """One per worker process and file."""
    return PrefixCounter(path)


def packed(steps: np.ndarray) -> bytes:
    """Steps as bytes: low and high bytes apart, compressed."""
    return zstandard.compress(np.ascontiguousarray(steps, np.int16).view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    """The counts of a stored table; entry i is that of the prefix of i characters."""
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    steps = np.ascontiguousarray(raw.reshape(2, -1).T).view(np.int16).ravel()
    return np.r_[0, np.cumsum(steps, dtype=np.int64)]


def prefix_table(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and prefix_counts (binary, read by unpacked()) of every whole text.

    A null text counts as empty: no bytes, no tokens, one prefix. Repeated rows give repeated rows; a null key stays; other columns
    are left out, whatever their names. Each text has one row, of about a bit or two for each of its characters.
    """
    path = vocabulary or default_vocabulary()

    def work(texts: list[str]) -> tuple[list, None]:
        counter = counter_of(path)
        steps = [counter.text(t) for t in texts]
        return [[int(s.sum()) for s in steps], [packed(s) for s in steps]], None

    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    rows = df.select(F.col(f"`{key}`").alias("key"), size.alias("n_bytes"), F.col(f"`{text}`").alias("text"))
    table = map_texts(rows, ["key", "n_bytes"], "text", [("n_tokens", "long", pa.int64()), ("prefix_counts", "binary", pa.binary())], work)
    return table.withColumnRenamed("key", key)


def ask(table: DataFrame, question: Callable[[np.ndarray, int], int], argument: Column, name: str) -> DataFrame:
    """The table with a column more: what question(counts of all prefixes, argument) says. Null arguments give null.

    Only stored counts are read; the text is not needed.
    """
    columns = [c for c in table.columns if c != name]
    rows = table.select(*(F.col(f"`{c}`") for c in columns), argument.cast("long").alias(name))
    place = columns.index("prefix_counts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(len(columns)).to_pylist()
            told = [None if x is None else question(unpacked(blob.as_py()), x) for blob, x in zip(batch.column(place), asked)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(told, pa.int64())], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def at_prefix(counts: np.ndarray, chars: int) -> int:
    """Tokens of the prefix of so many characters; longer than the text means the whole text, negative ones the empty prefix."""
    return int(counts[min(max(chars, 0), len(counts) - 1)])


def within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most so many tokens; a budget below 0 fits the empty prefix as well."""
    return int(np.flatnonzero(counts <= max(budget, 0))[-1])


def tokens_at(table: DataFrame, chars: Column, name: str = "tokens_at") -> DataFrame:
    """How many tokens the prefix of `chars` characters of each text has."""
    return ask(table, at_prefix, chars, name)


def fitting_chars(table: DataFrame, budget: Column, name: str = "fitting_chars") -> DataFrame:
    """How many characters the longest prefix with at most `budget` tokens has."""
    return ask(table, within, budget, name)


def truncated(docs: DataFrame, table: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs with each text cut to its longest prefix of at most `limit` tokens. key has to be unique in `table`."""
    fit = fitting_chars(table, F.lit(limit)).select(F.col(f"`{key}`").alias("_key"), "fitting_chars")
    joined = docs.join(fit, docs[f"`{key}`"].eqNullSafe(fit["_key"]), "left")
    cut = F.substring(docs[f"`{text}`"], F.lit(1), F.col("fitting_chars").cast("int"))
    return joined.select(*((cut.alias(c) if c == text else docs[f"`{c}`"]) for c in docs.columns))


def report(table: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (more than `limit` tokens) and how many characters fit in the limit, from a stored table."""
    return fitting_chars(table, F.lit(limit)).select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fitting_chars")
