"""Byte-level BPE by a trie of words: prefixes that words share are encoded once.

The encoding of a text's prefix is known from its last token alone: without it, what is left is a shorter prefix with a
last token of its own. A token may follow another exactly if no merge crosses the border between them before either is
whole. So the trie of the distinct words is walked depth first, each node's last token is found from its ancestors', and
a word's tokens are read backwards from its node. Sorted order is the depth-first order of the trie, so the trie needs no
nodes of its own: the stack of the current path is enough, and a task's memory is one piece of text and a bounded cache.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlens.llm.common import map_texts

# fixed values: the blanks and the word pattern of byte-level BPE
BLANK = r"\t-\r \x85\xa0  -     　"
WORD_FORM = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{BLANK}{L}{N}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def word_pattern(letters: str, numbers: str) -> str:
    return WORD_FORM.replace("{L}", letters).replace("{N}", numbers).replace("{BLANK}", BLANK)


WORD = regex.compile(word_pattern(r"\p{L}", r"\p{N}"))
#: The same for texts without characters from U+02B0 on, where the letters and numbers are few ranges.
LATIN = re.compile(word_pattern(r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ", r"0-9\xb2\xb3\xb9\xbc-\xbe"))
BEYOND_LATIN = re.compile(r"[^\x00-ʯ]")

#: Words whose encoding a task keeps, and characters whose matches it holds at a time.
CACHED_WORDS, HELD_CHARS = 400_000, 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Trie:
    """A vocabulary with its merges; encodes distinct words in depth-first order."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        letters = byte_letters()
        spelled = {token: bytes(letters[c] for c in token) for token in stored["model"]["vocab"]}
        ids = stored["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: spelled[t] for t, i in ids.items()}
        self.specials = {t["content"]: t["id"] for t in stored.get("added_tokens", ())}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int, int]] = {}
        for n, (a, b) in enumerate(tuple(m) if not isinstance(m, str) else m.split(" ") for m in stored["model"]["merges"]):
            self.rank[ids[a], ids[b]] = n
            halves.setdefault(ids[a + b], (ids[a], ids[b], n))
        #: for each token, what lies at its right (left) border in the course of the merges: part, rank that consumes it
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        for t in ids.values():
            for side, chain in ((1, self.right), (0, self.left)):
                steps, part, until = [], t, float("inf")
                while True:
                    steps.append((part, until))
                    if part not in halves:
                        break
                    part, until = halves[part][side], halves[part][2]
                chain[t] = steps
        self.crossed: dict[tuple[int, int], float] = {}
        self.tokens = {spelled[t]: i for t, i in ids.items()
                       if i not in halves or self.crossing(halves[i][0], halves[i][1]) == halves[i][2]}
        #: every ending of a token: the token of that spelling, or -1
        self.endings: dict[bytes, int] = {}
        for spelling in self.tokens:
            for i in range(len(spelling)):
                self.endings.setdefault(spelling[i:], self.tokens.get(spelling[i:], -1))
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.cache: dict[str, tuple[bytes, bytes]] = {}

    def crossing(self, a: int, b: int) -> float:
        """Rank of the first merge over the border of a and b, infinite if none: both parts must lie there at that time."""
        first = self.crossed.get((a, b))
        if first is None:
            first, rank = float("inf"), self.rank
            for x, x_until in self.right[a]:
                for y, y_until in self.left[b]:
                    r = rank.get((x, y))
                    # of equal merges the left one comes first
                    if r is not None and r < x_until and r <= y_until and r < first:
                        first = r
            if len(self.crossed) > 2_000_000:
                self.crossed.clear()
            self.crossed[a, b] = first
        return first

    def walk(self, found: Iterable[bytes]) -> Iterator[list[int]]:
        """Token ids of each of the sorted distinct words; one step for each node of their trie."""
        never, endings, crossed = float("inf"), self.endings, self.crossed
        before = b""
        last, starts = [-1], [0]  # for each prefix of the path: its last token, and where that starts
        for word in found:
            n, shared = len(word), 0
            most = min(n, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1:], starts[shared + 1:]
            for end in range(shared + 1, n + 1):
                fit, start = [], end - 1
                while start >= 0 and (t := endings.get(word[start:end])) is not None:
                    if t >= 0:
                        fit.append((start, t))
                    start -= 1
                for start, t in reversed(fit):  # just one of them can follow what is left
                    if not start:
                        break
                    pair = last[start], t
                    gap = crossed.get(pair)
                    if (self.crossing(*pair) if gap is None else gap) == never:
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(t)
                starts.append(start)
            ids, at = [], n
            while at:
                ids.append(last[at])
                at = starts[at]
            before = word
            yield ids[::-1]

    def learn(self, found: set[str]) -> None:
        """Encode the words that the cache lacks."""
        new = found.difference(self.cache)
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache.clear()
            new = found
        spelled = sorted([(w.encode("utf-8", "replace"), w) for w in new])
        packed, bytes_of = self.packed, self.bytes_of
        for (_, w), ids in zip(spelled, self.walk([b for b, _ in spelled])):
            self.cache[w] = b"".join([packed[t] for t in ids]), b"".join([bytes_of[t] for t in ids])

    def parts(self, text: str) -> Iterator[int | list[str]]:
        """The text as special tokens and lists of words, each list of bounded length."""
        at = 0
        for special in self.special.finditer(text) if self.special else ():
            yield from self.listed(text[at:special.start()])
            yield self.specials[special[0]]
            at = special.end()
        yield from self.listed(text[at:] if at else text)

    @staticmethod
    def listed(text: str) -> Iterator[list[str]]:
        pattern = WORD if BEYOND_LATIN.search(text) else LATIN
        if len(text) <= HELD_CHARS:
            yield pattern.findall(text)
            return
        matches = pattern.finditer(text)
        while held := [m[0] for m in islice(matches, HELD_CHARS // 4)]:
            yield held

    def encode_decode(self, parts: Iterable[int | list[str]]) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit numbers, and what those ids decode to."""
        ids, back = [], []
        for part in parts:
            if isinstance(part, int):
                ids.append(self.packed[part])
                back.append(self.bytes_of[part])
                continue
            try:
                both = [self.cache[w] for w in part]
            except KeyError:
                self.learn(set(part))
                both = [self.cache[w] for w in part]
            ids.append(b"".join([x for x, _ in both]))
            back.append(b"".join([y for _, y in both]))
        return b"".join(ids), b"".join(back).decode("utf-8", "replace")


@lru_cache(2)
def trie_of(path: str) -> Trie:
    """One per task and file."""
    return Trie(path)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit) and decoded text of every whole text.

    A null text counts as empty: no ids, decoded to the empty text. Repeated rows give repeated results; a null key stays.
    """
    path = vocabulary or default_vocabulary()

    def work(texts: list[str]) -> tuple[list, None]:
        trie = trie_of(path)
        # the words of a piece share one walk of the trie; a text too long to hold goes part by part
        held = [list(trie.parts(t)) if len(t) <= HELD_CHARS else None for t in texts]
        trie.learn({w for parts in held if parts for part in parts if not isinstance(part, int) for w in part})
        both = [trie.encode_decode(trie.parts(t) if parts is None else parts) for t, parts in zip(texts, held)]
        return [[x for x, _ in both], [y for _, y in both]], None

    return map_texts(df, [key], text, [("ids", "binary", pa.binary()), ("decoded", "string", pa.string())], work,
                     done=lambda: trie_of.cache_clear())


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    def hexed(c: str) -> Column:
        return F.sha2(F.col(c).cast("binary"), 256)
    return encoded.select(key, (F.length("ids") / 4).cast("long").alias("n_tokens"), hexed("ids").alias("ids_sha256"),
                          hexed("decoded").alias("decoded_sha256"))

