"""Alignment of two tokenizers' tokens over the same bytes, and how many documents hold each linked pair of ids.

Each side's cumulative ends, in bytes, are a sorted array. Ends that both hold cut the two id lists into groups; the ends that
either holds cut the bytes into spans of one token of each side, which are the links. Neither vocabulary has a token that crosses from
a character into a blank, so both cut a text before each blank that follows one: what lies between is aligned once for each
distinct spelling in a task, and a text's groups and links are those of its parts in order. All new parts of a piece are aligned
at once, as arrays.

Counts over the corpus never meet the texts again. A task's documents form blocks, bounded by links; a block is one stored row with
the ids of its pairs and, packed, which document holds which pair how often. Pairs, not links, go through the exchanges: each
block asks once for each of its distinct pairs, and the answers are met with the block's row.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens.llm.bpe_trie import BLANK, byte_letters, default_vocabulary
from quadlens.llm.common import arrow_pieces, grow, map_texts, pack, shrink, unpack
from quadlens.session import cut

#: Parts whose alignment a task keeps, and their links.
CACHED_PARTS, CACHED_LINKS = 250_000, 5_000_000
#: Links (a pair in a document) and documents of a block.
BLOCK_LINKS, BLOCK_DOCS = 3_000_000, 40_000
#: Characters a task aligns at a time.
PIECE_CHARS = 1_000_000
#: A blank before a space, so that the space does not start a part.
TWO_BLANKS = re.compile(f"[{BLANK}] ")
PART_START = re.compile(f"(?<=[^{BLANK}])(?= )")


class Aligner:
    """Two vocabularies and the alignments of the parts seen so far, in flat arrays."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # lengths in bytes by id, and what a token's id looks like inside a group and at the end of its side of the group
        self.a_length = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], np.int64)
        self.b_length = np.array([len(p) for p in self.b_bytes], np.int64)
        most = max(len(self.a_length), len(self.b_length))
        self.written = [b"%d%c" % (i, mark) for mark in b",|;" for i in range(most)]
        self.written_length = np.array([len(w) for w in self.written], np.int64)
        #: texts may be cut before blanks only if no piece of B goes over such a place
        self.blank = self.b.piece_to_id("▁")
        self.cuts = self.blank != self.b.unk_id() and not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.same, self.n_a, self.n_b, self.n_groups = bytearray(), array("i"), array("i"), array("i")
        self.links, self.ends, self.groups = array("q"), array("q", [0]), []

    def parts(self, text: str) -> list[str]:
        """What lies between the places where both cut space + text, each without its first space."""
        if not self.cuts:
            return [text]
        if not TWO_BLANKS.search(" " + text):
            return text.split(" ")
        return [p[1:] for p in PART_START.split(" " + text)]

    def learn(self, found: set[str]) -> None:
        """Align the parts not seen yet."""
        new = [p for p in found if p not in self.place]
        if len(self.place) + len(new) > CACHED_PARTS or len(self.links) > CACHED_LINKS:
            self.forget()
            new = list(found)
        if not new:
            return
        of_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in new], add_special_tokens=False)]
        of_b = self.b.encode(new, num_threads=1)
        if "" in found and "" in new:
            of_b[new.index("")] = [self.blank]  # B gives the empty text no blank
        self.place.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        self.add([(" " + p).encode() for p in new], of_a, of_b)

    def add(self, spelled: list[bytes], of_a: list[list[int]], of_b: list[list[int]]) -> None:
        """Align parts, each with its bytes and both sides' ids."""
        same = np.ones(len(spelled), bool)
        for ids, known in ((of_a, self.a_bytes), (of_b, self.b_bytes)):
            same &= np.fromiter((b"".join([known[i] for i in x]) == p for x, p in zip(ids, spelled)), bool, len(spelled))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))[np.repeat(same, n)] for ids, n in ((of_a, n_a), (of_b, n_b)))
        # both sides of a part have the same bytes, so ends of all parts can be counted on
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        part_ends = a_ends[np.cumsum(n_a[same]) - 1]
        either = np.union1d(a_ends, b_ends)
        links = a[np.searchsorted(a_ends, either)] << 32 | b[np.searchsorted(b_ends, either)]
        both = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
        n_groups, n_links = np.zeros((2, len(same)), np.int64)
        n_groups[same], n_links[same] = (np.diff(np.searchsorted(x, part_ends, "right"), prepend=0) for x in (both, either))
        # a group's ids of A, then those of B
        a_last, b_last = np.searchsorted(a_ends, both), np.searchsorted(b_ends, both)
        a_size, b_size = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        most, before_a = len(self.written) // 3, np.cumsum(b_size) - b_size
        code = np.empty(len(a) + len(b), np.int64)
        a[a_last] += most
        b[b_last] += 2 * most
        code[np.arange(len(a)) + np.repeat(before_a, a_size)] = a
        code[np.arange(len(b)) + np.repeat(np.cumsum(a_size), b_size)] = b
        text = b"".join([self.written[i] for i in code.tolist()])
        # where each group's text ends, then each part's
        ends = np.cumsum(self.written_length[code])[np.cumsum(a_size + b_size) - 1]
        stops = np.zeros(len(same), np.int64)
        stops[same] = ends[np.cumsum(n_groups[same]) - 1]
        stops = np.maximum.accumulate(stops)
        starts = np.r_[0, stops[:-1]]
        self.same += same.tobytes()
        for known, n in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)):
            known.frombytes(n.astype(np.int32).tobytes())
        self.ends.frombytes((np.cumsum(n_links) + len(self.links)).tobytes())
        self.links.frombytes(links.tobytes())
        self.groups += [text[x:max(x, y - 1)] for x, y in zip(starts.tolist(), stops.tolist())]

    def placed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all parts of the texts that have tokens, and how many each text has; 0 for texts without tokens."""
        split = [self.parts(t) if t else [] for t in texts]
        self.learn({p for parts in split for p in parts})
        place, same, out, counts = self.place, self.same, [], []
        for parts in split:
            own = [place[p] for p in parts]
            if not all([same[i] for i in own]):
                own = []
            out += own
            counts.append(len(own))
        return np.array(out, np.int64), np.array(counts, np.int64)

    def spelled(self, places: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """The groups of each text."""
        groups, ends = self.groups, np.cumsum(counts)
        for start, end in zip((ends - counts).tolist(), ends.tolist()):
            yield b";".join([groups[i] for i in places[start:end].tolist()])


@lru_cache(1)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    return Aligner(a_path, b_path)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return default_vocabulary(), public_tokenizers.path("piece_bpe_32k.model")


def align(df: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """key, and the groups of every whole text as `a1,a2|b1;a3|b2,b3`, the ids of both vocabularies in order.

    Texts that are null or empty, or that one of the two does not spell byte by byte, have the empty string. Repeated rows give
    repeated rows, a null key stays, other columns are left out.
    """
    paths = vocabularies or default_vocabularies()

    def work(texts: list[str]) -> tuple[list, None]:
        aligner = aligner_of(*paths)
        return [[x.decode() for x in aligner.spelled(*aligner.placed(texts))]], None

    return map_texts(df, [key], text, [("groups", "string", pa.string())], work, PIECE_CHARS)


def span_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of so many values each."""
    ends = np.cumsum(counts)
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[ends] - total[ends - counts]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Block:
    """Documents of a task until their links reach a bound."""

    def __init__(self) -> None:
        self.keys: list[pa.Array] = []
        self.numbers: list[np.ndarray] = []
        self.digests: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: pa.Array, aligner: Aligner, texts: list[str]) -> None:
        places, counts = aligner.placed(texts)
        starts = np.frombuffer(aligner.ends, np.int64)
        n_links = (starts[1:] - starts[:-1])[places]
        per_part = [np.frombuffer(x, np.int32)[places] for x in (aligner.n_a, aligner.n_b, aligner.n_groups)] + [n_links]
        self.numbers.append(np.array([span_sums(x, counts) for x in per_part]))
        self.digests += [sha256(s).hexdigest() if s else "" for s in aligner.spelled(places, counts)]
        links = np.frombuffer(aligner.links, np.int64)[spread(starts[places], n_links)]
        pairs, which = np.unique(links, return_inverse=True)
        # a document's equal links become one entry with a count
        key = np.repeat(np.arange(len(texts)), self.numbers[-1][3]) * max(1, len(pairs)) + which
        key, times = np.unique(key, return_counts=True)
        doc, which = np.divmod(key, max(1, len(pairs)))
        self.keys.append(keys)
        self.pairs.append(pairs)
        self.held.append((np.bincount(doc, minlength=len(texts)), which.astype(np.uint32), times.astype(np.uint32)))
        self.size += len(key)

    def full(self) -> bool:
        return self.size >= BLOCK_LINKS or len(self.digests) >= BLOCK_DOCS

    def row(self, number: int) -> list[pa.Array]:
        pairs = np.unique(np.concatenate(self.pairs))
        which = np.concatenate([np.searchsorted(pairs, own)[held[1]] if len(own) else held[1].astype(np.int64) for own, held in zip(self.pairs, self.held)])
        entries = np.concatenate([h[0] for h in self.held])
        # sorted within a document: differences, beginning anew with each document
        gaps = np.diff(which, prepend=0)
        first = (np.cumsum(entries) - entries)[entries > 0]
        gaps[first] = which[first]
        packed = [shrink(pairs.astype(np.uint64)), pack(np.bincount(which, minlength=len(pairs))), pack(entries), pack(gaps),
                  pack(np.concatenate([h[2] for h in self.held]))]
        numbers = np.concatenate(self.numbers, axis=1)
        keys = pa.concat_arrays(self.keys)

        def listed(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return [pa.array([number], pa.int64()), listed(keys), *(listed(pa.array(x, pa.int64())) for x in numbers), listed(pa.array(self.digests, pa.string())),
                *(pa.array([x], pa.binary()) for x in packed)]


def blocks(df: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """One row for each block of documents: their keys, counts and digests of groups, the block's pairs, and who holds which."""
    paths = vocabularies or default_vocabularies()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    lists = ["keys", *COUNTS, "digests"]
    packed = ["pairs", "holders", "entries", "gaps", "times"]
    names = ["block", *lists, *packed]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = aligner_of(*paths), Block()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, own in arrow_pieces(batch, [t or "" for t in batch.column(1).to_pylist()], PIECE_CHARS):
                block.add(part.column(0), aligner, own)
                if block.full():
                    yield pa.RecordBatch.from_arrays(block.row(number), names=names)
                    block, number = Block(), number + 1
        if block.digests:
            yield pa.RecordBatch.from_arrays(block.row(number), names=names)

    kind = rows.schema["key"].dataType.simpleString()
    schema = ", ".join(["block long", f"keys array<{kind}>", *(f"{c} array<long>" for c in COUNTS), "digests array<string>", *(f"{c} binary" for c in packed)])
    return rows.mapInArrow(run, schema)


def asked(stored: DataFrame) -> DataFrame:
    """block, place, pair (a_id << 32 | b_id) and how many of the block's documents hold it, for each distinct pair of each block."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, holders in zip(*(c.to_pylist() for c in batch.columns)):
                pairs, holders = grow(pairs).astype(np.int64), unpack(holders)
                for start in range(0, len(pairs), 50_000):
                    own = slice(start, min(start + 50_000, len(pairs)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.stop - start, number)), pa.array(np.arange(start, own.stop, dtype=np.int32)),
                                                      pa.array(pairs[own]), pa.array(holders[own])], names=["block", "place", "pair", "holders"])

    return stored.select("block", "pairs", "holders").mapInArrow(run, "block long, place int, pair long, holders long")


def pair_counts(stored: DataFrame) -> DataFrame:
    """pair, a_id, b_id, documents (how many hold the pair linked) and best (no other pair of the a_id is in more)."""
    counted = asked(stored).groupBy("pair").agg(F.sum("holders").alias("documents"))
    counted = cut(counted.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "documents"), "pairs")
    most = counted.groupBy("a_id").agg(F.max("documents").alias("most"))
    return counted.join(most, "a_id").select("pair", "a_id", "b_id", "documents", (F.col("documents") == F.col("most")).alias("best"))


def report(df: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every whole text.

    Every row is a document of its own, repeated ones too. Texts without tokens (null, empty, or not spelled byte by byte by both)
    have zeros and an empty digest. A null key stays; an empty table gives an empty result; other columns are left out.
    """
    stored = cut(blocks(df, key, text, vocabularies), "blocks")
    answers = asked(stored).join(pair_counts(stored).select("pair", "documents", "best"), "pair").select("block", "place", "documents", "best")
    kind = stored.schema["keys"].dataType.elementType.simpleString()
    names = ["key", *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def meet(block: pa.Table, told: pa.Table) -> pa.Table:
        at = told.column("place").to_numpy()
        documents, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        documents[at], best[at] = told.column("documents").to_numpy(), told.column("best").to_numpy()
        row = {c: block.column(c).combine_chunks() for c in block.column_names}
        entries, gaps, times = (unpack(row[c][0].as_py()) for c in ("entries", "gaps", "times"))
        # differences begin anew with each document, so what came before its first entry goes off
        total = np.cumsum(gaps)
        first = np.cumsum(entries) - entries
        before = np.r_[0, total][first]
        which = total - np.repeat(before, entries)
        sums = [span_sums(values[which] * times, entries) for values in (best, documents)]
        return pa.Table.from_arrays([row["keys"].flatten(), *(row[c].flatten() for c in COUNTS), *(pa.array(x, pa.int64()) for x in sums), row["digests"].flatten()],
                                    names=names)

    schema = ", ".join([f"key {kind}", *(f"{c} long" for c in names[1:-1]), "groups_sha256 string"])
    met = stored.drop("pairs", "holders").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)
    return met.withColumnRenamed("key", key)
