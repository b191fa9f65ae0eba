"""Packing of tokenized documents into sequences of a fixed length by minimum bin slack.

Each task tokenizes its documents and packs their pieces by itself, so nothing is shuffled and no plan grows with the
corpus. A document longer than a window gives full windows, and what remains of it joins a pool. For each window, the
longest remaining length is set, and a bitset subset-sum over the multiset of the pool's lengths finds the sum closest to
what is left of the window; counts are found by going back through the bitsets. If no sum closes the window, one more piece
is cut to close it. The pool is packed down whenever it reaches POOL pieces, and wholly at the task's end, where the last
few tokens go to sequences of lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import insort
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, kept, require, trim

WINDOW = 2048
#: Pieces a pool holds before it is packed down to half.
POOL = 4096
#: Parts and pre-tokens whose ids a worker keeps, twice each, none of over LONG letters, and letters read at once.
CACHE, LONG, BLOCK = 300_000, 64, 1 << 18
#: The id that ends each document, in four little-endian bytes.
END_ID = (1).to_bytes(4, "little")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of whole texts as little-endian bytes, by way of caches.

    The tokenizer drops white space and never joins what stands on both sides of it, so a text's ids are those of its
    parts between spaces and line feeds, one after the other. Parts of ASCII and precomposed Latin letters, which no
    normalization but lower case changes, are cut into the tokenizer's pre-tokens here, and the tokenizer's model is asked
    for each pre-token once; any other part goes through the whole tokenizer. Texts are taken some at a time, so that what
    is new in them is found by one difference of sets.
    """

    #: What the shortcut takes: visible ASCII and Latin letters with one-to-one lower case. Control strings go the long way.
    PLAIN = re.compile(r"(?:(?!<\|)[!-~À-ÖØ-öø-įĲ-ňŊ-ž])+")
    #: The vocabulary's rule for pre-tokens (fixed values), for such parts.
    PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ž]+|[0-9]|[^a-zÀ-ž0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Byte-level vocabularies write a byte as a character: itself if it is visible, else the next one from 256 on.
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        unseen = [b for b in range(256) if b not in seen]
        self.letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(unseen)}
        self.pre_tokens = Recent(self._pre_token, CACHE)
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pre_token(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            return self.pre_tokens[part.lower()]
        if self.PLAIN.fullmatch(part):
            return b"".join(map(self.pre_tokens.__getitem__, self.PRE_TOKENS.findall(part.lower())))
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(part, add_special_tokens=False).ids])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        at = 0
        while at < len(texts):
            block: list[list[str]] = []
            size = 0
            while at < len(texts) and size < BLOCK:
                size += len(texts[at])
                block.append(texts[at].replace("\n", " ").split(" "))
                at += 1
            if len(self.parts) > CACHE:
                self.older, self.parts = self.parts, {}
            known, before = self.parts, self.older.get
            new = set().union(*block).difference(known)
            for part in new:
                ids = before(part)
                known[part] = self._part(part) if ids is None else ids
            for parts in block:
                yield b"".join(map(known.__getitem__, parts))
            for part in new:
                if len(part) > LONG:
                    del known[part]


def tokenizer_of(path: str) -> WordTokenizer:
    """The tokenizer of this process: later tasks of a worker find its caches filled, until another operator's begin."""
    return kept(("tokenizer", path), lambda: WordTokenizer(path))


def best_fill(lengths: list[int], counts: Callable[[int], int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the sub-multiset whose sum is the largest that is at most room.

    lengths: distinct, ascending. The bitset of reachable sums takes the lengths from the longest down, each in powers of
    two of its count, and ends as soon as room itself is reached.
    """
    if room <= 0:
        return []
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    sums, trail = 1, []
    for length in reversed(lengths):
        if length > room:
            continue
        left, share = min(counts(length), room // length), 1
        while left and not sums & goal:
            share = min(share, left)
            more = (sums | sums << length * share) & mask
            if more != sums:
                trail.append((length, share, sums))
                sums = more
            left -= share
            share *= 2
        if sums & goal:
            break
    at, used = sums.bit_length() - 1, defaultdict(int)
    for length, share, without in reversed(trail):
        if not without >> at & 1:
            used[length] += share
            at -= length * share
    return list(used.items())


class Packer:
    """Takes (doc_id, ids as bytes); gives finished pieces as rows of PIECES. first: the first sequence's number."""

    def __init__(self, first: int, window: int = WINDOW):
        self.window, self.sequence, self.size = window, first, 0
        self.pool: dict[int, deque] = {}
        self.lengths: list[int] = []
        self.tokens = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.window:
            self._place([(doc_id, at, ids[4 * at : 4 * (at + self.window)], n)])
            at += self.window
        if at < n:
            self._put((doc_id, at, ids[4 * at :], n))
        if self.size >= POOL:
            while self.size > POOL // 2:
                self._fill()

    def finish(self) -> None:
        while self.tokens >= self.window:
            self._fill()
        left = self.tokens
        while left:
            part = 1 << (left.bit_length() - 1)
            self._fill(part)
            left -= part

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def _put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if n not in self.pool:
            self.pool[n] = deque()
            insort(self.lengths, n)
        self.pool[n].append(piece)
        self.size += 1
        self.tokens += n

    def _take(self, length: int) -> tuple:
        queue = self.pool[length]
        piece = queue.popleft()
        if not queue:
            del self.pool[length]
            self.lengths.remove(length)
        self.size -= 1
        self.tokens -= length
        return piece

    def _fill(self, capacity: int | None = None) -> None:
        """One full sequence of the capacity, from a pool that holds so many tokens."""
        capacity = capacity or self.window
        pieces, room = [], capacity
        while room and self.lengths:
            if not pieces and self.lengths[-1] <= room:
                pieces.append(self._take(self.lengths[-1]))
                room -= len(pieces[0][2]) // 4
            for length, n in best_fill(self.lengths, lambda k: len(self.pool[k]), room):
                for _ in range(n):
                    pieces.append(self._take(length))
                room -= n * length
            if room and self.lengths:  # no sum closes it: a piece is cut
                doc_id, start, ids, n = self._take(self.lengths[-1])
                pieces.append((doc_id, start, ids[: 4 * room], n))
                if len(ids) > 4 * room:
                    self._put((doc_id, start + room, ids[4 * room :], n))
                room -= min(room, len(ids) // 4)
        self._place(pieces)

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            length = len(ids) // 4
            self.out.append((doc_id, start, length, zlib.crc32(ids), n, self.sequence, offset))
            offset += length
        self.sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows of PIECES over all documents; tokenizer: the vocabulary file's path on the executors.

    A NULL text is taken as empty and gives one piece, the end id. A row that repeats a doc_id is packed as a document of
    its own. An empty table gives no rows. Sequences carry numbers that are unique, but not gapless: the partition's number
    times 2^33, and up. Other columns are ignored.
    """
    require(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = [pa.int64()] * 7
    names = [f.strip().split(" ")[0] for f in PIECES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        packer = Packer(TaskContext.get().partitionId() << 33)

        def ready():
            out = packer.taken()
            return [pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)] if out else []

        for batch in batches:
            docs_, texts = (c.to_pylist() for c in batch.columns)
            for doc, ids in zip(docs_, tokenizer_of(path).encode(texts), strict=True):
                packer.add(doc, ids + END_ID)
            yield from ready()
        packer.finish()
        yield from ready()
        trim()

    return rows.mapInArrow(run, PIECES)
