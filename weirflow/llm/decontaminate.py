"""Benchmark decontamination by greedy string tiling.

Texts are word sequences (runs of letters, digits and underscores, lower case). A document and a test item that share a
seed, MATCH words in a row, are tiled: the longest matches that touch no marked word are marked, again and again, until
none of MATCH words is left; matches are looked for by running Karp-Rabin hashes of the length under search. Tiles are
taken wherever they lie, so a passage whose sentences were put in another order is still covered. A document is
contaminated by an item if its tiles cover at least COVERAGE of the item's words.

The seeds of the test items go to every task, but at most BLOCK_WORDS words of items at once; a larger benchmark is taken
in blocks, each against all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, filter_rows, map_rows, materialize, require

#: Words of the shortest match, and of a seed; an item of fewer words is sought as a whole.
MATCH = 5
#: The share of a test item's words that tiles have to cover.
COVERAGE = 0.8
#: Words of test items that are sent to the tasks at once: some 100 MB there.
BLOCK_WORDS = 1_000_000
#: Parts of texts whose ids a worker keeps, twice.
KNOWN_PARTS = 200_000
#: Base of the rolling hash, modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return [w for part in (text or "").split() for w in _WORD.findall(part.lower())]


class _Ids:
    """From what stands between white space to the ids of its words. Several words are a negative number, into many.

    A part without a word of any item is one unknown word, 0: what can't match need not be told apart.
    """

    def __init__(self, ids: dict[str, int]):
        self.ids = ids
        self._forget()

    def _forget(self) -> None:
        self.many: dict[tuple[int, ...], int] = {(): -1}
        self.listed: list[tuple[int, ...]] = [(), ()]
        self.parts = Recent(self._part, KNOWN_PARTS)

    def _part(self, part: str) -> int:
        own = tuple(self.ids.get(w, 0) for w in _WORD.findall(part.lower()))
        if own and not any(own):
            return 0
        if len(own) == 1:
            return own[0]
        if own not in self.many:
            self.many[own] = -len(self.listed)
            self.listed.append(own)
        return self.many[own]

    def of(self, text: str | None) -> np.ndarray:
        if len(self.listed) > KNOWN_PARTS:
            self._forget()
        parts = (text or "").split()
        found = np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts))
        if not (found < 0).any():
            return found
        out: list[int] = []
        for x in found.tolist():
            out.extend((x,) if x >= 0 else self.listed[-x])
        return np.array(out, np.int64)


def _window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of a fixed length; comparable between texts."""
    h = np.zeros(max(len(ids) - length + 1, 0), np.uint64)
    for k in range(length if len(h) else 0):
        h = h * BASE + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)
    return h


def tiles(item: list[int] | np.ndarray, text: list[int] | np.ndarray, match: int = MATCH) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of the greedy tiles; lengths descend.

    Each round looks for the longest match of unmarked words from the longest length so far down, by halving. Of equally
    long matches, those that come first are marked first.
    """
    a, b = np.asarray(item, np.int64), np.asarray(text, np.int64)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    match = min(match, len(a))
    found: list[tuple[int, int, int]] = []
    longest = min(len(a), len(b))
    while match and longest >= match:
        low, high, best = match, longest, None
        while low <= high:  # if there's a match of a length, there's one of each shorter length
            length = (low + high) // 2
            if met := _met(a, b, free_a, free_b, length):
                best, low = met, length + 1
            else:
                high = length - 1
        if not best:
            break
        length = low - 1
        for i, j in _pairs(a, b, free_a, free_b, length, *best):
            free_a[i : i + length] = False
            free_b[j : j + length] = False
            found.append((i, j, length))
        longest = length - 1
    return found


def _open(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that hold no marked word."""
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(marked[length:] == marked[:-length]) if len(free) >= length else np.empty(0, int)


Windows = tuple[np.ndarray, np.ndarray]


def _met(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, length: int) -> tuple[Windows, Windows] | None:
    """Unmarked windows (starts, hashes) of each text whose hash the other one has as well; None if there are none."""
    at_a, at_b = _open(free_a, length), _open(free_b, length)
    if not len(at_a) or not len(at_b):
        return None
    hash_a, hash_b = _running(a, length)[at_a], _running(b, length)[at_b]
    in_a, in_b = np.isin(hash_a, hash_b), np.isin(hash_b, hash_a)
    return ((at_a[in_a], hash_a[in_a]), (at_b[in_b], hash_b[in_b])) if in_a.any() else None


def _pairs(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, length: int, of_a: Windows, of_b: Windows) -> Iterator[tuple[int, int]]:
    """Equal unmarked windows (i, j), each i with the first j that is left; the caller marks them before it asks on.

    Each j is passed by once, however many windows have its hash. What is marked has this length or more, so a window is
    free if both its ends are.
    """
    places: dict[int, list[int]] = defaultdict(list)
    for j, h in zip(of_b[0].tolist(), of_b[1].tolist(), strict=True):
        places[h].append(j)
    nexts = dict.fromkeys(places, 0)
    last = length - 1
    for i, h in zip(of_a[0].tolist(), of_a[1].tolist(), strict=True):
        if not (free_a[i] and free_a[i + last]):
            continue
        own, k = places[h], nexts[h]
        while k < len(own) and not (free_b[own[k]] and free_b[own[k] + last]):
            k += 1
        nexts[h] = k
        for j in own[k:] if k < len(own) and not np.array_equal(a[i : i + length], b[own[k] : own[k] + length]) else own[k : k + 1]:
            # Beyond the first, only where windows that differ have one hash.
            if free_b[j] and free_b[j + last] and np.array_equal(a[i : i + length], b[j : j + length]):
                yield i, j
                break


def _running(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of a length, from running prefix hashes modulo 2^64."""
    n = len(ids)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((ids.astype(np.uint64) + np.uint64(1)) * power[:n])])
        # BASE is odd, so it has an inverse, and a window's sum can be brought back to place 0.
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]))
        return (prefix[length:] - prefix[:-length]) * back[: n - length + 1]


class Benchmark:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple[int | None, str | None]], match: int = MATCH):
        self.match = match
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int | None, list[int]]] = []
        seeds: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for item, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if not own:
                continue
            size = min(match, len(own))
            for h in _window_hashes(np.array(own), size).tolist():
                seeds[size].add((h, len(self.items)))
            self.items.append((item, own))
        self.parts = _Ids(self.ids)
        #: By seed length: sorted hashes, and the item that each comes from.
        self.seeds = {n: tuple(np.array(x, t) for x, t in zip(zip(*sorted(s)), (np.uint64, np.int64), strict=True)) for n, s in seeds.items()}

    def hits(self, text: str | None, coverage: float = COVERAGE) -> list[tuple[int | None, float, int]]:
        """(item, share of it that's covered, number of tiles) for each item that contaminates the text."""
        known = self.parts.of(text)
        candidates: set[int] = set()
        for size, (hashes, owners) in self.seeds.items():
            usable = _open(known > 0, size)  # a window with a word that no item has can't be a seed
            if len(usable):
                h = np.zeros(len(usable), np.uint64)
                for k in range(size):
                    h = h * BASE + known[usable + k].astype(np.uint64) + np.uint64(1)
                h = np.unique(h)
                low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                for x, y in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    candidates.update(owners[x:y].tolist())
        found = []
        for c in sorted(candidates):
            item, own = self.items[c]
            marked = tiles(own, known, self.match)
            share = sum(t[2] for t in marked) / len(own)
            if share >= coverage:
                found.append((item, share, len(marked)))
        return found


class Block:
    """Test items as they are sent; all tasks of a worker share the seeds that are made of them there."""

    def __init__(self, items: list[tuple[int | None, str | None]], match: int):
        self.items, self.match = items, match

    @cached_property
    def benchmark(self) -> Benchmark:
        return Benchmark(self.items, self.match)


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Distinct items in blocks of at most so many words (or one item), each of which is brought to the driver alone."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    # Characters bound the words from above: a word and what parts it from the next take two at least.
    words = F.ceil((F.length("text") + 1) / 2)
    total = items.agg(F.sum(words)).first()[0] or 0
    if total <= most:
        yield [tuple(r) for r in items.collect()]
        return
    blocks = -(-2 * total // most)
    dealt = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "benchmark")
    for k in range(blocks):
        held: list[tuple[int | None, str | None]] = []
        size = 0
        for r in dealt.where(F.col("block") == k).toLocalIterator():
            more = -(-(len(r["text"]) + 1) // 2)
            if held and size + more > most:
                yield held
                held, size = [], 0
            held.append((r["item_id"], r["text"]))
            size += more
        if held:
            yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, coverage and tiles, for each document and each test item that contaminates it.

    Clean documents give no row. NULL and empty texts are clean, and items without a word contaminate nothing; an item of
    fewer words than MATCH has to occur whole. Repeated rows of docs each give rows; repeated items count once. Other columns
    are ignored. Empty tables give no rows.
    """
    require(docs, "doc_id", "text")
    require(benchmark, "item_id", "text")
    schema = "doc_id long, item_id long, coverage double, tiles int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out: DataFrame | None = None
    for items in _blocks(benchmark, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Block(items, match))

        def tasks(sent=sent):
            bench = sent.value.benchmark

            def each(columns: dict) -> Iterator[tuple]:
                for doc, text in zip(columns["doc_id"], columns["text"], strict=True):
                    for item, share, n in bench.hits(text, coverage):
                        yield doc, item, share, n

            return each

        part = map_rows(rows, tasks, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the documents that a test item contaminates; all columns stay, and nothing is shuffled."""
    for items in _blocks(benchmark, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Block(items, match))

        def tasks(sent=sent) -> Callable[[list], list[bool]]:
            bench = sent.value.benchmark
            return lambda texts: [not bench.hits(t, coverage) for t in texts]

        docs = filter_rows(docs, "text", tasks)
    return docs
