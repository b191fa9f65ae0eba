"""SimHash fingerprints and near-duplicate classes by a Gray-order hierarchical index.

The index is a hierarchy of masked bit patterns. Its upper nodes fix a quarter of the bits: two fingerprints that differ
in at most MOST bits agree in at least one of MOST + 1 blocks, so each fingerprint goes to one node for each block, and
every close pair meets in a node. A node of more than LEAF fingerprints is split again by blocks of its free bits, so that
no task gets an unbounded group; where bits don't split it, it is cut into parts, every two of which are one task. Inside
a node, fingerprints are sorted by Gray rank, which puts those with long common patterns side by side; runs of FAN
of them share an inner node holding the bits that all of them agree in, and so on upwards. A search goes down from the top,
adds up the differences in the bits that each level newly fixes, and drops a whole group once the sum is over MOST.
A node gives a spanning forest of its links, not its pairs.

neardup.py uses the same index for its candidates, with other limits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, require
from .components import connected_components

SEED = 42
WORDS = 3
#: Fingerprints of so many differing bits, or fewer, are linked.
MOST = 3
#: Fingerprints that a node may hold before it is split, the number of splits after which tiles take over.
LEAF, DEPTH = 4096, 4
#: Children of an inner node, and queries searched at once.
FAN, QUERIES = 8, 256
#: Shingles hashed at once, to bound memory on very long texts.
CHUNK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """A text's words: A-Z is lowered, and white space is ASCII's."""
    return (text or "").encode().lower().split()


def shingle_hashes(parts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Hashes of shingles, words joined by a space, repeats counted; of fewer words, one hash of them all."""
    n = max(len(parts) - words + 1, 1) if parts else 0
    out = np.empty(n, np.uint64)
    for start in range(0, n, CHUNK):
        part = parts[start : start + CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
        end = min(start + CHUNK, n)
        out[start:end] = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, end - start)
    return out


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes: a bit is set if it is set in over half of them; 0 for none."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text; 0 for a NULL one and for one without words."""
    return fold(shingle_hashes(words_of(text), words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and the fingerprint as a signed long, for each row."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Places in the order of the reflected Gray code: the prefix parity of the bits."""
    x = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """The hierarchy over one node's fingerprints; rows are numbered by Gray rank."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        #: From the leaves up: (bits that a group agrees in, those bits' values).
        self.levels = [(np.full(len(fps), ~np.uint64(0)), self.fps)]
        all_, any_ = self.fps, self.fps
        while len(all_) > FAN:
            starts = np.arange(0, len(all_), FAN)
            all_, any_ = np.bitwise_and.reduceat(all_, starts), np.bitwise_or.reduceat(any_, starts)
            self.levels.append((~(all_ ^ any_), all_))

    def links(self, low: int, high: int, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, other, differences) of pairs with at most so many, query in [low, high) and other after it."""
        mask, value = self.levels[-1]
        q = np.repeat(np.arange(low, high), len(mask))
        node = np.tile(np.arange(len(mask)), high - low)
        apart = np.bitwise_count((self.fps[q] ^ value[node]) & mask[node])
        for depth in range(len(self.levels) - 1, -1, -1):
            span = FAN**depth
            near = (apart <= most) & ((node + 1) * span > q + 1)
            q, node, apart = q[near], node[near], apart[near]
            if depth:
                parent, (mask, value) = self.levels[depth][0], self.levels[depth - 1]
                child = node[:, None] * FAN + np.arange(FAN)
                there = child < len(mask)
                q, apart, fixed = (np.broadcast_to(x[:, None], child.shape)[there] for x in (q, apart, parent[node]))
                node = child[there]
                apart = apart + np.bitwise_count((self.fps[q] ^ value[node]) & mask[node] & ~fixed)
        return q, node, apart


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the classes of a[i] and b[i]; a label is the smallest row of its class."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, higher := label[label]):
            label[:] = higher


def forest(fps: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, representative) that connect what close pairs among fps connect."""
    index = GrayIndex(fps)
    label = np.arange(len(fps))
    for low in range(0, len(fps), QUERIES):
        _join(label, *index.links(low, min(low + QUERIES, len(fps)), most)[:2])
    moved = label != np.arange(len(fps))
    return index.fps[moved], index.fps[label[moved]]


def _blocks(free: int, parts: int) -> list[int]:
    """The free bits, cut into runs of nearly equal size, as masks."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(items: DataFrame, rest: list[str], masks: list[int], ways: int) -> tuple[DataFrame, list[int]]:
    """Rows (mask, key, rest, was) of the next depth. The list of masks depends on the depth alone."""
    below = {m: [m | b for b in _blocks(~m & (1 << 64) - 1, ways)] for m in masks}
    table = items.sparkSession.createDataFrame([(_signed(m), [_signed(k) for k in kids]) for m, kids in below.items()], "mask long, kids array<long>")
    # A row for each mask: ways to the power of the depth, whatever the input.
    out = items.join(F.broadcast(table), "mask").select(F.explode("kids").alias("mask"), *rest, "was")
    out = out.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), *rest, "was")
    if len(masks) > 1:  # a node may be reached from several
        out = out.groupBy("mask", "key", *rest).agg(F.max("was").alias("was"))
    return out, sorted({k for v in below.values() for k in v})


def _tiles(items: DataFrame, rest: list[str], leaf: int) -> DataFrame:
    """Rows (mask, key, x, y, rest): nodes in parts of half a leaf, every two of which are a tile."""
    tiles = F.ceil(F.col("count") / F.lit(leaf // 2)).cast("long")
    tile = F.pmod(F.xxhash64(*rest), tiles)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda other: F.struct(F.least(other, tile).alias("x"), F.greatest(other, tile).alias("y")))
    return items.select("mask", "key", *rest, F.explode(pairs).alias("p")).select("mask", "key", "p.x", "p.y", *rest)


def nodes(items: DataFrame, ways: int, leaf: int = LEAF, depth: int = DEPTH) -> list[tuple[DataFrame, list[str]]]:
    """Tables of nodes of bounded size, each with the columns that name a node. items: fp and other columns, distinct rows.

    Two fingerprints that differ in fewer bits than ways meet in a node; others, in so far as a block of theirs agrees. A
    node of more than leaf rows is split again. One that holds over a quarter of the node above it is a cluster that
    bits don't split; such nodes, and those that are left after depth splits, are cut into tiles. Nodes of one row are
    left out.
    """
    found: list[tuple[DataFrame, list[str]]] = []
    rest = items.columns
    masks, items = [0], items.select(F.lit(0).cast("long").alias("mask"), *rest, F.lit(1 << 62).cast("long").alias("was"))
    for at in range(1, depth + 1):
        items, masks = _split(items, rest, masks, ways)
        items = materialize(items, "simhash-items") if at > 1 else items
        sizes = items.groupBy("mask", "key").count().where("count > 1").select(F.col("mask").alias("m"), F.col("key").alias("k"), "count")
        met = materialize(items.join(sizes, (F.col("mask") == F.col("m")) & (F.col("key") == F.col("k"))).select("mask", "key", *rest, "was", "count"), "simhash-met")
        large, dense = F.col("count") > leaf, (F.col("count") * 4 > F.col("was")) | F.lit(at == depth)
        found.append((met.where(~large).select("mask", "key", *rest), ["mask", "key"]))
        more = met.where(large).agg(F.max(dense).alias("dense"), F.max(~dense).alias("rest")).first()
        if more["dense"]:
            found.append((_tiles(met.where(large & dense), rest, leaf), ["mask", "key", "x", "y"]))
        if not more["rest"]:
            break
        items = met.where(large & ~dense).select("mask", *rest, F.col("count").alias("was"))
    return found


Solver = Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[list[np.ndarray]]]


def each_node(items: DataFrame, keys: list[str], solve: Solver, schema: str) -> DataFrame:
    """Rows of longs that solve gives from a table of whole nodes, their first rows and the rows after their last ones.

    A node's rows are bounded, and lie side by side in one task.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = items.repartition(parts, *keys).sortWithinPartitions(*keys)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def whole(tab: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal left
            cols = [tab.column(k).to_numpy() for k in keys]
            new = np.ones(tab.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], tab.num_rows)
            left = None
            if not last:  # the last node may go on in the next batch
                left, starts, ends = tab.slice(starts[-1]), starts[:-1], ends[:-1]
            for out in solve(tab, starts, ends):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=names)

        for batch in batches:
            tab = pa.Table.from_batches([batch])
            tab = pa.concat_tables([left, tab]).combine_chunks() if left is not None else tab
            if tab.num_rows:
                yield from whole(tab, False)
        if left is not None and left.num_rows:
            yield from whole(left.combine_chunks(), True)

    return items.mapInArrow(run, schema)


def small_links(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (first, second, difference) of close pairs in nodes that one inner group holds, all such nodes at once."""
    sizes = ends - starts
    small = sizes <= FAN
    at = np.concatenate([np.arange(s, e) for s, e in zip(starts[small], ends[small], strict=True)] or [np.empty(0, int)]).astype(int)
    until = np.repeat(ends[small], sizes[small])
    found = []
    for lag in range(1, FAN):
        at, until = at[at + lag < until], until[at + lag < until]
        apart = np.bitwise_count(fps[at] ^ fps[at + lag])
        near = apart <= most
        found.append((at[near], at[near] + lag, apart[near]))
    first, second, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    return first, second, apart


def close_links(fps: DataFrame, most: int = MOST, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Edges (a, b) that connect what pairs of fingerprints with at most so many differences connect. fps: distinct fp."""

    def solve(tab: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[list[np.ndarray]]:
        own = tab.column("fp").to_numpy().view(np.uint64)
        first, second, _ = small_links(own, starts, ends, most)
        a, b = [own[first]], [own[second]]
        for s, e in zip(starts, ends, strict=True):
            if e - s > FAN:
                x, y = forest(own[s:e].copy(), most)
                a.append(x)
                b.append(y)
        yield [np.concatenate(v).view(np.int64) for v in (a, b)]

    out: DataFrame | None = None
    for items, keys in nodes(fps.select("fp"), most + 1, leaf, depth):
        part = each_node(items, keys, solve, "a long, b long")
        out = part if out is None else out.union(part)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of docs.

    component_id is the smallest doc_id that is reachable over links; equal fingerprints, zero included, are linked. NULL
    texts have fingerprint zero. A row with a NULL doc_id has its class's component_id, NULL if no row there has an id. Rows
    that repeat a doc_id each give a row. Exact copies meet as one fingerprint before anything is compared, whatever their
    number. Other columns are ignored; an empty table gives no rows.
    """
    own = materialize(fingerprints(docs, words), "simhash")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = materialize(connected_components(close_links(own.select("fp").distinct(), most), "a", "b"), "simhash-roots")
    by_root = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = by_root.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = by_root.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    hex_ = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return own.join(named, F.col("fp") == F.col("f")).select("doc_id", hex_.alias("fingerprint"), "component_id")
