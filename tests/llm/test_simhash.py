from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from weirflow.llm import queries, simhash
from weirflow.llm.components import connected_components


def slow_fingerprint(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_components(fps):
    return classes(fps, ((a, b) for a, b in combinations(fps, 2) if bin(a ^ b).count("1") <= 3))


def test_query_against_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    fps = {i: slow_fingerprint(t) for i, t in docs}
    roots = slow_components(sorted(set(fps.values())))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", least[roots[f]]) for i, f in fps.items()}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "A b C d", "É é É", "x " * 200_000, "\x0b\x0c\x1cword"])
def test_fingerprints_of_odd_texts(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def ball(n, seed=3):
    rng = np.random.default_rng(seed)
    center = int(rng.integers(0, 2**63))
    near = {center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(n)}
    return sorted(near | {int(x) for x in rng.integers(0, 2**63, n // 2)})


def test_the_index_prunes_no_link():
    fps = np.array(ball(900), np.uint64)
    index = simhash.GrayIndex(fps)
    a, b, apart = index.links(0, len(fps))
    assert (apart == np.bitwise_count(index.fps[a] ^ index.fps[b])).all()
    got = {(int(index.fps[x]), int(index.fps[y])) for x, y in zip(a, b, strict=True)}
    want = {(x, y) for x, y in combinations(index.fps.tolist(), 2) if bin(x ^ y).count("1") <= 3}
    assert got == want
    assert (np.diff(simhash.gray_rank(index.fps).astype(object)) > 0).all()


@pytest.mark.parametrize(("leaf", "depth"), [(4096, 4), (64, 1), (100, 3)])
def test_large_groups_are_split_and_lose_no_link(spark, leaf, depth):
    fps = ball(700)
    df = spark.createDataFrame([(int(x),) for x in np.array(fps, np.uint64).view(np.int64)], "fp long")
    edges = simhash.close_links(df, leaf=leaf, depth=depth).collect()
    want = slow_components(fps)
    unsigned = [(r.a % 2**64, r.b % 2**64) for r in edges]
    assert classes(fps, unsigned) == want
    assert len(edges) < 4 ** (depth + 1) * len(fps)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (0, 1)], "x long, y long")
    got = {r.node: r.root for r in connected_components(edges, "x", "y").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert connected_components(edges.limit(0), "x", "y").collect() == []


def test_odd_tables(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, None), (8, ""), (None, "other words stand here now"), (7, "quite different text again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as node")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_text = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    zero = "0" * 16
    assert by_text[(5, f"{slow_fingerprint('a b c d'):016x}")] == 3 and by_text[(9, zero)] == by_text[(8, zero)] == 8
    assert {r.component_id for r in got} == {3, 8, 7, None}
    assert simhash.near_duplicates(df.limit(0)).collect() == []
