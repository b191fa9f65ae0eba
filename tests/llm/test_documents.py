"""Fingerprints, decontamination, packing, token counts and chat formatting."""

from __future__ import annotations

import hashlib
import random
import weakref
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.llm import chat, common, decontaminate, fingerprint, packing, queries, tokencount

# Fingerprints


def test_fingerprint_query(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op4_document_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.digest(text), fingerprint.digest(changed))
        assert r.near_next == fingerprint.likeness(r.fingerprint, got[docs[(k + 1) % len(docs)][0]].fingerprint)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.98


def slow_counts(data):
    out = np.zeros(fingerprint.BUCKETS, np.int64)
    a, b, c = fingerprint.MIX
    for i in range(len(data) - fingerprint.OFFSETS[-1]):
        x, y, z = (data[i + o] for o in fingerprint.OFFSETS)
        h = (x * a + y * b) % 2**32
        h ^= h >> 15
        h = (h + z * c) * 0x2C1B3C6D % 2**32
        out[h >> 21] += 1
    return out


def test_triplets_are_counted_as_by_hand_and_across_chunks(monkeypatch):
    data = bytes(random.Random(1).randrange(256) for _ in range(3000))
    want = slow_counts(data)
    assert (fingerprint._counts(data) == want).all()
    monkeypatch.setattr(fingerprint, "CHUNK", 100)
    assert (fingerprint._counts(data) == want).all()


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_likeness_is_bounded_and_even(a, b):
    x, y = fingerprint.digest(a), fingerprint.digest(b)
    assert 0 <= fingerprint.likeness(x, y) == fingerprint.likeness(y, x) <= 1 and fingerprint.likeness(x, x) == 1


@pytest.mark.parametrize("buckets", [1, 3, 7])
def test_successors_in_odd_tables(spark, buckets):
    rows = [(5, "five"), (5, "also five"), (None, "none"), (2, None), (9, "nine"), (-4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as next_text", "2 as to")
    got = {(r.doc_id, r.text): r.next_text for r in fingerprint.with_next_text(df, buckets).collect()}
    assert got == {(9, "nine"): "also five", (5, "also five"): "five", (5, "five"): "", (2, ""): "x", (-4, "x"): "none", (None, "none"): "nine"}
    assert fingerprint.fingerprint_documents(df.limit(0)).collect() == []
    alone = fingerprint.fingerprint_documents(df.filter("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


@pytest.mark.parametrize("buckets", [4, 12, 51])
def test_successors_over_many_ranges(spark, buckets):
    df = spark.range(1000).selectExpr("id * 3 as doc_id", "cast(id as string) as text").repartition(4)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next_text(df, buckets).collect()}
    assert got == {3 * i: str(i - 1 if i else 999) for i in range(1000)}


# Decontamination


def slow_tiles(a, t, m):
    """Greedy string tiling as it is defined, word by word."""
    free_a, free_t, out = [True] * len(a), [True] * len(t), []
    m = min(m, len(a))
    while True:
        best, pairs = 0, []
        for i in range(len(a)):
            for j in range(len(t)):
                k = 0
                while i + k < len(a) and j + k < len(t) and free_a[i + k] and free_t[j + k] and a[i + k] == t[j + k]:
                    k += 1
                if k > best:
                    best, pairs = k, [(i, j)]
                elif k == best and k:
                    pairs.append((i, j))
        if not best or best < m:
            return out
        for i, j in pairs:
            if all(free_a[i : i + best]) and all(free_t[j : j + best]):
                free_a[i : i + best] = free_t[j : j + best] = [False] * best
                out.append((i, j, best))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=18), st.lists(st.integers(1, 3), max_size=25), st.integers(1, 4))
def test_tiles_are_those_of_the_definition(a, t, m):
    assert decontaminate.tiles(a, t, m) == slow_tiles(a, t, m)


def test_decontamination_query(spark, sf_dir):
    docs = [(r.doc_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = set()
    for d, words in docs:
        seeds = {tuple(words[i : i + 5]) for i in range(len(words))}
        for b, own in items:
            if any(tuple(own[i : i + 5]) in seeds for i in range(len(own) - 4)) and sum(x[2] for x in decontaminate.tiles(*numbered(own, words))) >= 0.8 * len(own):
                want.add((d, b))
    got = {(r.doc_id, r.item_id) for r in queries.op5_benchmark_decontamination(spark, sf_dir).collect()}
    assert got == want and want


def numbered(*texts):
    ids = {}
    return [[ids.setdefault(w, len(ids)) for w in t] for t in texts]


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_reordered_edited_and_clean_texts(spark):
    w = ITEM.split()
    texts = {
        1: f"before, {ITEM.upper()}! after",
        2: " ".join(["x", *w[10:], "y", *w[:10], "z"]),
        3: " ".join(w[:9]),
        4: " ".join(w[:4] + ["one"] + w[5:]),
        5: " ".join(a for pair in zip(w, w[::-1], strict=True) for a in pair),
        6: None,
        7: "",
        8: "Alpha-beta-gamma-delta epsilon " + " ".join(w[5:]),
        9: "only two",
    }
    docs = spark.createDataFrame([*texts.items(), (1, texts[1]), (None, ITEM)], "doc_id long, text string").selectExpr("*", "0 as item_id", "0 as coverage")
    bench = spark.createDataFrame([(0, ITEM), (0, ITEM), (1, None), (2, ""), (3, "only two"), (None, "x y z")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (2, 0), (8, 0), (9, 3), (None, 0)], key=str)
    blocks = decontaminate.contaminated(docs, bench, block_words=5)
    assert sorted(((r.doc_id, r.item_id) for r in blocks.collect()), key=str) == got
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench, block_words=5).collect()) == [3, 4, 5, 6, 7]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


# Packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def check_packing(pieces, ids):
    """pieces hold each id once, in sequences without gaps, nearly all full."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
    assert set(of_doc) == set(ids)
    for doc, own in of_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids[doc]))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[doc])
    padding = 0
    for own in of_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding == 0


def test_packing_query(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    check_packing(queries.op7_packing(spark, sf_dir).collect(), ids)


ODD = ["", " ", "a", "It's we're I'LL", "ÉÀß ſt İI", "<|endoftext|>", "x<|startoftext|>y <|", "漢字かな", "á ́b", "12٣", "\t\r\x1c\xa0", "e" * 5000, "don't\nstop", "µª", "ŉ", "_-_ --"]


def test_a_worker_keeps_its_tokenizer_until_another_operators_task():
    path = public_tokenizers.path("word_bpe_49k.json")
    left = weakref.ref(packing.tokenizer_of(path).pre_tokens)
    assert packing.tokenizer_of(path).pre_tokens is left()
    common.kept("another", dict)
    assert left() is None
    made = packing.tokenizer_of(path)
    assert made.pre_tokens["cat"] and packing.tokenizer_of(path) is made
    common.release()
    assert packing.tokenizer_of(path) is not made


def test_word_tokenizer_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER)
    rng = random.Random(2)
    alphabet = "aB'sTé İßÉ \t\n\x1c\u0107漢1２٣_-.,!ªºµſŉ"
    texts = ODD + ["".join(rng.choice([rng.choice(alphabet), "<|endoftext|>", "'s", " "]) for _ in range(rng.randint(0, 15))) for _ in range(3000)]
    for text in texts:
        assert list(np.frombuffer(next(w.encode([text])), "<u4")) == t.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(0, 60))
def test_best_fill_is_the_best(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    got = packing.best_fill(sorted(counts), counts.get, room)
    assert all(n <= counts[length] for length, n in got)
    assert sum(length * n for length, n in got) == max(s for s in sums if s <= room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=60))
def test_packer_fills_windows(lengths):
    p = packing.Packer(0, 64)
    for i, n in enumerate(lengths):
        p.add(i, np.arange(n, dtype="<u4").tobytes())
    p.finish()
    sizes = defaultdict(int)
    for piece in p.taken():
        sizes[piece[5]] += piece[2]
    assert sum(sizes.values()) == sum(lengths)
    assert sum(s != 64 for s in sizes.values()) <= 6 and all(s & (s - 1) == 0 for s in sizes.values())


def test_pools_are_packed_down(monkeypatch):
    monkeypatch.setattr(packing, "POOL", 20)
    p = packing.Packer(0)
    for i in range(500):
        p.add(i, bytes(4 * (1 + i * 37 % 900)))
        assert p.size <= 20
    p.finish()
    assert sum(x[2] for x in p.taken()) == sum(1 + i * 37 % 900 for i in range(500))


def test_packing_odd_tables(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "some text"), (3, "word " * 6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as sequence_id").coalesce(1)
    got = packing.pack_documents(df, TOKENIZER).collect()
    assert sum(r.length for r in got if r.start == 0 and r.doc_id == 1) == 2 and sum(r.length for r in got if r.doc_id == 3) == 6001
    assert packing.pack_documents(df.limit(0), TOKENIZER).collect() == []


# Token counts


def slow_count(word, scores):
    """Forward scores of one word, without sharing."""
    best, tokens = [0.0], [0]
    for at in range(1, len(word) + 1):
        high, n = best[at - 1] + tokencount.UNKNOWN, tokens[at - 1] + len(word[at - 1].encode())
        for begin in range(at - 1, -1, -1):
            own = scores.get(word[begin:at])
            if own is not None and best[begin] + own > high:
                high, n = best[begin] + own, tokens[begin] + 1
        best.append(high)
        tokens.append(n)
    return tokens[-1]


@pytest.fixture(scope="module")
def scores():
    return tokencount.zipf_scores(tokencount.load_pieces())


def test_token_count_query(spark, sf_dir, scores):
    from functools import cache

    one = cache(lambda w: slow_count(tokencount.MARK + w, scores))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op9_token_counts(spark, sf_dir).collect()}
    assert got == {i: (len(t.split()), sum(map(one, t.split()))) for i, t in docs.items()}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abcé漢", min_size=1, max_size=8), max_size=20))
def test_shared_prefixes_change_no_count(words):
    scores = tokencount.zipf_scores(["a", "ab", "bc", "abc", "cab", "é", "bb"])
    trie = tokencount.Trie(scores)
    assert [trie.count(w) for w in words] == [slow_count(w, scores) for w in words]


def test_prefixes_are_scored_once():
    trie = tokencount.Trie(tokencount.zipf_scores(["a", "b"]))
    trie.count("abab")
    n = len(trie.best)
    trie.count("abaa")
    assert len(trie.best) == n + 1


def test_token_counts_of_odd_tables(spark, monkeypatch):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "a b"), (None, "漢" * 20_000)], "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = {(r.doc_id, r.n_words): r.n_tokens for r in tokencount.count_tokens(df).collect()}
    assert got[(1, 0)] == got[(2, 0)] == 0 and got[(None, 1)] > 0 and len(got) == 4
    assert tokencount.count_tokens(df.limit(0)).collect() == []


# Chat


hostile = st.lists(st.sampled_from([*"ab\n\\<|>l", "<|im_start|>", "<|im_end|>", "é", "n"]), max_size=20).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "", "<|im_end|>"]), hostile), max_size=5))
def test_formatting_comes_back(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)


def test_chat_query_by_hand(spark, sf_dir):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", queries.HOSTILE), (1, "assistant", queries.HOSTILE)]
    got = {r.conv_id: r for r in queries.op10_chat_formatting(spark, sf_dir).collect()}
    assert set(got) == set(turns)
    for conv, own in turns.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in own)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def slow_paths(nodes):
    """Root-to-leaf paths of one conversation: {leaf: [nodes]}."""
    parent = {n: p for n, p in nodes}
    inner = {p for _, p in nodes if p in parent}
    out = {}
    for leaf in parent.keys() - inner:
        path = [leaf]
        while parent[path[-1]] in parent:
            path.append(parent[path[-1]])
        out[leaf] = path[::-1]
    return out


def test_paths_of_trees(spark):
    rng = random.Random(4)
    nodes = []
    for conv in (1, 2, None):
        for n in range(40):
            parent = None if n == 0 or rng.random() < 0.1 else rng.randrange(n)
            nodes.append((conv, n, parent, rng.choice(["user", "assistant"]), f"t{n}", rng.choice([None, 1.0, 2.0])))
    nodes.append((1, 99, 77, "user", "orphan", 0.0))
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r.conv_id, r.leaf): [t.text for t in r.turns] for r in chat.reply_paths(df, 0).collect()}
    text = {(c, n): t for c, n, _, _, t, _ in nodes}
    want = {(c, leaf): [text[(c, n)] for n in path] for c in (1, 2, None) for leaf, path in slow_paths([(n, p) for k, n, p, *_ in nodes if k == c]).items()}
    assert got == want
    best = chat.reply_paths(df, 2).collect()
    assert {r.branch for r in best} == {1, 2} and len(best) == 6
    points = {(c, n): s or 0.0 for c, n, _, _, _, s in nodes}
    for conv in (1, 2, None):
        ranked = sorted(((-np.mean([points[(conv, n)] for n in path]), leaf) for leaf, path in slow_paths([(n, p) for k, n, p, *_ in nodes if k == conv]).items()))
        assert [r.leaf for r in sorted((r for r in best if r.conv_id == conv), key=lambda r: r.branch)] == [leaf for _, leaf in ranked[:2]]


def test_cycles_have_no_path(spark):
    nodes = [(1, n, p, "user", f"t{n}", 0.0) for n, p in ((1, 2), (2, 3), (3, 1), (4, 2), (5, 5), (6, None), (7, 6))]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    assert [(r.leaf, [t.text for t in r.turns]) for r in chat.reply_paths(df, 0).collect()] == [(7, ["t6", "t7"])]


def test_chat_of_odd_tables(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as score")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.linear_tree(df))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[None].n_turns == 1
    assert chat.format_conversations(chat.linear_tree(df.limit(0))).collect() == []
    long = spark.createDataFrame([(1, i, "user", "x") for i in range(300)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(chat.linear_tree(long))).first().n_turns == 300
