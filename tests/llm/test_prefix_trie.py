"""The conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lurescan.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, n int, ends string, shard string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}\0{role}\0{text}".encode()).digest()[:16]


def expected(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        lead = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = own.get(lead, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, cs in members.items():
        cost = (len(cs) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += cost
    out = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if tuple(paths[c]) == k)
        out.append((
            min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], leaves[k], saved[k],
            hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "p", 1, "e", "s") for r in rows], SCHEMA)
    got = prefix_trie.trie(prefix_trie.rebuilt(df))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == expected(rows)


def random_rows(seed, convs=120, words=3):
    rng = random.Random(seed)
    texts = ["", "é", "ab", None, "long text " * 5][:words + 1]
    rows = []
    for c in range(-10, convs):
        if rng.random() < 0.85:
            for t in range(rng.randint(1, 12)):
                rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [64, 2])
def test_random_conversations(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", turns)
    check(spark, random_rows(1))
    check(spark, random_rows(2, convs=300, words=1))


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 3)
    check(spark, random_rows(3))


def test_nothing_and_rows_without_conversation(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "a")])
    check(spark, [(3, 1, "user", "a"), (None, 1, "user", "a")])


def test_repeated_rows_are_repeated_turns(spark):
    check(spark, [(5, 1, "user", "a")] * 12 + [(6, 1, "user", "a")] * 10)


def test_a_conversation_that_a_third_shares(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_CHUNK", 16)
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(9)]
    rows += [(c, t, "user", f"{c} {t}") for c in range(1000, 1300) for t in range(3)]
    check(spark, rows)


def test_a_long_conversation(spark):
    rows = [(c, t, "user", f"t{t % 7}" if t < 2990 else f"{c}") for c in (1, 2) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.depth, r.n_convs): r for r in prefix_trie.trie(prefix_trie.rebuilt(df)).collect()}
    h1, h2 = (zlib.crc32(str(c).encode()) % 9 for c in (1, 2))
    assert max(d for d, _ in got) == 3000 - min(h1, h2) and got[(0, 2)].n_leaves == 2


def test_role_and_text_do_not_run_together(spark):
    check(spark, [(1, t, "ab", "c") for t in range(12)] + [(2, t, "a", "bc") for t in range(12)])
