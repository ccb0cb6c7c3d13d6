"""The prefix trie of conversations against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from made_texts import prose

from tablemine.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, b int, ids string, first long, up string"


def of_c(c):  # the remainder takes the sign of c, as in SQL
    return c - (abs(c) % 100) * (1 if c >= 0 else -1)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if c is not None else 0
        made[c] = (own.get(of_c(c), [])[:h] if c is not None else []) + t[h:]
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids, leaves, saved = (defaultdict(int) for _ in range(3))
    for seq in members:
        if seq:
            kids[seq[:-1]] += 1
    for seq, m in members.items():
        for k in range(len(seq) + 1):
            leaves[seq[:k]] += seq not in kids
            saved[seq[:k]] += (len(m) - 1) * len(seq[-1][1]) if seq else 0
    least = lambda m: min((c for c in m if c is not None), default=None)
    out = []
    for seq, m in members.items():
        ends = sorted((c for c in m if len(made[c]) == len(seq)), key=lambda c: (c is None, c or 0))
        text = ",".join("NULL" if c is None else str(c) for c in ends)
        out.append((least(m), len(seq), least(members[seq[:-1]]) if seq else None, len(m), kids[seq], leaves[seq], saved[seq], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in conversation_trie.conversation_trie(df).collect()), key=str)


def log(seed, n, most, kinds):
    rng = random.Random(seed)
    turns = [("user" if k % 2 else "assistant", prose(rng, 3)) for k in range(kinds)]
    rows = [(c, i, *rng.choice(turns)) for c in range(n) for i in range(rng.randrange(1, most))]
    rows += [(c + n, i, *turns[i % kinds]) for c in range(40) for i in range(5 + c % 3)]  # the same again and again
    return rows


AWKWARD = [
    (None, 0, "user", "a"), (None, None, None, None), (7, 0, None, None), (7, 0, None, None), (7, 1, "user", ""), (8, None, "user", "b"), (8, None, "user", "a"), (8, 5, "user", "a" * 70000),
    (8, 5, "user", "a" * 70000), (-5, 0, "x", "é日"), (-105, 0, "x", "é日"), (-105, 1, "x", "é日"), (100, 3, "user", "z"), (101, 3, "user", "z"), (203, 0, "user", "z"), (999999999999, 0, "", ""),
]


@pytest.mark.parametrize("segment, shard, piece", [(256, 200_000, 50_000), (256, 40, 3), (4, 30, 2), (1, 25, 1)])
def test_trie(spark, segment, shard, piece, monkeypatch):
    for k, v in (("SEGMENT", segment), ("SHARD_TURNS", shard), ("PIECE_IDS", piece)):
        monkeypatch.setattr(conversation_trie, k, v)
    rows = log(segment, 120, 9, 4) + AWKWARD
    assert got(spark, rows) == brute(rows)


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", 100)
    rows = [(c, i, "user", str(i if i < 600 or c else -i)) for c in (0, 1, 2, 250) for i in range(700 + 10 * c % 90)]
    assert got(spark, rows) == brute(rows)


def test_hot_first_turn_and_copies(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", 60)
    rows = [(c, i, "user", "hello" if i == 0 else str((c % 37) * i)) for c in range(600) for i in range(4 + c % 3)]
    assert got(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert got(spark, []) == []


def test_medians_make_low_trees():
    assert sorted(conversation_trie.medians(1000)) == list(range(1000))
    tree = conversation_trie.TernaryTree()
    for i in conversation_trie.medians(1023):
        tree.insert([0, i], 1, i)
    height, open_ = 0, [(tree.equal[0], 1)]
    while open_:
        node, h = open_.pop()
        if node >= 0:
            height = max(height, h)
            open_ += [(tree.low[node], h + 1), (tree.high[node], h + 1)]
    assert height == 10 and tree.members[0] == 1023
