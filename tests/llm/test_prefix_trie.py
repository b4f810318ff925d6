"""The prefix trie against plain dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from tallyframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    by: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def rebuilt(plain):
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = plain.get(base, [])[:h] + own[h:]
    return out


def plain_trie(seqs):
    members: dict = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words(p)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))) for p, m in members.items()}
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
        for p, m in members.items()
    )


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for c in [*range(45), -3, -20, -27, 400]:
        n = rng.choice([1, 1, 2, 3, 5, 8, 13])
        for t in range(n):
            out.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no  no", "", " a b c\n"])))
    out += [(c, t, "user", "the same") for c in range(100, 140) for t in range(6)]  # a group of copies
    out += [(7, None, None, None), (7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (8, -5, "a", "x" * 100_000 + " y"), (None, 1, "user", "nobody's")]
    out += [(500, t, "user", rng.choice("ab")) for t in range(70)] + [(501, t, "user", "a" if t < 40 else "c") for t in range(65)]
    return out


@pytest.mark.parametrize("bits", [10, 2])
def test_nodes_equal_dictionaries(spark, rows, bits, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH_BITS", bits)
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "2 as name", "3 as conv", "4 as depth", "5 as words").repartition(7)
    assert found(prefix_trie.rebuilt_trie(turns)) == plain_trie(rebuilt(sequences(rows)))


def test_conversations_as_they_are_and_small_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_IN_A_PIECE", 3)
    turns = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.conversation_trie(turns)) == plain_trie(sequences(rows))


def test_a_conversation_that_crosses_partitions_keeps_its_order(spark):
    rows = [(1, t, "user", str(t)) for t in range(300)] + [(2, t, "user", str(t)) for t in range(3)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert found(prefix_trie.conversation_trie(turns)) == plain_trie(sequences(rows))


def test_empty_and_turnless(spark):
    assert found(prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA))) == []
    rows = [(c, 0, "user", "hi") for c in (21, 22, 23)]  # their base is absent; with h > 0 nothing is left of them
    assert found(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rebuilt(sequences(rows)))
