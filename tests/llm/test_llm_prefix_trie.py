"""The trie of conversations against one that is built prefix by prefix."""

import hashlib
import os
import sys
import zlib
from collections import defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare, connect  # noqa: E402
from samples import WORD  # noqa: E402

from tallyloom.llm import prefix_trie, queries  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, _slice string"


def table(spark, rows):
    return spark.createDataFrame([(*r, None if n % 2 else 7, "clash", None) for n, r in enumerate(rows)], SCHEMA)


def brute(rows):
    """Rows of the trie, from lists of turns and nothing else."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        words = len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * words
            leaves[node[:d]] += not children[node]
    return sorted(
        (who[0], len(node), members[node[:-1]][0] if node else None, len(who), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in who if len(rebuilt[c]) == len(node)).encode()).hexdigest())
        for node, who in members.items())


def ours(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


SHORT = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of kind {c % 7 if t > 1 else c % 2}") for c in range(60) for t in range(c % 6)]
AWKWARD = [
    (0, None, None, None), (0, 1, "user", "  \t"), (0, 2, "user", "a b"), (3, 5, "user", "one two three"), (3, 9, None, "four"),
    (21, 1, "user", "only"), (22, 1, "user", "only"), (23, 1, "user", ""), (-5, 0, "user", "below zero"), (-5, 1, "user", "x\x1cy"),
    (-40, 0, "user", "below zero"), (None, 0, "user", "nobody"), (41, 3, "user", "same"), (41, 3, "user", "same"),
    (1 << 40, 0, "user", "far"), (60, 0, "user", "long " * 50_000), (61, 0, "user", "long " * 50_000),
]
# a conversation of many blocks, one that leaves it in a late block, and one that is its beginning
DEEP = [(c, t, "user", f"t {t if t != 150 or c != 81 else 'other'}") for c, n in ((80, 200), (81, 200), (82, 130), (83, 64), (84, 65), (100, 128)) for t in range(n)]


@pytest.mark.parametrize("rows, per_shard", [(SHORT, 4), (AWKWARD, 512), (AWKWARD + [(c + 100, *r) for c, *r in SHORT], 3), (DEEP, 2), (DEEP + SHORT, 512)])
def test_trie_of_awkward_conversations(spark, rows, per_shard):
    """Nulls, repeated rows, long texts, absent and negative bases, many shards, many blocks."""
    assert ours(prefix_trie.conversation_trie(table(spark, rows), per_shard=per_shard)) == brute(rows)


def test_trie_of_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"hot {t}") for c in range(0, 4000, 20) for t in range(3)]
    result = ours(prefix_trie.conversation_trie(table(spark, rows), per_shard=16))
    assert result == brute(rows) and len(result) == 4


def test_trie_of_an_empty_table(spark):
    assert ours(prefix_trie.conversation_trie(table(spark, []))) == []


def test_trie_query_equals_its_sql(spark, sf_dir):
    good, text = compare(spark, connect(sf_dir), queries.QUERIES["op13_prefix_trie"],
                         queries.ORACLE_SQL["op13_prefix_trie"], sf_dir)
    assert good, text
