"""Awkward inputs and plain references that the tests of this folder share."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"long{i % 977}" for i in range(60_000))
SAME = "One line that repeats in many documents.\nand its second line, also repeated"

#: (doc_id, text): nulls, blanks, ties, repeated rows, very long texts, odd characters.
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (3, "Alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"),
    (4, None), (5, ""), (6, "   \t\n "), (7, SAME), (8, SAME), (9, SAME + "\n\nthird"), (10, "x"), (11, LONG),
    (12, LONG + " end"), (13, "Ünïcödé \U0001F600 line number one\n  ÜNÏCÖDÉ \U0001F600 line number one\r\n<|endoftext|> a"),
    (14, "  \U0001F600ünïcödé line that is shared \x0b"), (15, "\U0001F600ÜNïcödé line that is shared"),
    (16, "\U0001F600ünïcödé line that is shared"), (None, "a text without an id that is long enough"),
    (None, SAME), (17, "words\x1cwith\x85odd\xa0blanks " * 3), (18, "\0 nul \0"), (19, "1234 5678 !!! ###"),
]
CLASHING = ["_doc", "_text", "_key", "_marks", "_hash", "_node", "_set", "_slice", "n_lines", "n_dropped", "score",
            "predicted", "lang_pred", "tokens", "size", "shard", "slot", "piece", "length", "n", "cell", "kept",
            "component_id", "text_hash", "_copies", "rate", "Rank"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"`{c}` string" for c in CLASHING)


def awkward(spark, rows=None):
    """The rows with every other column null or clashing."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame(
        [(i, t, None if n % 3 else "en", None, None, *[None if n % 2 else "clash"] * len(CLASHING))
         for n, (i, t) in enumerate(rows)], SCHEMA)


def shingles(text, words):
    found = WORD.findall((text or "").translate(LOWER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1)))


def components(rows, words, percent=80):
    """Smallest id reachable for each (id, text), by comparing everything that shares a shingle."""
    sets, inverted = [], defaultdict(list)
    for _, text in rows:
        sets.append(shingles(text, words))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for at, own in enumerate(sets):
        for other in {o for s in own for o in inverted[s]}:
            common = len(own & sets[other])
            if 100 * common >= percent * (len(own) + len(sets[other]) - common):
                a, b = find(at), find(other)
                parent[max(a, b)] = min(a, b)
        for s in own:
            inverted[s].append(at)
    least = {}
    for at, (key, _) in enumerate(rows):
        root = find(at)
        least[root] = min(least.get(root, key), key)
    return [(least[find(at)], len(sets[at])) for at in range(len(rows))]
