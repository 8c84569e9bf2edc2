"""The prefix trie and its contraction against plain recursion."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from tallyline.llm import contraction, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, words string, place int"


def plain_sums(tree):
    children = defaultdict(list)
    for node, (parent, *_) in tree.items():
        children[parent].append(node)
    out, order, stack = {}, [], list(children[None])
    while stack:
        order.append(stack.pop())
        stack += children[order[-1]]
    for node in reversed(order):
        out[node] = tuple(w + sum(out[c][i] for c in children[node]) for i, w in enumerate(tree[node][1:]))
    return out


def contracted(spark, tree):
    rows = [(node, *rest) for node, rest in tree.items()]
    found = contraction.subtree_sums(spark.createDataFrame(rows, "node long, parent long, x long, y long"), ["x", "y"])
    return {r.node: (r.x, r.y) for r in found.collect()}


def test_contraction_of_chains_stars_combs_and_forests(spark):
    rng = random.Random(4)
    tree = {0: (None, 1, 5)}
    for i in range(1, 60):
        tree[i] = (rng.randrange(max(0, i - 4), i), rng.randrange(9), i)  # mixed
    tree |= {100: (None, 0, 1)} | {100 + i: (100, i, -i) for i in range(1, 50)}  # a star
    tree |= {200: (None, 1, 1)} | {200 + i: (199 + i, 1, i) for i in range(1, 70)}  # a chain
    tree |= {300: (None, 1, 1)} | {300 + i: (299 + i, 1, i) for i in range(1, 30)} | {400 + i: (300 + i, 7, 0) for i in range(30)}  # a comb
    tree |= {500: (None, 3, 4)}  # alone
    assert contracted(spark, tree) == plain_sums(tree)
    assert contracted(spark, {}) == {}


def test_contraction_refuses_what_is_no_tree(spark):
    with pytest.raises(ValueError):
        contracted(spark, {1: (2, 1, 1), 2: (1, 1, 1)})


def plain_trie(rows, borrowed):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in turns.items()}
    if borrowed:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        convs = {c: convs.get(c - int(math.fmod(c, 20)), [])[: h[c]] + own[h[c] :] for c, own in convs.items()}
    members = defaultdict(list)
    for c, own in sorted(convs.items()):
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(out[c][4] for c in children[node]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        saved = (len(members[node]) - 1) * words + sum(out[c][5] for c in children[node])
        ends = ",".join(str(c) for c in members[node] if len(convs[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out[node] = (parent, len(members[node]), len(children[node]), None, leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted((members[n][0], len(n), *(v for v in out[n] if v is not None or n == () and v is out[n][0])) if n else (members[n][0], 0, None, *out[n][1:3], *out[n][4:]) for n in out)


def built(spark, rows, borrowed):
    table = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA)
    found = prefix_trie.conversation_trie(table.repartition(3), borrowed)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in found.collect())


def conversations(rng, n):
    rows = []
    for c in range(n):
        for turn in range(rng.choice((1, 2, 3, 5, 8))):
            rows.append((c, turn, rng.choice(("user", "assistant")), rng.choice(("a b", "a  b\n", "c", "", "x y z"))))
    return rows


@pytest.mark.parametrize("borrowed", (False, True))
def test_trie_equals_recursion(spark, borrowed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rng = random.Random(8)
    rows = conversations(rng, 60)
    rows += [(100 + c, t, "user", f"line {t}") for c in range(6) for t in range(3 + 9 * c)]  # each a beginning of the next
    rows += [(200 + c, t, "user", "same text") for c in range(5) for t in range(17)]  # copies
    rows += [(-7, None, None, None), (-7, -3, "user", None), (-20, 1, None, "x"), (None, 1, "user", "left out"), (300, None, "user", "b"), (300, 0, "user", "a")]
    rows += [(301, 1, "r", "again"), (301, 1, "r", "again"), (301, None, "r", "first")]
    rng.shuffle(rows)
    assert built(spark, rows, borrowed) == plain_trie(rows, borrowed)


def test_trie_of_nothing(spark):
    assert built(spark, [], True) == [] == built(spark, [(None, 1, "a", "b")], False)


def test_long_end_lists_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART", 8)
    rows = [(c, 0, "user", "hello you") for c in range(150)]
    assert built(spark, rows, False) == plain_trie(rows, False)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    rows = [(1, t, "user", f"t{t}") for t in range(700)] + [(2, t, "user", f"t{t}") for t in range(650)]
    assert built(spark, rows, False) == plain_trie(rows, False)
