"""The trie of conversations' prefixes against a brute-force one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.compare import duck, rows
from tests.llm.small import with_sizes
from tickforge.llm import prefixtrie, queries
from tickforge.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, depth int, m string, p string, at int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(made, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in made:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        full[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children, out = defaultdict(list), []
    for node in members:
        if node:
            children[node[:-1]].append(node)

    totals = {}
    for node in sorted(members, key=len, reverse=True):  # deepest first
        value = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[x] for x in children[node]]
        totals[node] = (sum(x[0] for x in below) or 1, value + sum(x[1] for x in below))
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(full[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def frame_of(spark, made):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in made], SCHEMA)


def sample(seed, convs=60, longest=9):
    rng = random.Random(seed)
    made = []
    for c in range(convs):
        for t in range(rng.choice([1, 2, 3, longest])):
            made.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f"])))
    made += [(200, t, "user", "hot") for t in range(40)] + [(c, t, "user", "hot") for c in range(300, 330) for t in range(12)]
    made += [(400, None, "user", "first"), (400, 0, None, None), (400, 0, None, None), (None, 1, "user", "nobody"), (401, 1, "user", "tie b"), (401, 1, "user", "tie a")]
    made += [(-7, 0, "user", "below zero"), (999, 0, "u", "x y"), (999, 0, "u", "x y"), (500, 0, "user", " ".join(["long"] * 50_000))]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize(("piece", "block", "block_turns", "span"), [(64, 1 << 15, 1 << 19, 4096), (3, 5, 1 << 19, 2), (1, 1 << 15, 7, 3), (4, 1, 1, 1)])
def test_equal_to_brute_force(spark, monkeypatch, piece, block, block_turns, span):
    for name, value in (("PIECE", piece), ("SPAN", span)):
        monkeypatch.setattr(prefixtrie, name, value)
    made = sample(piece)
    sizes = {"PIECE": piece, "BLOCK": block, "BLOCK_TURNS": block_turns}
    monkeypatch.setattr(prefixtrie, "_search", with_sizes(prefixtrie, "_search", **sizes))
    assert got(prefixtrie.rebuilt_trie(frame_of(spark, made))) == brute(made)


def test_conversations_as_they_are(spark):
    made = sample(9, 20)
    assert got(prefixtrie.conversation_trie(frame_of(spark, made))) == brute(made, False)


def test_no_conversations(spark):
    assert prefixtrie.rebuilt_trie(frame_of(spark, [(1, 0, "a", "b")]).filter("conv_id = 2")).count() == 0


def test_silent_conversations(spark):
    """Conversations whose every turn is dropped and whose family has no first one are members of the root alone."""
    silent = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    made = [(c, 0, "user", "gone") for c in silent] + [(40, 0, "user", "kept")]
    assert got(prefixtrie.rebuilt_trie(frame_of(spark, made))) == brute(made)


def test_extents_by_scanning():
    rng = np.random.default_rng(3)
    lcp = rng.integers(0, 5, 200)
    lcp[0] = -1
    levels = prefixtrie.sparse_minima(lcp)
    row, depth = np.repeat(np.arange(200), 6), np.tile(np.arange(6), 200)
    first, last = prefixtrie.extents(levels, row, depth)
    for r, d, a, b in zip(row, depth, first, last, strict=True):
        lo = r
        while lo > 0 and lcp[lo] >= d:
            lo -= 1
        hi = r
        while hi + 1 < 200 and lcp[hi + 1] >= d:
            hi += 1
        assert (a, b) == (lo, hi)


def test_same_rows_as_sql(spark, sf_dir):
    mine = queries.op12_prefix_trie(spark, sf_dir).toPandas()
    assert rows(mine) == rows(duck(sf_dir, queries.TRIE_SQL))
    assert mine["n_convs"].max() == table(spark, sf_dir, "conversations").select("conv_id").distinct().count()
