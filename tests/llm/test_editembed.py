"""Fingerprints by randomised edit embedding: digests exact, walks and likeness against plain definitions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.small import with_sizes
from tickforge.llm import editembed, queries
from tickforge.llm.common import table

SCHEMA = "doc_id long, text string, part int, edge string, id long, fingerprint int"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzéü", k=rng.randrange(2, 9))) for _ in range(n))


def edited(rng, text, share):
    out = list(text)
    for _ in range(int(len(out) * share)):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            del out[i]
        elif kind == 1:
            out.insert(i, rng.choice("abcxyz "))
        else:
            out[i] = rng.choice("abcxyz ")
    return "".join(out)


def plain_walk(codes, number, start):
    """Step by step, from the table's bits."""
    bits = (editembed.mixed(np.arange(editembed.CLASSES * editembed.PERIOD) + (number << 32)) >> np.uint64(63)).astype(bool).reshape(editembed.CLASSES, editembed.PERIOD)
    bits[:, -1] = True
    at, j, i = [], start, 0
    while i < len(codes):
        at.append(j)
        c = (int(codes[i]) * 0x9E3779B1 >> 16) & 255
        while not bits[c, j % editembed.PERIOD]:
            j += 1
        j, i = j + 1, i + 1
    return [*at, j]


@pytest.mark.parametrize("together", [1, 3, 48])
def test_walks_step_by_step(monkeypatch, together):
    monkeypatch.setattr(editembed, "TOGETHER", together)
    rng = random.Random(2)
    texts = [editembed.codes_of("".join(rng.choices("abcdé 語\U0001f600", k=n))) for n in (0, 1, 2, 50, 5000, 7, 0, 300)]
    numbers, starts = [0, 1, 0, 1, 0, 1, 1, 0], [0, 5, 0, 4095, 0, 10**7, 3, 1]
    for got_, want in zip(editembed.walks(texts, numbers, starts), map(plain_walk, texts, numbers, starts), strict=True):
        assert got_.tolist() == want
    monkeypatch.setattr(editembed, "CELLS", 40)
    for got_, want in zip(editembed.walks(texts, numbers, starts), map(plain_walk, texts, numbers, starts), strict=True):
        assert got_.tolist() == want


def test_longer_classes_sample_fewer_steps_of_the_same():
    for k in range(0, 70, 7):
        for other in range(k, k + 6):
            mine, theirs = editembed.sampled(k), editembed.sampled(other)
            assert {*theirs[theirs < editembed._reach(k)[1]].tolist()} <= {*mine.tolist()}


def test_likeness_follows_edit_distance():
    rng = random.Random(3)
    found = defaultdict(list)
    for n in (40, 400, 4000) * 8:
        text = words(rng, n)
        print_ = editembed.text_fingerprint(text)
        for share in (0.001, 0.01, 0.1):
            found[share].append(editembed.likeness(print_, editembed.text_fingerprint(edited(rng, text, share))))
        assert editembed.likeness(print_, editembed.text_fingerprint(words(rng, n))) < 0.2
        half = text[: len(text) - len(text) // 2] + words(rng, n)[: len(text) // 2]
        assert 0.35 < editembed.likeness(print_, editembed.text_fingerprint(half)) < 0.7
        longer = editembed.text_fingerprint(text + " " + words(rng, n // 10))
        assert editembed.likeness(print_, longer) == editembed.likeness(longer, print_) > 0.7
    middle = [np.median(found[s]) for s in (0.001, 0.01, 0.1)]
    assert middle[0] > 0.9 and middle[0] > middle[1] > middle[2], middle
    empty = editembed.text_fingerprint("")
    assert editembed.likeness(empty, editembed.text_fingerprint(None)) == 1 and editembed.likeness(empty, print_) == 0


def expected(made):
    made = sorted(((i is None, i or 0, t or "") for i, t in made))
    out = []
    for k, (none, i, text) in enumerate(made):
        after = made[(k + 1) % len(made)][2]
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        x, y, z = map(editembed.text_fingerprint, (text, changed, after))
        out.append((None if none else i, len(text), hashlib.sha256(changed.encode()).hexdigest(), x, y, editembed.likeness(x, y), editembed.likeness(x, z)))
    return sorted(out, key=str)


def got(frame):
    names = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_by_whole_texts(spark, monkeypatch, parts):
    rng = random.Random(4)
    made = [(i, words(rng, rng.randrange(60))) for i in range(0, 120, 2)]
    made += [(3, None), (5, ""), (7, "x"), (None, "no id"), (9, "twice"), (9, "twice"), (11, "Ü語\U0001f600"), (-4, words(rng, 30_000))]
    rng.shuffle(made)
    frame = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in made], SCHEMA).repartition(parts)
    if parts > 1:
        monkeypatch.setattr(editembed, "_in_order", with_sizes(editembed, "_in_order", BLOCK=3, BLOCK_CHARS=2000))
    assert got(editembed.prints(frame)) == expected(made)


def test_one_and_none(spark):
    one = spark.createDataFrame([(1, "alone here")], "doc_id long, text string")
    assert got(editembed.prints(one)) == expected([(1, "alone here")])
    assert editembed.fingerprints(one.filter("doc_id = 2")).count() == 0


def test_near_duplicates(spark):
    """Copies and lightly edited texts share a class; no clean document joins one."""
    rng = random.Random(5)
    made, group = [], {}
    for g in range(40):
        text = words(rng, rng.randrange(60, 400))
        for k in range(rng.choice([1, 1, 3, 12])):
            group[len(made)] = g
            made.append((len(made), text if k % 3 == 1 else edited(rng, text, 0.003 * (k > 0))))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in editembed.fingerprints(frame).collect()}
    members = defaultdict(set)
    for d, c in found.items():
        members[c].add(group[d])
    assert all(len(x) == 1 for x in members.values())
    assert len(members) <= 40 + 6


def test_links_of_two_groups(spark):
    """Each of two groups of like fingerprints is linked, and nothing between them."""
    size = 2 * len(editembed.sampled(32))
    a, b = ("0123456789abcdef" * 40)[:size], ("fedcba9876543210" * 40)[:size]
    rows = [(0, "20" + a), (1, "20" + b), (2, "20" + b[:-1] + "1"), (3, "20" + a[:-1] + "1")]
    frame = spark.createDataFrame(rows, "id long, fingerprint string")
    assert {tuple(r) for r in editembed.near_links(frame).collect()} == {(3, 0), (2, 1)}


@pytest.mark.parametrize("compared, alike", [(2048, 0.6), (7, 0.6), (7, 0.45)])
def test_no_link_is_lost(spark, monkeypatch, compared, alike):
    """Components of all pairs at or above the threshold, also of lengths apart, short and empty texts."""
    monkeypatch.setattr(editembed, "COMPARED", compared)
    rng = random.Random(6)
    texts = {"", "a", "ab", "abc"}
    for n in (1, 2, 3, 6, 12, 40, 41, 150, 151, 700) * 2:
        text = words(rng, n)
        texts |= {text, text[: int(len(text) * 0.7)], text + " " + words(rng, n // 3)} | {edited(rng, text, s) for s in (0.01, 0.03, 0.05, 0.07)}
    prints = sorted({editembed.text_fingerprint(t) for t in texts})
    root = [*range(len(prints))]
    for i, x in enumerate(prints):
        for j in range(i):
            if editembed.likeness(x, prints[j]) >= alike:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    frame = spark.createDataFrame([*enumerate(prints)], "doc_id long, fingerprint string")
    found = {r["doc_id"]: r["class_id"] for r in editembed.near_duplicates(frame, alike).collect()}
    assert found == dict(enumerate(root)) and len({*root}) < len(root) / 2


def made_prints(rng, k, n, groups=0, short=0):
    """Digits of class k: of n texts, some of them members of groups of like ones, some that end early."""
    steps = len(editembed.sampled(k))
    digits = rng.integers(0, 16, (n, editembed.WALKS, steps)).astype(np.uint8)
    heads = rng.integers(0, 16, (max(1, groups), editembed.WALKS, steps)).astype(np.uint8)
    for row in range(n // 2 if groups else 0):
        same = rng.random((editembed.WALKS, steps)) < rng.choice([0.55, 0.62, 0.64, 0.7, 0.95])
        digits[row][same] = heads[row % groups][same]
    length = rng.integers(int(0.75 * steps), int(0.95 * steps), (n, editembed.WALKS))
    length[n - short :] = rng.integers(0, steps // 2, (short, editembed.WALKS))
    digits[np.arange(steps) >= length[:, :, None]] = editembed._ENDED
    return digits


def block_of(digits, at, first):
    return editembed._Block(np.arange(first, first + len(digits)), digits, at)


def joined(x, y, links):
    """Components of links (places in x, in y) as a set of sets of ids."""
    root = {i: i for i in [*x.ids.tolist(), *y.ids.tolist()]}

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in links:
        for a, b in zip(x.ids[i].tolist(), y.ids[j].tolist(), strict=True):
            root[top(a)] = top(b)
    out = defaultdict(set)
    for i in root:
        out[top(i)].add(i)
    return {frozenset(v) for v in out.values() if len(v) > 1}


def plain_links(x, y, alike):
    """By the definition of likeness, walk by walk."""
    for n in range(len(x.ids)):
        a, b = x.said[n], y.said
        counted = (a != editembed._ENDED) | (b != editembed._ENDED)
        share = ((a == b) & counted).sum(axis=2) / np.maximum(counted.sum(axis=2), 1)
        j = np.flatnonzero(((counted.sum(axis=2) > 0) & ((share - 1 / 16) * 16 / 15 >= alike)).any(axis=1))
        j = j[x.ids[n] != y.ids[j]]
        yield np.full(len(j), n), j


@pytest.mark.parametrize("groups, short", [(0, 0), (3, 0), (40, 25)])
@pytest.mark.parametrize("k, other", [(40, 40), (40, 41), (33, 35)])
@pytest.mark.parametrize("keys, alike", [((3,), 0.6), ((4,), 0.6), ((3,), 0.45)])
def test_keys_lose_no_link(monkeypatch, groups, short, k, other, keys, alike):
    """Components by keys are those of all pairs, whether groups of like texts are large, small or absent."""
    for name, value in {"KEYS": keys, "KEY_COST": 0.1, "BUCKET_COST": 0, "ROW_COST": 0, "PAIR_COST": 0, "EXPANDED": 1000, "DECIDED": 100}.items():
        monkeypatch.setattr(editembed, name, value)
    rng = np.random.default_rng([k, other, groups])
    at, there = editembed.common(k, other)
    digits = made_prints(rng, k, 300, groups, short)
    x = block_of(digits, at, 0)
    y = x
    if other != k:  # the same texts' beginnings, as a longer class samples them
        theirs = made_prints(rng, other, 200, groups, short)
        theirs[:150][:, :, at >= 0] = np.where(rng.random((150, editembed.WALKS, (at >= 0).sum())) < 0.9, digits[:150][:, :, at[at >= 0]], theirs[:150][:, :, at >= 0])
        ended = np.minimum.accumulate(theirs != editembed._ENDED, axis=2)
        y = block_of(np.where(ended, theirs, editembed._ENDED).astype(np.uint8), there, 1000)
    want = joined(x, y, plain_links(x, y, alike))
    assert want or not groups
    found = []
    for w in range(editembed.WALKS):
        links = editembed._met_by_keys(x, y, w, alike)
        while True:
            try:
                found.append(next(links))
            except StopIteration as end:
                assert end.value
                break
    assert joined(x, y, [(i[x.ids[i] != y.ids[j]], j[x.ids[i] != y.ids[j]]) for i, j in found]) == want
    assert joined(x, y, [(i[x.ids[i] != y.ids[j]], j[x.ids[i] != y.ids[j]]) for w in range(editembed.WALKS) for i, j in editembed._met_all(x, y, w, alike)]) == want


@pytest.mark.parametrize("k, other, share", [(44, 44, 0.25), (44, 45, 0.15)])
def test_few_pairs_of_a_large_block_are_looked_at(monkeypatch, k, other, share):
    """The bits that are compared are far fewer than those of all pairs."""
    rng, seen, count = np.random.default_rng(1), [0], np.bitwise_count

    def counted(x, *args):
        seen[0] += x.size
        return count(x, *args)

    at, there = editembed.common(k, other)
    x = block_of(made_prints(rng, k, 8000), at, 0)
    y = x if other == k else block_of(made_prints(rng, other, 8000), there, 10_000)
    monkeypatch.setattr(np, "bitwise_count", counted)
    assert all((x.ids[i] == y.ids[j]).all() for i, j in editembed._near(x, y, editembed.ALIKE))
    words = -(-len(at) // 64)
    assert seen[0] < share * words * editembed.WALKS * 8000 * 8000 / (1 + (x is y))


def test_hot_keys_end_in_a_look_at_all_pairs(monkeypatch):
    """Where most rows share many digits without being alike, keys are given up and nothing is lost."""
    rng = np.random.default_rng(2)
    digits = made_prints(rng, 40, 1000, groups=20)
    digits[:, :, :70] = digits[0, :, :70]
    x = block_of(digits, editembed.common(40, 40)[0], 0)
    for name in ("KEY_COST", "BUCKET_COST", "ROW_COST"):
        monkeypatch.setattr(editembed, name, 0)
    ways = []
    for w in range(editembed.WALKS):
        links = editembed._met_by_keys(x, x, w, 0.6)
        while True:
            try:
                next(links)
            except StopIteration as end:
                ways.append(end.value)
                break
    assert not all(ways)
    found = [(i[i != j], j[i != j]) for i, j in editembed._near(x, x, 0.6)]
    assert joined(x, x, found) == joined(x, x, plain_links(x, x, 0.6))


def test_blocks_of_like_lengths(spark, monkeypatch):
    """A class of many lengths is cut by them; components are those of one block."""
    rng = random.Random(8)
    texts = {words(rng, 30)[: rng.randrange(128, 150)] for _ in range(60)}
    texts |= {t[:-3] + "abc" for t in texts}
    prints = sorted({editembed.text_fingerprint(t) for t in texts})
    frame = spark.createDataFrame([*enumerate(prints)], "doc_id long, fingerprint string")
    whole = {tuple(r) for r in editembed.near_duplicates(frame).select("doc_id", "class_id").collect()}
    monkeypatch.setattr(editembed, "COMPARED", 9)
    monkeypatch.setattr(editembed, "WORK", 50)
    assert {tuple(r) for r in editembed.near_duplicates(frame).select("doc_id", "class_id").collect()} == whole
    assert len({c for _, c in whole}) < len(prints)


def test_documents_table(spark, sf_dir):
    made = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert got(queries.op11_edit_fingerprints(spark, sf_dir)) == expected(made)
