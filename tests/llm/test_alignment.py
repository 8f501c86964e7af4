"""Alignment of two tokenizers against a brute-force one that encodes whole texts."""

import bisect
import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.small import with_sizes
from tickforge.llm import alignment, queries
from tickforge.llm.common import table

SCHEMA = "doc_id long, text string, block long, place int, count long, a string, maps int"


def brute(made, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    level = {v: k for k, v in alignment.byte_of_character().items()}
    back = {c: v for v, c in level.items()}
    entries = {i: e for e, i in json.load(open(paths[0], encoding="utf-8"))["model"]["vocab"].items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs, held = [], defaultdict(set)
    for n, (doc, text) in enumerate(made):
        raw = " " + text if text else ""
        ids_a = a.encode(raw, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = [bytes(back[c] for c in entries[i]) for i in ids_a], [piece(i) for i in ids_b]
        if not text or b"".join(bytes_a) != raw.encode() or b"".join(bytes_b) != raw.encode():
            docs.append((doc, 0, 0, 0, [], ""))
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted({*end_a} & {*end_b})
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((ids_a, end_a), (ids_b, end_b))):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        for pair in set(links):
            held[pair].add(n)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        docs.append((doc, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(said.encode()).hexdigest()))
    count = {p: len(d) for p, d in held.items()}
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        ((doc, na, nb, ng, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha) for doc, na, nb, ng, links, sha in docs),
        key=str,
    )


def got(frame):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


HOSTILE = [
    None, "", " ", "  ", "\n", "\n\n x", "a  b", "a   b ", " lead", "trail ", "tab\tspace \t x", "nbsp x", "x  y", "\x1c x \x1d y", "it's we'll 'S", "x\r\n y",
    "a▁b", "▁", "<s> </s> <unk> <|endoftext|>", "<0x41> x", "日本語のテキスト 日本語", "é é ﬁ", "😀😀 👩‍👩‍👧", "aaaaaaaaaaaaaaaa aaaa", " em 　wide x", "﻿bom x", "\x00 nul", "1234 56.78 %", "\u0085 x",
]


@pytest.fixture(scope="module")
def paths():
    return alignment.default_vocabularies()


def test_edges(spark, paths):
    made = list(enumerate(HOSTILE)) + [(None, "no id at all"), (7, "same id"), (7, "same id"), (99, " ".join(random.Random(1).choices(["word", "  ", "ünï", "漢字", "\n"], k=30_000)))]
    frame = spark.createDataFrame([(i, t, 1, 2, 3, "x", 4) for i, t in made], SCHEMA)
    assert got(alignment.align(frame)) == brute(made, paths)
    assert alignment.align(frame.filter("doc_id = -1")).count() == 0


def test_random_texts_in_small_blocks(spark, paths, monkeypatch):
    rng = random.Random(5)
    made = [(i, "".join(rng.choices(["a", "the", " ", "  ", "é", "\n", "'s", "x1", "▁", "語", "\t", "."], k=rng.randrange(60)))) for i in range(400)]
    sizes = {"BLOCK": 64, "STEP": 16, "STEP_CHARS": 500, "ENTRIES": 300, "LINKS": 7}
    for name in ("_indexed", "_credited"):
        monkeypatch.setattr(alignment, name, with_sizes(alignment, name, **sizes))
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert got(alignment.align(frame)) == brute(made, paths)


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n, m in [(0, 3), (5, 900), (1000, 1000), (300, 2)]:
        x, y = (np.sort(rng.choice(alignment.BLOCK, k, replace=False)) for k in (n, m))
        both = alignment.united([alignment.compressed(x), alignment.compressed(y)])
        assert alignment.members_of(both).tolist() == sorted({*x.tolist()} | {*y.tolist()})
        assert alignment.popcount(both) == len({*x.tolist()} | {*y.tolist()})


def test_both_ways_of_a(paths):
    fast, plain = alignment.Aligner(*paths), alignment.Aligner(*paths[:2])
    for text in HOSTILE:
        if text:
            assert fast.a(" " + text).tolist() == plain.a(" " + text).tolist()


def test_documents_table(spark, sf_dir, paths):
    made = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert got(queries.op13_tokenizer_alignment(spark, sf_dir)) == brute(made, paths)
