"""Lexical retrieval packing: windows filled with a seed's BM25 neighbours.

Documents become token ids and an end id. Whole windows are cut off long documents; what
remains is indexed, shard by shard, in a BM25 inverted index over token ids. The largest
unused remainder seeds a window; all its terms score the shard's documents, and the unused
neighbours fill the window greedily in score order. The first one that is too long is cut,
and its rest stays unused, so that every window but a task's last is full.

Scale: shards are cut from the input's own partitions (``SHARD_TOKENS`` tokens or
``SHARD_DOCS`` documents, to bound memory), so that no text and no id is shuffled. Of a
document only the ids after its whole windows wait for their shard. What a shard leaves
over is carried into the task's next shard. Sequence ids join the partition's number and a
count, so that a task that runs again makes the same ones.

Defined results: null text is empty and yields its end id alone. Rows are packed one by
one: repeated rows appear repeatedly. The vocabulary's special strings in a text become
their ids, as the tokenizer makes them. Extra columns are not looked at. Empty tables give
empty results.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame


WINDOW = 2048
END = 1
SHARD_TOKENS = 1 << 21
SHARD_DOCS = 1 << 11
#: Terms that more than this share of a shard's documents hold are kept as dense rows.
DENSE = 1 / 16
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def default_vocabulary() -> tuple[str, str]:
    """A vocabulary for tokenizers and the same one's rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, ranks: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of a text by the tokenizers file ``path``, as ``encode(text, add_special_tokens=False)`` gives them.

    ``ranks`` may name the rank file of the same byte-level vocabulary: tiktoken then makes
    the same ids several times faster (the tests compare them).
    """
    if ranks is not None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special tokens that take in their surroundings need tokenizers: leave ranks out")
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t["content"]: t["id"] for t in added}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
        return lambda text: np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Index:
    """A shard's BM25 inverted index: postings by term, each with the weight of its document.

    The rows of frequent terms are kept dense, which sums them faster; scores are the same.
    """

    def __init__(self, texts: list[np.ndarray]):
        n = self.n = len(texts)
        size = np.fromiter(map(len, texts), np.int64, n)
        both = (np.repeat(np.arange(n, dtype=np.uint64), size) | (np.concatenate(texts).astype(np.uint64) << np.uint64(32))) if n else np.empty(0, np.uint64)
        both.sort()
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
        times = np.diff(np.append(first, len(both)))
        pair = both[first]
        self.doc = (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        term = (pair >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        self.bounds = np.append(start, len(term))
        found = np.diff(self.bounds)
        idf = np.log1p((n - found + 0.5) / (found + 0.5))
        norm = K1 * (1 - B + B * size / max(1.0, size.mean() if n else 1.0))
        self.weight = (np.repeat(idf, found) * times * (K1 + 1) / (times + norm[self.doc])).astype(np.float32)
        number = np.repeat(np.arange(len(found)), found)
        dense = found > max(1.0, n * DENSE)
        row = np.cumsum(dense) - 1
        self.dense = np.zeros((int(dense.sum()), n), np.float32)
        often = np.flatnonzero(dense[number])
        self.dense[row[number[often]], self.doc[often]] = self.weight[often]
        # each document's terms that at least one other holds: rows of frequent ones, numbers of the others
        by_doc = np.argsort(self.doc, kind="stable")
        self.rows, self.rows_of = self._split(by_doc[dense[number[by_doc]]], row[number])
        rare = by_doc[(found[number[by_doc]] > 1) & ~dense[number[by_doc]]]
        self.terms, self.terms_of = self._split(rare, number)

    def _split(self, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return values[at], np.searchsorted(self.doc[at], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all of the seed's terms, each once."""
        out = self.dense[self.rows[self.rows_of[seed] : self.rows_of[seed + 1]]].sum(0)
        terms = self.terms[self.terms_of[seed] : self.terms_of[seed + 1]]
        start, size = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        end = np.cumsum(size)
        if len(end):
            at = np.arange(end[-1]) + np.repeat(start - end + size, size)
            out += np.bincount(self.doc[at], self.weight[at], self.n).astype(np.float32)
        return out


def pack_shard(rest: list[list], last: bool) -> Iterator[list[tuple[list, int, int]]]:
    """Windows as lists of (document, start, length); what stays unused is left in ``rest``.

    ``rest`` holds [document, start, end], a document being (doc_id, ids, ...), and start and end places in its ids.
    """
    index = Index([d[1][a:b] for d, a, b in rest])
    unused = np.array([b - a for _, a, b in rest], np.int64)
    left = int(unused.sum())
    by_size = iter(np.argsort(-unused, kind="stable").tolist())
    while left >= WINDOW or (last and left):
        seed = next(i for i in by_size if unused[i])
        score = index.scores(seed)
        score[unused == 0] = -1
        score[seed] = np.inf
        window, room, rank = [], min(WINDOW, left), 64
        while room:
            if rank >= len(score):
                best = np.argsort(-score, kind="stable")
            else:
                best = np.argpartition(-score, rank)[:rank]
                best = best[np.lexsort((best, -score[best]))]
            for i in best.tolist():
                if unused[i] and room:
                    d, a, b = rest[i]
                    take = min(room, b - a)
                    window.append((d, a, take))
                    rest[i][1] = a + take
                    unused[i] -= take
                    room -= take
                    score[i] = -1
            rank *= 4
        if unused[seed]:  # it was cut short only if the window was full at once
            by_size = iter([seed, *by_size])
        left -= min(WINDOW, left)
        yield window
    rest[:] = [r for r in rest if r[2] > r[1]]


def _pack(batches: Iterator[pd.DataFrame], *vocabulary: str | None) -> Iterator[pd.DataFrame]:
    encode = encoder(*vocabulary)
    count = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    names = [x.split()[0] for x in PIECES.split(", ")]

    def emit(window: list[tuple]) -> None:
        nonlocal count
        offset, filled = 0, sum(w[2] for w in window)
        for (doc, ids, before, total), start, length in window:
            crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            # the last window may end at a power of two
            rows.append((doc, before + start, length, crc, total, count, offset, min(WINDOW, 1 << (filled - 1).bit_length())))
            offset += length
        count += 1

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        rows.clear()
        return out

    rest: list[list] = []
    held = 0
    for part in batches:
        for doc, text in zip(part["doc_id"].array, part["text"], strict=True):
            ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(END))
            name, total = None if pd.isna(doc) else int(doc), len(ids)
            whole = total // WINDOW * WINDOW
            for start in range(0, whole, WINDOW):
                emit([((name, ids, 0, total), start, WINDOW)])
            if whole < total:
                rest.append([(name, ids[whole:].copy(), whole, total), 0, total - whole])
                held += total - whole
            if held >= SHARD_TOKENS or len(rest) >= SHARD_DOCS:
                for window in pack_shard(rest, False):
                    emit(window)
                held = sum(b - a for _, a, b in rest)
        if rows:
            yield frame()
    for window in pack_shard(rest, True):
        emit(window)
    yield frame()


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces of all documents: where each run of a document's ids stands in which sequence.

    sequence_length is what a sequence is padded to: ``WINDOW``, or less for a last one.
    ``ranks``: see ``encoder``; the default vocabulary comes with its own.
    """
    files = (vocabulary, ranks) if vocabulary else default_vocabulary()
    return docs.select("doc_id", "text").mapInPandas(lambda batches: _pack(batches, *files), PIECES)
