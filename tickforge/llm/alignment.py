"""Alignment of two tokenizers' tokens, with document counts from inverted pair bitmaps.

A text is encoded by a byte-level BPE (A) and by a sentencepiece BPE (B). Both read the text
after one space. Byte offsets at which tokens of both end cut the tokens into groups; each
A token of a group is linked with each B token of it.

Pairs of ids are counted with an inverted index. Documents are numbered in blocks of ``BLOCK``;
per pair a block holds planes of multiplicities, plane k being a compressed bitmap of the
documents whose multiplicity has bit k. The OR of a pair's planes is the bitmap of its documents;
its popcount counts them, and counts add up over blocks, as a document is in one block.
Counts then return along the postings: a block's postings are read once with their pair's
count, and the documents of plane k are credited 2^k times.

Scale: texts are encoded once and never shuffled. Postings are shuffled twice, by pair and by
block; a frequent pair has one row a block, which Spark's skew join may split, and counts are
partially summed. A block's sums are arrays of ``BLOCK`` numbers, so that no document's postings
need be together. Nothing is broadcast.

Defined results: texts that are null, empty, or whose joined bytes of A or of B are not
those of space and text have no tokens: zeros, and an empty digest. Repeated rows are documents
of their own. Special strings in texts are plain text. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import written

#: Documents of a block; their numbers in it are the bits of bitmaps.
BLOCK = 4096
#: (document, pair) entries that close a block early; links that are held at a time.
ENTRIES, LINKS = 1 << 21, 1 << 21
#: Texts, and characters unless one text has more, that are encoded together.
STEP, STEP_CHARS = 256, 1 << 20
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def default_vocabularies() -> tuple[str, str, str]:
    """Vocabularies of A and B, and A's rank file, by which tiktoken makes the same ids faster (tests compare them)."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")))


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def summed(key: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their numbers (ones, if none are given)."""
    if number is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, number = key[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.diff(np.append(first, len(key))) if number is None else np.add.reduceat(number, first) if len(key) else number


class Aligner:
    """Encodes texts by both tokenizers and cuts their tokens into groups."""

    def __init__(self, path_a: str, path_b: str, ranks: str | None = None):
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        of = byte_of_character()
        bytes_a = {i: bytes(of[c] for c in entry) if all(c in of for c in entry) else b"" for entry, i in entries.items()}
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)]
        self.a = self._fast(ranks) if ranks else self._plain(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = [_BYTE.fullmatch(p) if self.b.is_byte(i) else None for i, p in enumerate(pieces)]
        self.bytes_b = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for m, p in zip(byte, pieces, strict=True)]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        # what the digest's text has for a token: of A within a group and at its end, of B within and at its end
        n, m = len(self.bytes_a), len(self.bytes_b)
        self.said = [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)]

    @staticmethod
    def _plain(path: str) -> Callable[[str], np.ndarray]:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = True
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.int64)

    @staticmethod
    def _fast(ranks: str) -> Callable[[str], np.ndarray]:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        return lambda text: fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both; None if the bytes of either aren't those of space and text."""
        raw = (" " + text).encode()
        a, b = self.a(" " + text), self.b.encode(text, num_threads=1)
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw:
            return None
        b = np.array(b, np.int64)
        # tokens without bytes would end where others do
        return None if (self.size_b[b] == 0).any() or (self.size_a[a] == 0).any() else (a, b)

    def documents(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """(totals and digest of each text; pair, text and multiplicity of all entries, by pair and text)."""
        coded = [self.encode(x) if x else None for x in texts]
        good = [k for k, x in enumerate(coded) if x is not None]
        out: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
        if not good:
            return out, *[np.empty(0, np.int64)] * 3
        a, b = (np.concatenate([coded[k][side] for k in good]) for side in (0, 1))
        n_a, n_b = (np.array([len(coded[k][side]) for k in good]) for side in (0, 1))
        # both sides of each text have the same bytes, so that ends over all texts stay comparable
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a)
        last_b = at[last_a]
        from_a, from_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
        n, m = last_a - from_a + 1, last_b - from_b + 1
        text = np.repeat(np.arange(len(good)), n_a)[last_a]
        groups = np.bincount(text, minlength=len(good))
        links = np.add.reduceat(n * m, np.cumsum(groups) - groups)
        # tokens in the digest's order: a group's of A, then its of B
        code = np.empty(len(a) + len(b), np.int64)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[last_a], ends_b[last_b] = 1, 1
        code[np.arange(len(a)) + np.repeat(from_b, n)] = a + ends_a * len(self.bytes_a)
        code[np.arange(len(b)) + np.repeat(last_a + 1, m)] = b + ends_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        stop = np.cumsum(n_a + n_b).tolist()
        said = self.said.__getitem__
        for k, x, y, g, l, u, v in zip(good, n_a.tolist(), n_b.tolist(), groups.tolist(), links.tolist(), [0, *stop[:-1]], stop, strict=True):
            words = "".join(map(said, code[u:v].tolist()))[:-1]
            out[k] = (x, y, g, l, hashlib.sha256(words.encode()).hexdigest())
        return out, *self._entries(a, b, from_a, from_b, n, m, np.array(good)[text])

    @staticmethod
    def _entries(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, n: np.ndarray, m: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, text, multiplicity) of all links, by pair and text; ``LINKS`` of them are held at a time."""
        bits = int(text.max()).bit_length()
        keys, numbers = [], []
        wide = n * m > LINKS  # a group as large is counted by distinct ids
        for g in np.flatnonzero(wide).tolist():
            (x, times_x), (y, times_y) = summed(a[from_a[g] : from_a[g] + n[g]]), summed(b[from_b[g] : from_b[g] + m[g]])
            for one, times in zip(x.tolist(), times_x.tolist(), strict=True):
                keys.append((one << 32 | y) << bits | text[g])
                numbers.append(times * times_y)
        narrow = np.flatnonzero(~wide)
        total = np.cumsum(n[narrow] * m[narrow])
        first = 0
        while first < len(narrow):
            stop = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + LINKS, "right")))
            g = narrow[first:stop]
            size = n[g] * m[g]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            of = np.repeat(g, size)
            x, y = np.divmod(place, m[of])
            key, number = summed((a[from_a[of] + x] << 32 | b[from_b[of] + y]) << bits | text[of])
            keys.append(key)
            numbers.append(number)
            first = stop
        key, number = (keys[0], numbers[0]) if len(keys) == 1 else summed(np.concatenate(keys), np.concatenate(numbers))
        return key >> bits, key & ((1 << bits) - 1), number


def compressed(members: np.ndarray) -> bytes:
    """A set of numbers below ``BLOCK``, ascending: as a list if that is shorter, else as bits."""
    if 2 * len(members) < BLOCK // 8:
        return b"l" + members.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[members] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def members_of(bitmap: bytes) -> np.ndarray:
    if bitmap[:1] == b"l":
        return np.frombuffer(bitmap, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), bitorder="little"))


def united(bitmaps: list[bytes]) -> bytes:
    """The OR of bitmaps."""
    if len(bitmaps) == 1:
        return bitmaps[0]
    if all(x[:1] == b"l" for x in bitmaps):
        return compressed(np.unique(np.concatenate([members_of(x) for x in bitmaps])))
    bits = np.zeros(BLOCK, np.uint8)
    for x in bitmaps:
        bits[members_of(x)] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def popcount(bitmap: bytes) -> int:
    """Members of a bitmap."""
    return (len(bitmap) - 1) // 2 if bitmap[:1] == b"l" else int(np.bitwise_count(np.frombuffer(bitmap, np.uint8, offset=1)).sum())


def planes_of(pair: np.ndarray, doc: np.ndarray, number: np.ndarray) -> dict[int, dict[int, bytes]]:
    """Per pair its planes: k -> bitmap of the documents whose multiplicity has bit k. Each (pair, doc) comes once."""
    order = np.lexsort((doc, pair))
    pair, doc, number = pair[order], doc[order], number[order]
    out: dict[int, dict[int, bytes]] = {}
    for k in range(int(number.max()).bit_length() if len(number) else 0):
        at = np.flatnonzero((number >> k) & 1)
        if not len(at):
            continue
        key, members = pair[at], doc[at]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for p, a, b in zip(key[first].tolist(), first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
            out.setdefault(p, {})[k] = compressed(members[a:b])
    return out


DOCS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
MADE = f"block long, place int, doc_id long, {DOCS}, a int, b int, n_docs int, planes array<int>, maps array<binary>"
_NAMES = [x.split()[0] for x in MADE.split(", ")]


def _closed(block: int, docs: list[tuple], entries: list[tuple]) -> Iterator[pd.DataFrame]:
    """A block's documents, then its postings; documents are counted by the popcount of their planes' OR."""
    out = pd.DataFrame(docs, columns=["doc_id", *[x.split()[0] for x in DOCS.split(", ")]])
    out["doc_id"] = out["doc_id"].astype("Int64")
    yield out.assign(block=block, place=np.arange(len(docs)), a=None, b=None, n_docs=None, planes=None, maps=None)[_NAMES]
    found = planes_of(*map(np.concatenate, zip(*entries, strict=True))) if entries else {}
    rows = [(p >> 32, p & 0xFFFFFFFF, popcount(united([*maps.values()])), [*maps], [*maps.values()]) for p, maps in found.items()]
    for k in range(0, len(rows), 1 << 14):
        frame = pd.DataFrame(rows[k : k + (1 << 14)], columns=["a", "b", "n_docs", "planes", "maps"])
        yield frame.assign(block=block, **dict.fromkeys(_NAMES[1:8]))[_NAMES]


def _indexed(batches: Iterator[pd.DataFrame], *paths: str) -> Iterator[pd.DataFrame]:
    """Rows of documents (place, doc_id...) and of postings (a, b...), block by block."""
    aligner = Aligner(*paths)
    block = TaskContext.get().partitionId() << 32
    docs: list[tuple] = []
    entries: list[tuple] = []
    held = 0
    for part in batches:
        ids, texts = part["doc_id"].array, part["text"].tolist()
        first = 0
        while first < len(texts):
            stop, chars = first, 0
            while stop < len(texts) and stop < first + STEP and (stop == first or chars + len(texts[stop] or "") <= STEP_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            if len(docs) + stop - first > BLOCK or held >= ENTRIES:
                yield from _closed(block, docs, entries)
                docs, entries, held, block = [], [], 0, block + 1
            found, pair, text, number = aligner.documents(texts[first:stop])
            entries.append((pair, text + len(docs), number))
            held += len(pair)
            docs += [(None if pd.isna(i) else int(i), *x) for i, x in zip(ids[first:stop], found, strict=True)]
            first = stop
    yield from _closed(block, docs, entries)


def _credited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per document of a block, over postings sorted by block: summed counts, and links whose count is best."""
    now, total, best = None, None, None

    def done() -> pd.DataFrame:
        at = np.flatnonzero(total)
        return pd.DataFrame({"block": np.int64(now), "place": at.astype(np.int32), "n_best": best[at], "count_sum": total[at]})

    for part in batches:
        for block, count, top, planes, maps in part[["block", "count", "top", "planes", "maps"]].itertuples(index=False):
            if block != now:
                if now is not None:
                    yield done()
                now, total, best = block, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            for k, bitmap in zip(planes, maps, strict=True):
                at, times = members_of(bitmap), 1 << int(k)
                total[at] += times * count
                if top:
                    best[at] += times
    if now is not None:
        yield done()


def align(docs: DataFrame, paths: tuple[str, ...] | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = paths or default_vocabularies()
    made = written(docs.select("doc_id", "text").mapInPandas(lambda batches: _indexed(batches, *paths), MADE), "alignments")
    counts = written(pair_counts(made), "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    scored = counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("best")).alias("top"))
    postings = made.filter("a IS NOT NULL").select("a", "b", "block", "planes", "maps")
    returned = postings.join(scored, ["a", "b"]).select("block", "count", "top", "planes", "maps")
    credited = returned.repartition("block").sortWithinPartitions("block").mapInPandas(_credited, "block long, place int, n_best long, count_sum long")
    names = ["n_a", "n_b", "n_groups", "n_links"]
    full = made.filter("place IS NOT NULL").join(credited, ["block", "place"], "left")
    return full.select("doc_id", *names, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, count): how many documents hold a pair of ids linked, from the popcounts of postings."""
    return made.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n_docs").cast("long").alias("count"))
