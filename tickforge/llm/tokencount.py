"""Token counts by a unigram model, forward scores shared along a trie.

Texts fall into words, each a pre-token with the vocabulary's word mark before it. The
best segmentation of a pre-token maximises the summed piece scores (ties: fewer tokens, then
the longest last piece). Distinct pre-tokens of a block of rows are inserted in a trie; the
forward score and token count of a shared prefix are computed once, when its node is made; a
pre-token's count is stored at its terminal and looked up for every later occurrence.

Pieces come from a public vocabulary file, which carries ranks and no probabilities. Their
probabilities are fitted to the texts, all of them: from a start that falls with the rank
(1 / (rank + 2.7)), ``PASSES`` passes segment every distinct word best and set a piece's
probability to its share of the pieces used, words counted as often as they occur (one is
added to every piece). Scores are logarithms in millionths, so that sums are exact.
Characters without a piece fall back to their UTF-8 bytes, each a factor of ten below the
least probable piece. ``scores`` of another origin can be given instead.

Scale: fitting shuffles distinct words with counts, pre-aggregated by task, and then a row a
piece and task; what reaches the driver is a row a piece. Counting shuffles nothing; a worker
remembers the counts of ``KNOWN_WORDS`` pre-tokens at most and then begins anew (results
don't depend on that). Whole texts are counted.

Defined results: null and empty texts have no tokens. Repeated rows repeat, and count as
often in the fit; without any word the start's scores stay. Extra columns are not looked at.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickforge.llm.common import written

MARK = "▁"
#: Words whose counts a worker remembers.
KNOWN_WORDS = 400_000
SHIFT = 2.7
#: Rows whose new words are inserted together.
BLOCK = 512
PASSES = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(path: str) -> list[str]:
    """The pieces of a sentencepiece file in order of rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def scored(pieces: list[str], weights: np.ndarray) -> tuple[dict[str, int], int]:
    """(piece -> score, score of a byte) of pieces with weights."""
    scores = np.round(1e6 * np.log(weights / weights.sum())).astype(np.int64).tolist()
    return dict(zip(pieces, scores, strict=True)), min(scores) - int(1e6 * math.log(10))


def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """The start: scores that fall with the rank."""
    pieces = pieces_of(path)
    return scored(pieces, 1.0 / (np.arange(len(pieces)) + 1 + SHIFT))


class Trie:
    """Token counts of pre-tokens, by forward scores over a trie of those still unknown.

    A block's new pre-tokens are inserted in sorted order, which walks their trie depth
    first: ``score`` and ``count`` stand for the nodes on the path from the root to the
    current one, and only nodes beyond the prefix shared with the one before are made.
    """

    def __init__(self, pieces: dict[str, int], byte: int, most: int = KNOWN_WORDS):
        self.byte, self.most = byte, most
        #: every ending of a piece, with the piece's score if it is one itself
        self.endings: dict[str, int | None] = {p[k:]: None for p in pieces for k in range(1, len(p))} | pieces
        self.terminal: dict[str, int] = {}

    def insert(self, words: Iterable[str], times: Mapping[str, int] | None = None) -> Counter:
        """Stores the token counts of words at their terminals; returns how often pieces are used, words ``times`` each."""
        endings, byte, terminal, absent = self.endings, self.byte, self.terminal, -1
        score, count, last, before = [0], [0], [0], ""
        uses: Counter = Counter()
        for word in sorted(words):
            token = MARK + word
            shared = len(os.path.commonprefix((before, token)))
            del score[shared + 1 :], count[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                start = end - 1
                c = token[start]
                size = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                best, tokens, where = score[start] + size * byte, count[start] + size, -1
                while start >= 0:
                    s = endings.get(token[start:end], absent)
                    if s is not None:
                        if s == absent:
                            break
                        s += score[start]
                        if s > best or s == best and count[start] < tokens:
                            best, tokens, where = s, count[start] + 1, start
                    start -= 1
                score.append(best)
                count.append(tokens)
                last.append(where)
            terminal[word] = count[-1]
            before = token
            if times is not None:
                end, n = len(token), times[word]
                while end:
                    start = last[end]
                    if start >= 0:
                        uses[token[start:end]] += n
                    end = start if start >= 0 else end - 1  # a character in bytes is no piece
        return uses

    def totals(self, texts: Iterable[str | None]) -> list[tuple[int, int]]:
        """(tokens, words) of each text of a block."""
        split = [text_words(x) if x else [] for x in texts]
        unknown = set().union(*split) - self.terminal.keys()
        if len(self.terminal) + len(unknown) > self.most:
            self.terminal = {}
            unknown = set().union(*split)
        self.insert(unknown)
        known = self.terminal.__getitem__
        return [(sum(map(known, words)), len(words)) for words in split]


def text_words(text: str) -> list[str]:
    """Words between ASCII white space."""
    if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
    return text.split()


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct words and their counts, in parts of about ``KNOWN_WORDS``."""
    held: Counter = Counter()
    for part in batches:
        for text in part["text"]:
            if text:
                held.update(text_words(text))
            if len(held) > KNOWN_WORDS:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held = Counter()
    yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})


def _uses(scores: tuple[dict[str, int], int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, total = Trie(*scores), Counter()
        for part in batches:
            total += trie.insert(part["word"], dict(zip(part["word"], part["n"].tolist(), strict=True)))
            trie.terminal = {}
        yield pd.DataFrame({"piece": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    return run


def fit(docs: DataFrame, path: str | None = None, passes: int = PASSES) -> tuple[dict[str, int], int]:
    """Scores of the file's pieces (and of a byte), fitted to the column ``text`` of all rows."""
    path = path or default_vocabulary()
    scores = vocabulary(path)
    words = docs.select("text").mapInPandas(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    if passes > 1:
        words = written(words, "words")
    pieces = list(scores[0])
    for _ in range(passes):
        found = words.mapInPandas(_uses(scores), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        uses = dict(map(tuple, found.collect()))  # a row a piece
        if not uses:
            break
        scores = scored(pieces, np.array([uses.get(p, 0) + 1 for p in pieces], float))
    return scores


def counts(text: Column, scores: tuple[dict[str, int], int]) -> Column:
    """A struct (n_tokens, n_words) of whole texts."""

    @pandas_udf("n_tokens long, n_words long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(*scores)
        for texts in batches:
            found = [x for a in range(0, len(texts), BLOCK) for x in trie.totals(texts.iloc[a : a + BLOCK])]
            yield pd.DataFrame(found, columns=["n_tokens", "n_words"])

    return counted(text)


def token_counts(docs: DataFrame, path: str | None = None, scores: tuple[dict[str, int], int] | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens and n_words, by ``scores`` or by those fitted to the documents."""
    scores = scores or fit(docs, path)
    return docs.select("doc_id", counts(docs["text"], scores).alias("_c")).select("doc_id", F.col("_c.n_tokens").alias("n_tokens"), F.col("_c.n_words").alias("n_words"))
