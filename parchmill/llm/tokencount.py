"""Token counts of a unigram tokenizer by count-only Viterbi (operator 5).

The tokenizer: spaces become a word mark, one is put before a text that doesn't begin with one, and each
mark begins a new word. In a word an Aho-Corasick automaton lists the vocabulary's pieces by their last
byte, and dynamic programming carries the best score and its number of pieces to each character. Ties are
settled as the public unigram model does: only a strictly better score replaces the one from the earlier
start. A character that is no piece costs ten less than the least score; unknown characters in a row count
as one stretch, which falls back to one piece a byte.

The vocabulary and its scores are whatever the piece file has. The query takes a BPE file, whose scores are merge ranks, as no unigram
file is there: its counts are those of the unigram model over these pieces and scores, not those of that file's own BPE tokenizer.

Equal words of a block are counted once, and counts of words are kept between blocks, so the work follows
the number of distinct words. Null and empty texts have no pieces. Equal doc_ids are separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import _BYTE, _pow, blocks, mix, per_document, sequences

MARK = "▁"
#: Words whose counts a worker keeps.
KEPT_WORDS = 200_000
#: Fixed value: what an unknown character costs below the least score.
UNKNOWN = 10.0


class Unigram:
    """Counts pieces of words; vocabulary: (piece, score), first of equal pieces counts."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.least = min(s for _, s in vocabulary) - UNKNOWN
        seen = set()
        for piece, score in vocabulary:
            if piece and piece not in seen:
                seen.add(piece)
                self.automaton.add_word(piece, (len(piece), score))
        self.bytes = all(f"<0x{i:02X}>" in seen for i in range(256))
        self.automaton.make_automaton()
        self.known: dict[bytes, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        """Pieces of one word (with its mark), and their score."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, (size, score) in self.automaton.iter(word):
            ends[last].append((size, score))
        # A step is unknown or a piece; an unknown stretch counts when it ends, so its bytes are carried apart.
        best, pieces, stretch = [0.0] + [float("-inf")] * n, [0] * (n + 1), [0] * (n + 1)
        for at in range(1, n + 1):
            steps = sorted(ends[at - 1], reverse=True)
            single = bool(steps) and steps[-1][0] == 1
            top = float("-inf")
            for size, score in steps:  # the longest first: from the earliest start
                if (total := best[at - size] + score) > top:
                    top, pieces[at], stretch[at] = total, pieces[at - size] + stretch[at - size] + 1, 0
            if not single and (total := best[at - 1] + self.least) > top:
                top, pieces[at] = total, pieces[at - 1]
                width = len(word[at - 1].encode("utf-8", "surrogatepass")) if self.bytes else 1
                stretch[at] = stretch[at - 1] + width if self.bytes else 1
            best[at] = top
        return pieces[n] + stretch[n], best[n]

    def of(self, word: bytes) -> tuple[int, float]:
        if (found := self.known.get(word)) is None:
            found = self.count(word.decode())
            if len(self.known) < KEPT_WORDS and len(word) < 64:
                self.known[word] = found
        return found


@lru_cache(maxsize=1)
def model(path: str) -> Unigram:
    """Pieces and scores of a public sentencepiece file, taken as a unigram vocabulary; special pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)])


def word_counts(unigram: Unigram, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and score of each document data[off[i]:off[i+1]]."""
    space = data == 32
    first = space.copy()
    full = off[:-1][np.diff(off) > 0]
    first[full] = True
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1)
    end = np.append(start[1:], len(data))
    marked = space[start]  # a text's first word has no space of its own
    lens = end - start - marked
    # Equal words of a block are told by 64 bits of hash over bytes and length.
    h = np.zeros(len(start), np.uint64)
    some = np.flatnonzero(lens)
    body = np.flatnonzero(~space)
    if len(some):
        begin = np.cumsum(lens[some]) - lens[some]
        place = np.arange(len(body)) - np.repeat(begin, lens[some])
        h[some] = np.add.reduceat(_BYTE[data[body]] * _pow(int(lens.max()))[place], begin)
    h = mix(h + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, which = np.unique(h, return_index=True, return_inverse=True)
    mark = MARK.encode()
    got = [unigram.of(mark + data[start[i] + marked[i] : end[i]].tobytes()) for i in at.tolist()]
    n, score = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    woff = np.searchsorted(start, off)
    return per_document(n[which], woff), np.bincount(sequences(woff), score[which], len(off) - 1)


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and score (of the best segmentation) of each row of docs (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = model(model_file)
        for batch, data, off in blocks(batches):
            size = np.diff(off)
            if MARK.encode() in data.tobytes():  # a mark in the text is as good as a space
                plain = [data[a:b].tobytes().replace(MARK.encode(), b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
                data, off = np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)])
            n, score = word_counts(unigram, data, off)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(np.round(score, 6))], ["doc_id", "n_bytes", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, score double")
