"""Token counts of greedy longest-match word pieces, in linear time and without building the pieces.

Two tries, of pieces that start a word and of pieces that continue one, carry failure links: from a node where the next
character has no child, the link leads to the node reached after the longest pieces so far are popped, and the number
of pieces popped on the way is stored with it. A word's count is the sum of those numbers along one pass.

Words are runs of characters other than space and \\x09-\\x0d. A word that can't be covered counts as one unknown token,
whole. Null and empty texts have no words. Repeated rows, extra columns and empty tables need no special care.

Vocabulary: pieces of a SentencePiece file; those with the word mark start words, the others continue them. The bare mark
is a piece too: a word for which no other piece with the mark fits starts with it and is continued. The mark stands for
no character and isn't counted, as in word-piece vocabularies, which mark the continuing pieces instead.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scoped

WORD_MARK = "▁"
CACHE_WORDS, CACHE_LENGTH = 400_000, 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """Word-starting pieces (mark removed) and continuing ones.

    With the bare mark, continuing pieces start words too, unless a piece with the mark fits there.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    start = [p[1:] for p in pieces if p.startswith(WORD_MARK) and len(p) > 1]
    more = [p for p in pieces if not p.startswith(WORD_MARK)]
    if WORD_MARK in pieces:
        fits = set(start)
        start += [p for p in more if not any(p[:k] in fits for k in range(1, len(p) + 1))]
    return start, more


class LongestMatch:
    """Node 0 is the root of starting pieces, node 1 that of continuing ones."""

    def __init__(self, start, more):
        self.child: dict[tuple[int, str], int] = {}
        ends: set[int] = set()
        above: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        for root, pieces in ((0, start), (1, more)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (nxt := self.child.get((node, c))) is None:
                        nxt = self.child[node, c] = len(above)
                        above.append((node, c))
                    node = nxt
                if piece:
                    ends.add(node)
        n = len(above)
        self.fail, self.pops = [-1] * n, [0] * n
        depth = [0] * n
        for v in range(2, n):
            depth[v] = depth[above[v][0]] + 1
        for v in sorted(range(2, n), key=depth.__getitem__):
            if v in ends:
                self.fail[v], self.pops[v] = 1, 1
                continue
            u, c = above[v]
            z, popped = self.fail[u], self.pops[u]
            while z >= 0 and (z, c) not in self.child:
                popped += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.child[z, c], popped
        self.cache: dict[str, tuple[int, int]] = {}

    def count(self, word: str) -> tuple[int, int]:
        """(tokens, unknown words: 0 or 1)."""
        child, fail, pops = self.child, self.fail, self.pops
        v = n = 0
        for c in word:
            while (nxt := child.get((v, c))) is None:
                if fail[v] < 0:
                    return 1, 1
                n += pops[v]
                v = fail[v]
            v = nxt
        while v > 1:
            if fail[v] < 0:
                return 1, 1
            n += pops[v]
            v = fail[v]
        return n, 0

    def text_counts(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text."""
        words = (text or "").translate(_TO_SPACE).split(" ")
        total = tokens = unknown = 0
        cache = self.cache
        for w in words:
            if w:
                if (got := cache.get(w)) is None:
                    got = self.count(w)
                    if len(w) <= CACHE_LENGTH:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        cache[w] = got
                total += 1
                tokens += got[0]
                unknown += got[1]
        return total, tokens, unknown


_TO_SPACE = dict.fromkeys(range(9, 14), " ")


@lru_cache(maxsize=4)
def load(path: str) -> LongestMatch:
    return LongestMatch(*read_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``documents -> (doc_id, n_words, n_tokens, n_unknown)``, one row for each input row."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        match = load(path)
        for b in batches:
            rows = [match.text_counts(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return scoped(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
