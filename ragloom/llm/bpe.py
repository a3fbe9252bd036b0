"""BPE encoding and decoding by a token automaton.

The automaton's arcs are tokens. It starts as one state with a loop for every byte; each merge ``(a, b) -> c``, in order,
adds one gadget: the state behind ``a`` is copied without its ``b`` arc, ``a`` leads to the copy from now on, and every
state with an ``a`` arc gets a ``c`` arc that leads where ``b`` led. After all merges the accepted arc sequences are
exactly the token sequences that applying merges by rank yields, so each prefix of a word ends one accepted path only.
All arcs of a token lead to one state. A state is stored as the token that owned it and its time: the arcs it lost are
the gadgets of that token up to then, and those its right parts had before they became parts. A token younger than a
gadget follows its left part there. An arc ``(state, token)`` is looked up through those few gadgets and then kept in a
transition table.

A word is encoded by following arcs from each reached position, longer labels first, a table look-up each. Decoding
writes the labels of the arcs. Words come from the byte-level split pattern; strings of special tokens are cut out first,
as the tokenizers library does. Cost is linear in the text; tables and word caches are bounded.

Defined cases: null is the empty text and has no tokens; unknown bytes cannot occur (all 256 are arcs); a rank list in
which two merges make one token is refused. Repeated rows, extra columns and empty tables need no special care.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scoped

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS, CACHE_LENGTH, TABLE_ARCS = 400_000, 48, 2_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """Compiled merges of a byte-level vocabulary file."""

    def __init__(self, vocab: dict[str, int], merges: list, specials: dict[str, int] | None = None):
        chars = byte_alphabet()
        self.labels: dict[int, bytes] = {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
        size = max(self.labels, default=-1) + 1
        self.target, self.left, self.right, self.time = [0] * size, [-1] * size, [-1] * size, [-1] * size  # by token
        self.owner = [-1]  # by state; a state's number is the time of its gadget, 0 the start
        self.gadget: dict[int, int] = {}  # (token, arc it lost) -> time
        for c in chars:
            self.time[vocab[c]] = 0
        for n, merge in enumerate(merges, 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.owner.append(a)
            if self.time[c] >= 0:
                raise ValueError(f"two merges make token {c}")
            if self.time[a] < 0 or self.time[b] < 0 or not self.arc(self.target[a], b):
                continue  # its parts never meet
            self.time[c], self.left[c], self.right[c], self.target[c] = n, a, b, self.target[b]
            self.gadget[a << 20 | b] = self.target[a] = n
        self.table: dict[int, bool] = {}
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at: list[int] = [-1]
        for t, label in self.labels.items():
            if self.time[t] >= 0:
                node = 0
                for byte in label:
                    key = node << 8 | byte
                    if (nxt := self.trie.get(key)) is None:
                        nxt = self.trie[key] = len(self.token_at)
                        self.token_at.append(-1)
                    node = nxt
                self.token_at[node] = t
        self.size = {t: len(label) for t, label in self.labels.items()}
        self.whole = {label: t for t, label in self.labels.items() if self.time[t] >= 0}
        self.specials = specials or {}
        self.labels |= {i: s.encode() for s, i in self.specials.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.split = regex.compile(PATTERN)
        self.odd_space = regex.compile(r"(?<= )\s")
        self.cache: dict[str, bytes] = {}  # pieces of text between spaces
        self.words: dict[str, bytes] = {}

    def arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc for ``token``: no gadget of its time took it, or the left part it stands for."""
        time, left, right, gadget = self.time, self.left, self.right, self.gadget
        owner, until = self.owner[state], state
        while owner >= 0:
            part, before, high = token, 1 << 40, owner << 20
            while part >= 0:
                n = gadget.get(high | part)
                if n is not None and n <= until and n <= before:  # equal: a token doubled
                    return False
                before, part = time[part], left[part]
            until, owner = time[owner] - 1, right[owner]
        return True

    def _matches(self, word: bytes, i: int) -> list[int]:
        """Tokens that start at byte ``i``, shorter ones first."""
        trie, token_at, found, node = self.trie, self.token_at, [], 0
        for byte in word[i:] if i else word:
            node = trie.get(node << 8 | byte)
            if node is None:
                break
            if (t := token_at[node]) >= 0:
                found.append(t)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Follow arcs to the word's end, longer ones first.

        One path only reaches a byte position, so a position that leads nowhere is never visited again: the work is
        linear in the word.
        """
        if (t := self.whole.get(word)) is not None:
            return [t]
        n, size, target, table = len(word), self.size, self.target, self.table
        at, states, choices, out, dead = [0], [0], [self._matches(word, 0)], [], set()
        while at[-1] < n:
            i, here, open_arcs = at[-1], states[-1], choices[-1]
            while open_arcs:
                t = open_arcs.pop()
                j = i + size[t]
                if j in dead:
                    continue
                key = here << 20 | t
                if (ok := table.get(key)) is None:
                    if len(table) >= TABLE_ARCS:
                        table.clear()
                    ok = table[key] = self.arc(here, t)
                if ok:
                    at.append(j)
                    states.append(target[t])
                    choices.append(self._matches(word, j))
                    out.append(t)
                    break
            else:
                dead.add(i)
                at.pop()
                states.pop()
                choices.pop()
                out.pop()
        return out

    def _piece(self, piece: str) -> bytes:
        """Ids (little-endian, 32 bits) of a piece of text that no word crosses."""
        words, out = self.words, b""
        for w in self.split.findall(piece):
            if (got := words.get(w)) is None:
                ids = self.encode_word(w.encode())
                got = struct.pack(f"<{len(ids)}I", *ids)
                if len(w) <= CACHE_LENGTH:
                    if len(words) >= CACHE_WORDS:
                        words.clear()
                    words[w] = got
            out += got
        return out

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd_space.search(text):  # runs of space are split as a whole
            return b"".join(self._cached(w) for w in self.split.findall(text))
        # a lone space starts the next word and can't be part of one before it: pieces are independent
        head, *rest = text.split(" ")
        return self._cached(head) + b"".join([self._cached(" " + p) for p in rest]) if rest else self._cached(head)

    def _cached(self, piece: str) -> bytes:
        cache = self.cache
        if (got := cache.get(piece)) is None:
            got = self._piece(piece)
            if len(piece) <= CACHE_LENGTH:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[piece] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self.cut.split(text)
        return np.frombuffer(b"".join(np.array([self.specials[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)), "<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> TokenAutomaton:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return TokenAutomaton(spec["model"]["vocab"], spec["model"]["merges"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])})


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``documents -> (doc_id, ids array<int>)``."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        auto = load(path)
        for b in batches:
            ids = [auto.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return scoped(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, ids) -> (doc_id, text)``."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        auto = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([auto.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return scoped(tokens, "doc_id", "ids").select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode and decode every text; per document the number of tokens and digests of the ids and of the decoded text."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        auto = load(path)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for text in b.column(1):
                ids = auto.encode(text.as_py())
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_hex.append(hashlib.sha256(auto.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return scoped(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
