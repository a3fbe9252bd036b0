"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenised (plus an end token) and only those longer than a sequence are cut. The pieces are dealt evenly
over partitions; each partition packs its own by best-fit decreasing. Dual feasible functions give lower bounds on the
bins any packing of those pieces needs: a partition whose count equals its bound is certified. Partitions with a gap, and
bins left badly filled anywhere, exchange their pieces: they are dealt anew and packed again, into partitions twice as
large (``PARTITION_PIECES`` times 16 at most), until one holds what is left or the rounds are over: beyond about a million pieces
the last round is split and may leave gaps. Full bins stay where they are.

Defined cases: null and empty texts are one end token; repeated rows are packed each; an empty table packs to nothing.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scoped

CAPACITY, END_TOKEN = 4096, 1
#: Pieces of one partition, on average, and the share of a bin that may stay empty without being dealt again.
PARTITION_PIECES, SLACK = 65_536, 1 / 64
CACHE_WORDS, CACHE_LENGTH = 500_000, 64
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCache:
    """Ids by white-space separated piece: the tokenizer drops white space, so pieces are independent of one another.

    It lower-cases too, so ASCII letters are lowered before the look-up, but for texts that may hold special tokens.
    A piece of letters and then marks is two words to it; words of letters are encoded many at a time, as the last token
    of each says that it is. Pieces not met since the cache was last full are dropped.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > CACHE_WORDS:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        split, found, missing, new = [], [], [], {}
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            words = (raw if b"<|" in raw else raw.lower()).split()
            ids = list(map(known.get, words))
            gaps = [k for k, x in enumerate(ids) if x is None] if None in ids else []
            for k in gaps:
                w = words[k]
                if w in before:
                    known[w] = before[w]
                else:
                    new[w] = b""
            split.append(words)
            found.append(ids)
            missing.append(gaps)
        whole, parts = {}, {}
        for w in new:
            m = _LETTERS.fullmatch(w.decode("utf-8", "surrogatepass"))
            if m:
                parts[w] = m[1].encode(), m[2].encode()
            for x in parts.get(w, (w,)):
                if x and x not in known and x not in before:
                    whole[x] = m is not None and x == parts[w][0]
        self._encode_words([x for x, letters in whole.items() if letters], [x for x, letters in whole.items() if not letters])
        known = self.known
        for w in new:
            new[w] = b"".join([known[x] if x in known else before[x] for x in parts.get(w, (w,)) if x])
        known.update((w, x) for w, x in new.items() if len(w) <= CACHE_LENGTH)
        for words, ids, gaps in zip(split, found, missing):
            for k in gaps:
                ids[k] = new.get(words[k]) or known.get(words[k], b"")
        for w in [w for w in whole if len(w) > CACHE_LENGTH]:
            del known[w]
        return list(map(b"".join, found))

    def _encode_words(self, letters: list[bytes], others: list[bytes]) -> None:
        for lo in range(0, len(letters), 2048):
            part = letters[lo : lo + 2048]
            ids = np.array(self.tok.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(part):  # a letter that lower case or composition makes more of
                others = others + part
                continue
            raw = ids.tobytes()
            for w, s, e in zip(part, [0, *last[:-1].tolist()], last.tolist()):
                self.known[w] = raw[4 * s : 4 * e]
        for lo in range(0, len(others), 2048):
            part = others[lo : lo + 2048]
            for w, e in zip(part, self.tok.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False)):
                n = e.ids
                self.known[w] = struct.pack(f"<{len(n)}I", *n)


#: Letters (but the one that lower case makes two of), then ASCII marks.
_LETTERS = regex.compile(r"(?V1)([\p{L}--[İ]]+)([!-/:-@\[-`{-~]*)")


@lru_cache(maxsize=4)
def load(path: str) -> WordCache:
    return WordCache(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_token: int = END_TOKEN) -> DataFrame:
    """``documents -> (doc_id, piece, start, length, ids_crc32)``."""
    path, end = tokenizer or default_tokenizer(), np.array([end_token], "<u4").tobytes()

    def run(batches):
        cache = load(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids = b.column(0).slice(lo, 256).to_pylist()
                rows = []
                for doc, raw in zip(ids, cache.encode_all(b.column(1).slice(lo, 256).to_pylist())):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return scoped(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by two families of dual feasible functions over the histogram of sizes."""
    if not len(sizes):
        return 0
    x, n = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    best = -(-int((x * n).sum()) // capacity)
    for eps in np.unique(np.minimum(x, capacity - x)):  # sizes over capacity - eps count whole, those under eps nothing
        if 0 < eps <= capacity // 2:
            f = np.where(x > capacity - eps, capacity, np.where(x >= eps, x, 0))
            best = max(best, -(-int((f * n).sum()) // capacity))
    for k in range(1, 33):  # rounding to multiples of 1 / k
        whole, rest = np.divmod((k + 1) * x, capacity)
        # in units of 1 / (k * capacity): exact multiples keep their size, others are rounded down
        f = np.where(rest == 0, k * x, whole * capacity)
        best = max(best, -(-int((f * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; the bin with the least room that still fits takes it."""
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = opened = 0  # bit r is set while a bin has room r
    for i in order.tolist():
        s = int(sizes[i])
        if fit := rooms >> s:
            room = s + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, opened = opened, capacity, opened + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - s:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def _packer(turn: int, last: bool, capacity: int):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, weights=sizes)
        gap = len(used) - lower_bound(sizes, capacity)
        # in a partition with a gap all but full bins go on, elsewhere only badly filled ones
        room = capacity - used
        again = np.zeros(len(used), bool) if last else (room > 0 if gap > 0 else room > capacity * SLACK)
        pdf["sequence_id"] = (turn << 56) + (int(pdf["_part"].iloc[0]) << 32) + bins
        pdf["offset"], pdf["_again"], pdf["_gap"] = offsets, again[bins], gap
        return pdf.drop(columns="_part")

    return packed


def pack(items: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, max_rounds: int = 5) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``length`` at most ``capacity``)."""
    columns = items.columns
    todo, done = materialize(items, "pieces"), []
    for turn in range(max_rounds):
        n = todo.count()
        parts = max(1, -(-n // (partition_pieces << turn)))
        last = parts == 1 or turn == max_rounds - 1
        dealt = todo.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)))

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long, _again boolean, _gap long"
        out = materialize(dealt.groupBy("_part").applyInPandas(_packer(turn, last, capacity), schema), "packed")
        done.append(out.where("not _again").drop("_again", "_gap"))
        if last:
            break
        todo = out.where("_again").select(*columns)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """``documents -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    return pack(pieces(docs, capacity, tokenizer), capacity)
