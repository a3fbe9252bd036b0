"""T13 with a dictionary: the likeliest path through the lattice of words over each run of ideographs.

The dictionary is a table of words with their frequencies. In a task it is a prefix table: every beginning of a word is a key, so the
words that start at a place are found by growing a fragment until it begins no word. A path's weight is the sum of its words' log
probabilities in units of 2^-32, so that equal paths are equal in whichever order words are added; of these the one with the longer first word stands. A place where no
word starts is a word of one code point. Work is linear in the text times the longest word.

Tasks do this for many runs at once (``Lattice``): the beginnings are numbered nodes with a table of steps, fragments grow at all places
together, and runs are cut into pieces at places that no word spans, so that pieces are weighed side by side.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a dictionary at most: it is held in every task.
MAX_WORDS = 2_000_000
#: Parts of one in which log probabilities are counted.
UNIT = 1 << 32
#: Code points that are segmented at a time, and cells up to which the table of steps is held whole.
SEGMENTED_CHARS, WHOLE_CELLS = 1 << 18, 1 << 22
_RUN, _ASCII = re.compile("[一-鿿]+"), re.compile("[A-Za-z0-9]+")
_EITHER = re.compile(f"{_RUN.pattern}|{_ASCII.pattern}")


def prefix_table(words: dict[str, int]) -> tuple[dict[str, int], float]:
    """Frequencies of words and of their beginnings (0 where these are no words), and the logarithm of the sum."""
    table: dict[str, int] = {}
    for w, n in words.items():
        for k in range(1, len(w)):
            table.setdefault(w[:k], 0)
        table[w] = n
    return table, math.log(max(1, sum(words.values())))


def _weight(freq: int, log_total: float) -> int:
    return round((math.log(freq) - log_total) * UNIT)


class Lattice:
    """A prefix table as arrays. Node 0 is the empty beginning; ``weight`` is 1 where a beginning is no word."""

    def __init__(self, table: dict[str, int], log_total: float):
        node = {"": 0} | {w: k for k, w in enumerate(table, 1)}
        self.letters = np.array(sorted({ord(w[-1]) for w in table}), np.int64)
        self.unknown = _weight(1, log_total)
        self.weight = np.array([1, *(_weight(n, log_total) if n else 1 for n in table.values())], np.int64)
        before = np.array([node[w[:-1]] for w in table], np.int64)
        cells = before * len(self.letters) + np.searchsorted(self.letters, np.array([ord(w[-1]) for w in table], np.int64))
        order = np.argsort(cells)
        self.cells, self.to, self.whole = cells[order], order + 1, None
        if len(node) * len(self.letters) <= WHOLE_CELLS:
            self.whole = np.full(len(node) * len(self.letters), -1, np.int32)
            self.whole[cells] = np.arange(1, len(node))

    def _step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes one letter (-1: none of the dictionary's) further, -1 where no word goes on so."""
        cells = nodes * len(self.letters) + letters
        if self.whole is not None:
            return np.where(letters < 0, -1, self.whole[cells])
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        return np.where((letters >= 0) & (self.cells[at] == cells), self.to[at], -1)

    def _words(self, letters: np.ndarray, ends: np.ndarray):
        """``(length, starts, weights)`` by ascending length: the words in runs that end at ``ends`` (for each place)."""
        at, node, k = np.arange(len(letters)), np.zeros(len(letters), np.int64), 0
        while len(at):
            node = self._step(node, letters[at + k])
            k, goes = k + 1, np.flatnonzero(node >= 0)
            at, node = at[goes], node[goes]
            weight = self.weight[node]
            word = np.flatnonzero(weight <= 0)
            yield k, at[word], weight[word]
            goes = np.flatnonzero(at + k < ends[at])
            at, node = at[goes], node[goes]

    def segment(self, runs: list[str]) -> list[list[str]]:
        """``segment`` for each run (none is empty)."""
        joined = "".join(runs)
        if not joined or not len(self.letters):
            return [list(r) for r in runs]
        points, n = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64), len(joined)
        code = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        bounds = np.cumsum([len(r) for r in runs])
        reach, sizes, found = np.arange(1, n + 1), np.zeros(n, np.int64), []
        for k, at, weight in self._words(np.where(self.letters[code] == points, code, -1), np.repeat(bounds, np.diff(bounds, prepend=0))):
            reach[at] = at + k
            sizes[at] += 1
            found.append((k, at, weight))
        bare = np.flatnonzero(sizes == 0)
        sizes[bare] = 1
        found.append((1, bare, np.full(len(bare), self.unknown)))
        # pieces end where no earlier word reaches beyond; a place's level is its distance from there
        opens = np.maximum.accumulate(reach) <= np.arange(1, n + 1)
        stops = 1 + np.flatnonzero(opens)
        level = np.repeat(stops, np.diff(stops, prepend=0)) - np.arange(n)
        place = np.argsort(level.astype(np.uint16) if level.max() < 1 << 16 else level, kind="stable")
        ends = np.cumsum(sizes[place])
        first = ends - sizes[place]  # of a place's words, in the order of places
        slot = np.empty(n, np.int64)
        slot[place] = first
        length, weight, to = (np.empty(ends[-1], np.int64) for _ in range(3))
        for k, at, w in found:
            s = slot[at]
            length[s], weight[s], to[s] = k, w, at + k
            slot[at] += 1
        levels = np.searchsorted(level[place], np.arange(1, level.max() + 2)).tolist()
        best, step = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
        behind = np.append(0, np.where(opens, 0, 1))[to]  # 0: nothing is behind a piece's end
        for lo, hi in zip(levels[:-1], levels[1:]):
            a, z = first[lo], ends[hi - 1]
            total = weight[a:z] + best[to[a:z]] * behind[a:z]
            top = np.maximum.reduceat(total, first[lo:hi] - a)
            best[place[lo:hi]] = top
            step[place[lo:hi]] = np.maximum.reduceat(np.where(total == np.repeat(top, sizes[place[lo:hi]]), length[a:z], 0), first[lo:hi] - a)
        begins, at = np.zeros(n + 1, bool), np.append(0, stops[:-1])
        while len(at):
            begins[at] = True
            at = at + step[at]
            at = at[~opens[at - 1]]
        begins[n] = True
        words = np.flatnonzero(begins)
        cut = [joined[i:j] for i, j in zip(words[:-1].tolist(), words[1:].tolist())]
        edges = np.searchsorted(words, np.append(0, bounds)).tolist()
        return [cut[i:j] for i, j in zip(edges[:-1], edges[1:])]


def dictionary(words: DataFrame) -> Broadcast:
    """``(word, freq)`` for tasks; repeated words add up, words without frequency go. More than ``MAX_WORDS`` are refused."""
    rows = words.where("word <> '' and freq > 0").groupBy("word").agg(F.sum("freq").alias("freq")).limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"a dictionary holds {MAX_WORDS} words at most")
    return words.sparkSession.sparkContext.broadcast(Lattice(*prefix_table({r.word: int(r.freq) for r in rows})))


def segment(run: str, table: dict[str, int], log_total: float) -> list[str]:
    """Words of the likeliest path."""
    n = len(run)
    best, end = [0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        paths, k = [], i + 1
        while k <= n and (freq := table.get(run[i:k])) is not None:
            if freq:
                paths.append((_weight(freq, log_total) + best[k], k))
            k += 1
        best[i], end[i] = max(paths, default=(best[i + 1] + _weight(1, log_total), i + 1))
    out, i = [], 0
    while i < n:
        out.append(run[i : end[i]])
        i = end[i]
    return out


def segmented_tokens(x: Column, words: Broadcast) -> Column:
    """ASCII words and segmented runs as they stand, then the ASCII words in lower case; null has none."""

    @F.arrow_udf("array<string>")
    def tokens(column: pa.Array) -> pa.Array:
        lattice, out, lo = words.value, [], 0
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(), dtype=np.int64)
        while lo < len(column):  # so many texts at a time that their code points stay bounded
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SEGMENTED_CHARS, side="right")))
            found = [_EITHER.findall(text or "") for text in column.slice(lo, hi - lo).to_pylist()]
            runs = iter(lattice.segment([m for ms in found for m in ms if m[0] >= "一"]))
            whole = [[t for m in ms for t in (next(runs) if m[0] >= "一" else (m,))] + [m.lower() for m in ms if m[0] < "一"] for ms in found]
            out.append(pa.array(whole, pa.list_(pa.string())))
            lo = hi
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return tokens(x)
