"""Spelling variants: frequent words that differ by one code point, grouped under their most frequent spelling.

Words are counted in Spark (combined before the shuffle). The vocabulary, the words that occur often enough, is put into blocked Bloom filters,
one or more for each length. A word's deletions and replacements are probed there by their hashes alone, which follow
from the word's hash in constant time each (a polynomial modulo 2^64); strings are built only for positives, and those
are shuffled to an exact join with the vocabulary, which removes false positives. Links are symmetric, so deletions
stand for insertions too, and only replacements by a larger code point are tried.

Filters are broadcast in passes of ``MAX_FILTER_BYTES`` at most, however large the vocabulary is: a length with many words has
several filters, by hash, and each pass probes the edits that fall into its filters. Words of over 64 code points share
filters with three independent layers, since they have many edits.

Forms lead to words at least five times as frequent, so chains have fewer than 28 steps; roots are found by pointer doubling.

Defined cases: null and empty texts have no runs; a null ``doc_id`` counts as an empty string where runs are hashed; repeated
rows count each time; runs may be as long as a text; no frequent words: an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scoped

MIN_LENGTH, MIN_COUNT, FORM_RATIO, SLIP = 6, 5, 5, 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points that words consist of.
ALPHABET = np.array([*map(ord, LOWER), *range(0xC0, 0x100)], np.uint64)
#: Lengths up to this have filters of their own.
LONG = 64
FILTER_WORDS, MAX_FILTER_BYTES = 1 << 18, 64 << 20
BITS_A_WORD, LONG_LAYERS = 24, 3
#: Places of words (times the alphabet) that are probed at a time.
PLACES = 8192
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_counts(docs: DataFrame) -> DataFrame:
    """``documents -> (word, n)``: words of ``MIN_LENGTH`` code points or more that occur ``MIN_COUNT`` times or more.

    Shorter runs can't become words, so the pattern passes over them.
    """
    run = F.col("run")
    runs = scoped(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(r"[a-zÀ-ÿ]{%d,}" % MIN_LENGTH), F.lit(0))).alias("run")
    )
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), run)).alias("h"))
    at = (F.col("h") % F.length(run)).cast("int")
    slipped = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    words = hashed.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(run).alias("word"))
    return words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- hashes of words and of their edits ------------------------------------------------------------------------------


def mix(x: np.ndarray, layer: int = 0) -> np.ndarray:
    x = x ^ np.uint64(layer * 0xD1342543DE82EF95 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Code points of a list of words end to end, with powers and prefix sums of the polynomial at every place."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.length = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(self.codes)) - start[self.word]
        powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(int(self.length.max(initial=1)), BASE, np.uint64))))
        self.power = powers[self.place]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.codes * self.power)))
        self.before = sums[:-1] - sums[start][self.word]
        self.hash = sums[start + self.length] - sums[start]
        #: the first of equal code points in a row: deleting another of them gives the same word
        self.first = np.ones(len(self.codes), bool)
        self.first[1:] = (self.codes[1:] != self.codes[:-1]) | (self.place[1:] == 0)

    def key(self) -> np.ndarray:
        return self.hash + self.length.astype(np.uint64)

    def deletions(self, at: np.ndarray) -> np.ndarray:
        w = self.word[at]
        rest = (self.hash[w] - self.before[at] - self.codes[at] * self.power[at]) * INVERSE
        return self.before[at] + rest + (self.length[w] - 1).astype(np.uint64)

    def replacements(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of keys for each place, a column for each code point; and which of them are larger than what stands there."""
        w, codes = self.word[at], self.codes[at][:, None]
        keys = (self.hash[w] + self.length[w].astype(np.uint64))[:, None] + (ALPHABET[None, :] - codes) * self.power[at][:, None]
        return keys, ALPHABET[None, :] > codes


# --- filters -----------------------------------------------------------------------------------------------------------


def length_class(length: np.ndarray | int):
    return np.minimum(length, LONG + 1)


def layers_of(cls: int) -> int:
    return LONG_LAYERS if cls > LONG else 1


def _places(keys: np.ndarray, layer: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's block of 64 bits, and its four bits there."""
    h = mix(keys, layer + 1)
    bits = np.zeros(len(h), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), bits


def filter_blocks(n: int) -> int:
    return max(1, -(-n * BITS_A_WORD // 64))


def build_filter(keys: np.ndarray, cls: int) -> np.ndarray:
    blocks = filter_blocks(len(keys))
    out = np.zeros((layers_of(cls), blocks), np.uint64)
    for layer in range(len(out)):
        np.bitwise_or.at(out[layer], *_places(keys, layer, blocks))
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that the filter may hold."""
    left = np.arange(len(keys))
    for layer in range(len(bits)):
        block, mask = _places(keys[left], layer, bits.shape[1])
        left = left[bits[layer][block] & mask == mask]
    return left


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys) >> np.uint64(33)).astype(np.int64) % n


class Filters:
    """The filters of one pass, and how many each length has."""

    def __init__(self, shards: dict[int, int], bits: dict[tuple[int, int], np.ndarray]):
        self.shards, self.bits = shards, bits

    def held(self, keys: np.ndarray, cls: int) -> np.ndarray:
        n = self.shards.get(cls, 0)
        mine = [s for s in range(n) if (cls, s) in self.bits]
        if n == 1 and mine:
            return in_filter(self.bits[cls, 0], keys)
        shard = shard_of(keys, n) if mine else None
        found = [at[in_filter(self.bits[cls, s], keys[at])] for s in mine for at in [np.flatnonzero(shard == s)]]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def positives(words: list[str], filters: Filters):
    """(place in ``words``, edit) for each edit that the filters may hold."""
    by_class: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_class.setdefault(min(len(w), LONG + 2), []).append(i)
    for g, members in by_class.items():
        x = Words([words[i] for i in members])
        for lo in range(0, len(x.codes), PLACES):
            at = np.arange(lo, min(lo + PLACES, len(x.codes)))
            if g > MIN_LENGTH:
                gone = at[x.first[at]]
                for j in filters.held(x.deletions(gone), int(length_class(g - 1))).tolist():
                    w, p = members[x.word[gone[j]]], int(x.place[gone[j]])
                    yield w, words[w][:p] + words[w][p + 1 :]
            keys, larger = x.replacements(at)
            row, column = np.nonzero(larger)
            for j in filters.held(keys[row, column], int(length_class(g))).tolist():
                w, p = members[x.word[at[row[j]]]], int(x.place[at[row[j]]])
                yield w, words[w][:p] + chr(int(ALPHABET[column[j]])) + words[w][p + 1 :]


# --- links, forms, roots -----------------------------------------------------------------------------------------------


def _keyed(batches):
    for b in batches:
        x = Words(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length_class(x.length).astype(np.int32)), pa.array(x.key().view(np.int64))], names=["word", "n", "cls", "key"])


def near_pairs(vocabulary: DataFrame, filter_words: int = FILTER_WORDS, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``(word, n, cls, key) -> (word, n, near, near_n)``: every pair of near words once, the longer or smaller one first."""
    spark = vocabulary.sparkSession
    sizes = {r.cls: r["count"] for r in vocabulary.groupBy("cls").count().collect()}  # 60 rows at most
    shards = {cls: -(-n // filter_words) for cls, n in sizes.items()}
    passes: list[list[tuple[int, int]]] = [[]]
    room = max_bytes
    for cls, n in shards.items():
        need = 8 * layers_of(cls) * filter_blocks(-(-sizes[cls] // n))
        for s in range(n):
            if need > room and passes[-1]:
                passes.append([])
                room = max_bytes
            passes[-1].append((cls, s))
            room -= need

    def shard(batches):
        for b in batches:
            keys, cls = b.column(1).to_numpy().view(np.uint64), b.column(0).to_numpy()
            n = np.array([shards[c] for c in cls.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shard_of(keys, n).astype(np.int32)), b.column(1)], names=["cls", "shard", "key"])

    def build(table: pa.Table) -> pa.Table:
        cls = table["cls"][0].as_py()
        bits = build_filter(table["key"].to_numpy().view(np.uint64), cls)
        return pa.table({"cls": pa.array([cls], pa.int32()), "shard": table["shard"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    built = vocabulary.select("cls", "key").mapInArrow(shard, "cls int, shard int, key long").groupBy("cls", "shard").applyInArrow(build, "cls int, shard int, bits binary")
    built = materialize(built, "filters")
    found = None
    for wanted in passes:
        rows = built.where(F.struct("cls", "shard").isin([F.struct(F.lit(c), F.lit(s)) for c, s in wanted])).collect() if len(passes) > 1 else built.collect()
        bits = {(r.cls, r.shard): np.frombuffer(r.bits, np.uint64).reshape(layers_of(r.cls), -1) for r in rows}
        found = (lambda x: x if found is None else found.unionByName(x))(_probe(vocabulary, spark.sparkContext.broadcast(Filters(shards, bits))))
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(known, "near").select("word", "n", "near", "near_n")


def _probe(vocabulary: DataFrame, filters) -> DataFrame:
    def probe(batches):
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows, size = [], 0
            for w, edit in positives(words, filters.value):
                rows.append((words[w], n[w], edit))
                size += 2 * len(edit)
                if size > 1 << 22:
                    yield _hits(rows)
                    rows, size = [], 0
            yield _hits(rows)

    return vocabulary.select("word", "n").mapInArrow(probe, "word string, n long, near string")


def _hits(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["word", "n", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """``(word, form) -> (word, root)``: the last word of each chain, by pointer doubling."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        up = materialize(up.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if up.where("_moved").isEmpty():
            return up.drop("_moved")
        up = up.drop("_moved")


def variants(docs: DataFrame, filter_words: int = FILTER_WORDS, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``documents -> (word, form, root, n, n_near, form_n)``, one row for each word of the vocabulary."""
    vocabulary = materialize(word_counts(docs).mapInArrow(_keyed, "word string, n long, cls int, key long"), "vocabulary")
    pairs = materialize(near_pairs(vocabulary, filter_words, max_bytes), "near-words")
    there, back = F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.select(F.explode(F.array(there, back)).alias("p")).select("p.*")
    best: Column = F.min(F.when(F.col("near_n") >= FORM_RATIO * F.col("n"), F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))))
    near = materialize(both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.minus")).alias("form_n")), "forms")
    last = roots(near.where("form is not null"))
    out = vocabulary.select("word", "n").join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
