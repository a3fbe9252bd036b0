"""Ranked lexical search: each item's best documents, found by grouping documents by the terms they hold.

Every document is read once and keeps only the terms that some item asks for; a table of these counts gives the corpus
statistics. Then each task takes a batch of documents as a block and works item by item:

1. the postings of the item's terms give each term's largest contribution in the block;
2. terms that together stay below the task's tenth score so far can't lift a document by themselves: only documents with
   one of the other terms are candidates (a union of bitmaps);
3. the candidates' presence bits are packed into masks, and equal masks form a group with one upper bound, the sum of
   its terms' largest contributions;
4. groups are scored exactly by descending bound, until ten scores lie above what the next group can reach.

Documents never move; a task hands on ``k`` rows an item. Items are taken in blocks of about ``MAX_TERMS`` terms, which is what
is broadcast; an item's own terms must fit a task.

Defined cases: null and blank texts have no term; an item without terms, or whose terms no document holds, has no rows;
rows of one ``item_id`` (null is an id) are one item with the terms of all; each document row counts by itself, so repeated rows are
repeated results; a document without ``doc_id`` counts in the statistics but isn't ranked, as it can't be named; texts are
cut into pieces at separators, so their length isn't bounded by memory for tokens. Columns but the named ones are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scoped

#: Distinct terms (over all items) that one reading of the documents serves.
MAX_TERMS = 200_000
#: Bytes of text that are split into terms at a time.
PIECE = 1 << 20
#: Cells of an item's presence table (candidates times terms) that are held at a time.
CELLS = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms stay (letters lower-cased), the others become a space.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))

COUNTS = "doc_id long, n long, terms array<int>, tfs array<long>"
HITS = "item_id long, doc_id long, score long"


def term_counts(text: str | None, numbers: dict[bytes, int]) -> tuple[int, Counter]:
    """Terms of a text with repeats, and how often those of ``numbers`` occur in it."""
    raw = (text or "").encode().translate(_FOLD)
    n, found, at = 0, Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        terms = raw[at : end if end >= 0 else len(raw)].split()
        n += len(terms)
        found.update([t for t in map(numbers.get, terms) if t is not None])
        at = end if end >= 0 else len(raw)
    return n, found


def _counts(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: of each document the number of terms, and the counts of the numbered ones."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        for b in batches:
            rows = [term_counts(t.as_py(), shared.value) for t in b.column(1)]
            lists = [pa.array([list(part(found)) for _, found in rows], kind) for part, kind in ((Counter.keys, pa.list_(pa.int32())), (Counter.values, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in rows], pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, COUNTS)


def _lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length part ``m`` of the score, in whole numbers."""
    if int(n.max(initial=0)) * 90 * n_docs < 2**63:
        return 10 + 90 * n * n_docs // n_terms
    return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)


class Best:
    """The ``k`` best documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """The least score that can still enter; equal scores may, by their id."""
        return self.rows[-1][0] * -1 if len(self.rows) == self.k else 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        near = scores >= self.floor
        self.rows = sorted([*self.rows, *zip((-scores[near]).tolist(), ids[near].tolist())])[: self.k]


def search_block(best: Best, ids: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Adds a block's documents to an item's best. ``postings``: for each term of the item the documents (places in ``ids``)
    that hold it and what it adds to their scores (above zero)."""
    postings = sorted((p for p in postings if len(p[0])), key=lambda p: int(p[1].max()))
    tops = np.array([int(gains.max()) for _, gains in postings], np.int64)
    reach = np.cumsum(tops)
    if not len(reach) or reach[-1] < best.floor:
        return
    first = int(np.searchsorted(reach, best.floor))  # the terms before it can't reach the floor together
    candidate = np.zeros(len(ids), bool)
    for rows, _ in postings[first:]:
        candidate[rows] = True
    all_rows = np.flatnonzero(candidate)
    step = max(1, CELLS // len(postings))
    for lo in range(0, len(all_rows), step):
        rows = all_rows[lo : lo + step]
        place = np.full(len(ids), -1)
        place[rows] = np.arange(len(rows))
        gains = np.zeros((len(rows), len(postings)), np.int64)
        for j, (held_by, gain) in enumerate(postings):
            at = place[held_by]
            gains[at[at >= 0], j] = gain[at >= 0]
        bits = np.packbits(gains > 0, axis=1)
        masks, group = np.unique(bits.view(f"V{bits.shape[1]}").ravel(), return_inverse=True)
        present = np.unpackbits(masks.view(np.uint8).reshape(len(masks), -1), axis=1)[:, : len(postings)]
        bound = present.astype(np.int64) @ tops
        by_bound = np.argsort(-bound, kind="stable")
        order = np.empty(len(masks), np.int64)
        order[by_bound] = np.arange(len(masks))
        by_group = np.argsort(order[group], kind="stable")
        ends = np.cumsum(np.bincount(order[group], minlength=len(masks)))
        done, chunk = 0, 64
        while done < len(masks) and bound[by_bound[done]] >= best.floor:
            start = int(ends[done - 1]) if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, start + chunk)))
            docs = by_group[start : int(ends[min(upto, len(masks)) - 1])]
            best.add(ids[rows[docs]], gains[docs].sum(axis=1))
            done, chunk = upto, chunk * 4


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, max_terms: int = MAX_TERMS) -> DataFrame:
    """The ``k`` best documents of each item: ``documents (doc_id, text), items (item_id, text) -> (item_id, rank, doc_id, score)``."""
    spark = docs.sparkSession
    asked = scoped(items, "item_id", "text").select(F.col("item_id").cast("long"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), 0)).alias("term")).distinct()
    asked = materialize(asked, "item-terms")
    n_blocks = -(-asked.count() // max_terms)
    texts = scoped(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    hits = spark.createDataFrame([], HITS)
    for block in range(n_blocks):
        of_block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).groupBy("item_id").agg(F.collect_list("term").alias("terms"))
        item_terms = [(r.item_id, [t.encode() for t in r.terms]) for r in of_block.collect()]
        if item_terms:
            hits = hits.unionByName(_rank_block(texts, item_terms, k))
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))
    return best.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _rank_block(texts: DataFrame, item_terms: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    numbers = {t: i for i, t in enumerate(sorted({t for _, terms in item_terms for t in terms}))}
    counts = materialize(_counts(texts, numbers), "term-counts")
    total = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total.docs, total.terms or 0
    weights = np.zeros(len(numbers), np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[r.t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    # terms of weight zero add nothing
    wanted = [(i, np.array([x for t in terms if weights[x := numbers[t]] > 0], np.int64)) for i, terms in item_terms]
    shared = texts.sparkSession.sparkContext.broadcast((wanted, weights))

    def run(batches):
        asked, weight = shared.value
        best = [Best(k) for _ in asked]
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            held = b.column(2)
            term, tf = held.flatten().to_numpy(), b.column(3).flatten().to_numpy()
            row = np.repeat(np.arange(len(ids)), held.value_lengths().to_numpy())
            m = _lengths(n, n_docs, n_terms) if n_terms else n
            gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            row, term, gain = row[gain > 0], term[gain > 0], gain[gain > 0]
            by_term = np.argsort(term, kind="stable")
            row, gain = row[by_term], gain[by_term]
            edge = np.searchsorted(term[by_term], np.arange(len(weight) + 1))
            for (_, terms), found in zip(asked, best):
                search_block(found, ids, [(row[edge[t] : edge[t + 1]], gain[edge[t] : edge[t + 1]]) for t in terms])
        rows = [(i, d, -s) for (i, _), found in zip(asked, best) for s, d in found.rows]
        for lo in range(0, len(rows), 50_000):
            part = rows[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], pa.int64()) for j in range(3)], names=["item_id", "doc_id", "score"])

    return counts.where("doc_id is not null").mapInArrow(run, HITS)
