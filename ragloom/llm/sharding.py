"""Sharding: all documents in a uniformly random order, cut into shards whose row counts differ by one at most.

A communication matrix says how many rows of each partition go to each shard. Its rows sum to the partitions' sizes and
its columns to the shards' sizes, which are fixed beforehand; under these sums it is hypergeometric. It is never held
whole: a tree over the partitions splits the shards' sizes between the left and the right half at each node, and a task
walks from the root to its own leaf. Each node has its own random stream, so every task that passes it draws the same
split, and a task that is run again draws the same row of the matrix.

1. Rows are written once with their partition and place, so that later steps, and repeated tasks, see the same partitions.
2. A task draws its row of the matrix and deals the shard numbers to its rows in random order (the local permutation).
3. Rows are exchanged by shard and block: a shard is cut into blocks of about ``BLOCK_ROWS`` rows by random keys, so that no
   task gathers a shard. A table of the blocks' sizes gives each block's first slot.
4. Within its block a row's slot follows from the order of the random keys (the second permutation).

What goes to the driver is one number for each partition of the input, as Spark's own task list holds.

Defined cases: null and empty texts are rows like others; equal texts and repeated rows are dealt independently; nulls in
any column stay; the input's columns come back inside one struct, so their names can't clash; fewer rows than
shards leave the last shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 24
BLOCK_ROWS = 4096
#: Populations above this are beyond NumPy's sampler.
NUMPY_MOST = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without return are good. Large populations: inversion of the distribution around its mode."""
    if not (good and bad and n and n < good + bad):
        return good if n >= good + bad else min(n, good) if not bad else 0
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    deviation = (n * (good / total) * (bad / total) * ((total - n) / total)) ** 0.5
    reach = int(12 * deviation) + 30
    lo, hi = max(0, n - bad, mode - reach), min(n, good, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)
    ratio = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    log_mass = np.concatenate(([0.0], np.cumsum(ratio)))
    mass = np.cumsum(np.exp(log_mass - log_mass.max()))
    return lo + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def split(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows, drawn without return from groups of these sizes, come from each."""
    out, left = np.zeros_like(sizes), int(sizes.sum())
    for j, size in enumerate(sizes.tolist()):
        out[j] = hypergeometric(rng, size, left - size, n)
        n -= int(out[j])
        left -= size
    return out


def matrix_row(seed: int, before: np.ndarray, shard_sizes: np.ndarray, part: int) -> np.ndarray:
    """A partition's row of the matrix. ``before``: rows in front of each partition, and all rows at the end."""
    lo, hi, sizes = 0, len(before) - 1, shard_sizes
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.default_rng([seed, lo, hi]), sizes, int(before[mid] - before[lo]))
        lo, hi, sizes = (lo, mid, left) if part < mid else (mid, hi, sizes - left)
    return sizes


def shard_sizes(n_rows: int, n_shards: int) -> np.ndarray:
    return np.array([n_rows // n_shards + (j < n_rows % n_shards) for j in range(n_shards)], np.int64)


def _key(seed: int, part: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit key of each row, from its partition and place alone."""
    x = (part.astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Deal:
    """Shard, block and key of rows by partition and place."""

    def __init__(self, seed: int, parts: np.ndarray, before: np.ndarray, sizes: np.ndarray, block_rows: int):
        self.seed, self.parts, self.before, self.sizes = seed, parts, before, sizes
        self.blocks = np.maximum(1, -(-sizes // block_rows))
        self.labels = lru_cache(maxsize=4)(self._labels)

    def __reduce__(self):
        return _deal, (self.seed, self.parts, self.before, self.sizes, self.blocks)

    def _labels(self, part: int) -> np.ndarray:
        """Shard numbers of a partition's rows, in random order."""
        at = int(np.searchsorted(self.parts, part))
        counts = matrix_row(self.seed, self.before, self.sizes, at)
        return np.random.default_rng([self.seed, at]).permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))

    def __call__(self, part: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        shard = np.empty(len(part), np.int32)
        for p in np.unique(part).tolist():
            shard[part == p] = self.labels(p)[place[part == p]]
        key = _key(self.seed, part, place)
        block = ((key >> np.uint64(32)) * self.blocks[shard].astype(np.uint64) >> np.uint64(32)).astype(np.int32)
        return [shard, block, key.view(np.int64)]


def _deal(seed, parts, before, sizes, blocks):
    out = Deal(seed, parts, before, sizes, 1)
    out.blocks = blocks
    return out


DEALT = "shard int, block int, key long"


def shuffle_into_shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(any columns) -> (shard int, slot long, document struct of the columns)``: shard sizes differ by one at most, slots
    of a shard are gapless from 0, and every order of the documents is equally likely."""
    numbered = docs.select(F.struct("*").alias("document"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    numbered = materialize(numbered, "numbered")
    counts = sorted(tuple(r) for r in numbered.groupBy("part").count().collect())
    parts, rows = np.array([p for p, _ in counts], np.int64), np.array([n for _, n in counts], np.int64)
    before = np.concatenate(([0], np.cumsum(rows)))
    deal = docs.sparkSession.sparkContext.broadcast(Deal(seed, parts, before, shard_sizes(int(before[-1]), n_shards), block_rows))

    def dealt(batches):
        for b in batches:
            got = deal.value(b.column("part").to_numpy(), b.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, got)], names=[*b.schema.names, "shard", "block", "key"])

    sizes = materialize(numbered.select("part", "place").mapInArrow(dealt, f"part int, place long, {DEALT}").groupBy("shard", "block").count(), "block-sizes")
    first = sizes.select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("first"))
    out = numbered.mapInArrow(dealt, f"document {numbered.schema['document'].dataType.simpleString()}, part int, place long, {DEALT}").join(first, ["shard", "block"])
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "part", "place"))
    return out.select("shard", (F.col("first") + within - 1).alias("slot"), "document")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Shards as folders ``shard=<number>`` of Parquet files, each file in the order of its slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
