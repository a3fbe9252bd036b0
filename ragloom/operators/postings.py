"""A saved lexical index in term-clustered posting blocks, searched with block-max pruning.

A *block* holds the postings of one term in one *cell* of chunks, so that a frequent term has many blocks of bounded size.
Its head says how many postings it has and, for each term frequency in it, the least length: that gives the block's largest
weight exactly, whatever the mean length is. Blocks lie in folders by a hash of the term, sorted by term, so that a
search reads the folders of its terms, first the heads alone (the postings' column isn't touched), then the blocks of those
cells that can hold one of the ``k`` best:

1. a question's bound on a cell is the sum of its terms' largest weights there;
2. the cells with the highest bounds are scored whole, and the ``k``-th score is a threshold;
3. of the other cells only those whose bound reaches the threshold are scored.

The result is the one of a full scan, which is what an index of up to ``FULL_SCAN_CELLS`` gets. Rows without term hold each chunk's
length, cut into cells as the others.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StringType

from ragloom.durable import materialize

from .retrieval import EPSILON, K1, B, top_k

#: Chunks of a cell, folders of an index, chunks of which one task holds a folder's blocks, cells that set the threshold.
CELL_CHUNKS, BUCKETS, SLICE_CHUNKS, FIRST_CELLS = 2048, 64, 1 << 15, 4
#: Chunks of a task that writes blocks, in small tables.
PART_CHUNKS = 512
#: Cells up to which bounds don't pay: long questions of frequent terms reach the threshold in all cells, and are read three times.
FULL_SCAN_CELLS = 1 << 14
#: Questions that a task scores together, and terms that it takes at a time.
QUERY_BLOCK, TERM_ROWS = 2048, 1024
#: Columns of the block table.
BLOCK = "bucket int, term string, cell long, n int, tops array<struct<tf: int, len: int>>, ids array<{kind}>, tfs array<int>, lens array<int>"
#: Bytes of texts whose tokens are counted at a time; which bytes belong to a token.
COUNTED_BYTES = 1 << 24
_IN_RUN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
#: Up to so many distinct question terms are pushed into the scan.
PUSHED_TERMS = 2000
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _bucket(term: Column, buckets: int) -> Column:
    """A term's folder, as ``_folders`` has it; lengths (no term) have one of their own."""
    return F.coalesce(F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)), F.lit(buckets)).cast("int")


def _folders(terms: pa.Array, buckets: int) -> np.ndarray:
    return np.array([buckets if t is None else crc32(t) % buckets for t in terms.cast(pa.binary()).to_pylist()], np.int64)


def ascii_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of ``[a-z0-9]`` of all texts in a row, and how many each text has."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    part = _IN_RUN[data]
    begins = part.copy()
    begins[1:] &= ~part[:-1]
    first = at[:-1][np.diff(at) > 0]  # a text goes on with no run of the one before
    begins[first] = part[first]
    stops = part.copy()
    stops[:-1] &= ~part[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    edges = np.concatenate(([0], np.cumsum(np.flatnonzero(stops) + 1 - starts))).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data[part])), np.diff(np.searchsorted(starts, at))


def _posting_schema(kind: DataType) -> pa.Schema:
    return pa.schema([("chunk_id", to_arrow_type(kind)), ("term", pa.string()), ("cell", pa.int64()), ("tf", pa.int32()), ("len", pa.int32())])


def _packed(buckets: int, n_parts: int, schema: pa.Schema):
    """``(chunk_id, tokens or text, cell, slice)`` -> ``(part, folder, piece)``: many chunks' postings for a folder's slice, as an Arrow message.

    A term has a row for each chunk with its count, and each chunk one without term for its length.
    """

    def run(batches):
        for b in batches:
            column, lo = b.column(1), 0
            sizes = column.value_lengths().fill_null(0).to_numpy() * 8 if pa.types.is_list(column.type) else pc.binary_length(column).fill_null(0).to_numpy()
            ends = np.cumsum(sizes, dtype=np.int64)
            while lo < b.num_rows:  # so many chunks at a time that their tokens stay bounded
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + COUNTED_BYTES, side="right")))
                yield pieces(b.slice(lo, hi - lo))
                lo = hi

    def pieces(b):
        column, n = b.column(1), b.num_rows
        words, lengths = (column.flatten(), column.value_lengths().fill_null(0).to_numpy()) if pa.types.is_list(column.type) else ascii_runs(column)
        coded = words.dictionary_encode()
        # terms are numbered by folder, the last number is no term; sorted keys (slice, term, row) are counted and in order at once
        folders = np.append(_folders(coded.dictionary, buckets), buckets)
        by_folder = np.argsort(folders, kind="stable")
        number = np.empty(len(folders), np.int64)
        number[by_folder] = np.arange(len(folders))
        row_bits, term_bits, last = n.bit_length(), len(folders).bit_length(), len(folders) - 1
        of_row = (b.column(3).to_numpy() << (row_bits + term_bits)) | np.arange(n)
        key = np.sort(np.concatenate((np.repeat(of_row, lengths) | (number[coded.indices.to_numpy()] << row_bits), of_row | (last << row_bits))))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tf, key = np.diff(np.append(first, len(key))), key[first]
        row, term, group = key & ((1 << row_bits) - 1), (key >> row_bits) & ((1 << term_bits) - 1), key >> (row_bits + term_bits)
        group = group * (buckets + 1) + folders[by_folder][term]
        tf[term == last] = 0
        at = pa.array(row)
        terms = coded.dictionary.take(pa.array(by_folder)[: last]).take(pa.array(term, mask=term == last))
        out = pa.RecordBatch.from_arrays([b.column(0).take(at), terms, b.column(2).take(at), pa.array(tf.astype(np.int32)), pa.array(lengths[row].astype(np.int32))], schema=schema)
        edges = np.concatenate(([0], 1 + np.flatnonzero(group[1:] != group[:-1]), [len(group)]))
        cut = [out.slice(x, y - x).serialize().to_pybytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
        group = group[edges[:-1]].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(group % n_parts), pa.array(group), pa.array(cut, pa.binary())], names=["part", "folder", "piece"])

    return run


def _ranks(values: pa.Array) -> np.ndarray:
    """Numbers in the order of the values; nulls first."""
    coded = values.dictionary_encode()
    of = np.empty(len(coded.dictionary) + 1, np.int64)
    of[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    of[-1] = -1
    return of[coded.indices.fill_null(-1).to_numpy()]


def _blocks(buckets: int, schema: pa.Schema):
    """``(folder, piece)``, all pieces of some folders' slices -> one row for each term and cell."""

    def run(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            for folder, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(folder, []).append(pa.ipc.read_record_batch(pa.py_buffer(x), schema))
        for folder in sorted(held):
            yield _block_rows(pa.Table.from_batches(held.pop(folder)).combine_chunks(), folder % (buckets + 1))

    return run


def _least(group: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least length of each group's frequencies, in order."""
    bits = [int(x.max()).bit_length() for x in (group, tf, length)]
    if sum(bits) < 64:
        key = np.sort((group << (bits[1] + bits[2])) | (tf << bits[2]) | length)
        group, tf, length = key >> (bits[1] + bits[2]), (key >> bits[2]) & ((1 << bits[1]) - 1), key & ((1 << bits[2]) - 1)
    else:
        order = np.lexsort((length, tf, group))
        group, tf, length = group[order], tf[order], length[order]
    first = np.concatenate(([True], (group[1:] != group[:-1]) | (tf[1:] != tf[:-1])))
    return group[first], tf[first], length[first]


def _block_rows(t: pa.Table, bucket: int) -> pa.RecordBatch:
    """A folder's postings -> one row for each term and cell."""
    term, cell, ids, tfs, lens = (t[c].chunk(0) for c in ("term", "cell", "chunk_id", "tf", "len"))
    rank, at = _ranks(term), cell.to_numpy()
    order = np.lexsort((ids.to_numpy() if pa.types.is_integer(ids.type) else _ranks(ids), at, rank))
    rank, at = rank[order], at[order]
    starts = np.flatnonzero(np.concatenate(([True], (rank[1:] != rank[:-1]) | (at[1:] != at[:-1]))))
    edges = np.append(starts, len(order))
    n, first, by = np.diff(edges), pa.array(order[starts]), pa.array(order)
    ids, tfs, lens = ids.take(by), tfs.take(by), lens.take(by)
    group, tf, length = _least(np.repeat(np.arange(len(starts)), n), tfs.to_numpy().astype(np.int64), lens.to_numpy().astype(np.int64))
    top = pa.StructArray.from_arrays([pa.array(tf.astype(np.int32)), pa.array(length.astype(np.int32))], ["tf", "len"])
    tops = pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(len(starts) + 1)).astype(np.int32)), top)
    edges = pa.array(edges.astype(np.int32))
    lists = [pa.ListArray.from_arrays(edges, x) for x in (ids, tfs, lens)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), bucket, np.int32)), term.take(first), cell.take(first), pa.array(n.astype(np.int32)), tops, *lists], names=["bucket", "term", "cell", "n", "tops", "ids", "tfs", "lens"])


def write_blocks(chunks: DataFrame, tokens: Column, path: str, stop_words: tuple[str, ...] = (), buckets: int = BUCKETS, cell_chunks: int = CELL_CHUNKS, slice_chunks: int = SLICE_CHUNKS) -> None:
    """``chunks (chunk_id, ...)`` as blocks, document frequencies and one row of statistics under ``path``.

    ``tokens`` is an array, or a lower-cased text whose runs of ``[a-z0-9]`` are the tokens: those are found where they are counted.
    Each chunk's tokens are counted where they are; one shuffle brings a term's postings of a slice together, packed by many
    into a row. A task sorts one folder's postings of about ``slice_chunks`` chunks, so its memory doesn't grow with the
    table. Cells follow the ids where these are whole numbers without large gaps, since neighbours are alike, and a hash of the id otherwise.
    """
    if isinstance(chunks.select(tokens).schema[0].dataType, StringType):
        words = F.regexp_extract_all(tokens, F.lit("[a-z0-9]+"), F.lit(0)) if stop_words else tokens
    else:
        words = F.coalesce(tokens, F.array().cast("array<string>"))
    words = F.filter(words, lambda t: ~t.isin(*stop_words)) if stop_words else words
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    whole = kind in _INTEGRAL
    shape = chunks.agg(F.count("*").alias("n"), *([F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi")] if whole else [])).first()
    n = max(shape.n, 1)
    dense = whole and shape.lo is not None and shape.hi - shape.lo < 4 * n

    cell = F.floor(F.col("chunk_id") / cell_chunks) if dense else F.pmod(F.xxhash64("chunk_id"), F.lit(-(-n // cell_chunks)))
    slices = -(-n // slice_chunks)
    n_parts = min((buckets + 1) * slices, max(8, n // min(cell_chunks, PART_CHUNKS)))  # a small table's folders share tasks
    schema = _posting_schema(chunks.schema["chunk_id"].dataType)
    rows = chunks.select("chunk_id", words.alias("ts"), cell.cast("long").alias("cell")).withColumn("slice", F.pmod(F.xxhash64("cell"), F.lit(slices)).cast("long"))
    packed = rows.mapInArrow(_packed(buckets, n_parts, schema), "part int, folder int, piece binary")
    blocks = packed.repartitionById(n_parts, "part").select("folder", "piece").mapInArrow(_blocks(buckets, schema), BLOCK.format(kind=kind))
    blocks.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    spark = chunks.sparkSession
    saved = spark.read.schema(BLOCK.format(kind=kind)).parquet(f"{path}/blocks")
    saved.where("term is not null").groupBy("term").agg(F.sum("n").alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    lengths = saved.where(F.col("bucket") == buckets).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)) / F.sum("n")).alias("avg_len"))
    lengths.withColumns({"buckets": F.lit(buckets), "cells": F.lit(-(-n // cell_chunks)), "kind": F.lit(kind)}).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def read_blocks(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The blocks in the folders of these terms; other folders aren't listed. Few terms are pushed into the scan too."""
    one = spark.read.parquet(f"{path}/stats").first()
    buckets, read = one.buckets, spark.read.schema(BLOCK.format(kind=one.kind))
    wanted = sorted(r.b for r in terms.select(_bucket(F.col("term"), buckets).alias("b")).distinct().collect())  # at most ``buckets`` numbers
    base = f"{path}/blocks"
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(folder)}
    paths = [f"{base}/bucket={b}" for b in wanted if f"bucket={b}" in there]
    blocks = read.option("basePath", base).parquet(*paths) if paths else read.parquet(base).where("false")
    few = [r.term for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    return blocks.where(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else blocks


def _saturation(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def weighted_terms(spark: SparkSession, path: str, queries: DataFrame, tokens: Column, okapi: bool = False) -> DataFrame:
    """``(qid, term, weight)``: a question's terms that the index holds, times their idf (R2, or R3 with ``okapi``)."""
    df, stats = spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/stats")
    q = queries.select("qid", F.explode(tokens).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))
    d = df.withColumn("_n", stats.select("n").scalar())
    if okapi:
        d = d.withColumn("idf", F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        d = d.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * d.agg(F.avg("idf").alias("m")).scalar()).otherwise(F.col("idf")))
    else:
        d = d.withColumn("idf", F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return q.join(d.select("term", "idf"), "term").select("qid", "term", (F.col("qn") * F.col("idf")).alias("weight"))


def bounds(blocks: DataFrame, wanted: DataFrame, mean: Column) -> DataFrame:
    """``(q, cell, bound, no)``: what a cell's chunks can score at most, cells numbered from the highest bound; heads only."""
    top = F.array_max(F.transform("tops", lambda t: _saturation(t["tf"], t["len"], F.col("_mean"))))
    heads = blocks.select("term", "cell", "tops").withColumn("_mean", mean).select("term", "cell", top.alias("top"))
    x = heads.join(wanted, "term").groupBy("q", "cell").agg(F.sum(F.greatest("weight", F.lit(0.0)) * F.col("top")).alias("bound"))
    return top_k(x, 2**31 - 1, ["q"], F.desc("bound"), F.col("cell")).withColumnRenamed("rank", "no")


def _best_of_cells(blocks: DataFrame, wanted: DataFrame, cells: DataFrame | None, mean: float, k: int, n_queries: int) -> DataFrame:
    """``(q, chunk_id, score)``: the ``k`` best of each of a question's cells (``None``: of all), which are scored whole.

    Each block meets the questions that ask for its term in its cell, at most ``QUERY_BLOCK`` of them in a row. A task takes
    the rows of a cell together and adds up a small table of questions by chunks.
    """
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    of_block = F.pmod(F.xxhash64("q"), F.lit(-(-n_queries // QUERY_BLOCK))).alias("qb")
    by = ["term"] if cells is None else ["term", "cell"]
    asked = wanted if cells is None else cells.select("q", "cell").join(wanted, "q")
    asked = asked.groupBy(*by, of_block).agg(F.collect_list(F.struct("q", "weight")).alias("asks"))
    rows = blocks.select("term", "cell", "ids", "tfs", "lens").join(asked, by).select("qb", "cell", "ids", "tfs", "lens", "asks")

    def best(batches):
        at, held = None, []
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            lo = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[lo]:
                    if at is not None and keys[lo] != at:
                        yield _best_rows(held, mean, k)
                        held = []
                    at = keys[lo]
                    held.append(b.slice(lo, i - lo))
                    lo = i
        if held:
            yield _best_rows(held, mean, k)

    return rows.repartition("qb", "cell").sortWithinPartitions("qb", "cell").mapInArrow(best, f"q long, chunk_id {kind}, score double")


def _best_rows(rows: list[pa.RecordBatch], mean: float, k: int) -> pa.RecordBatch:
    """Scores of one cell for the questions of one block."""
    t = pa.Table.from_batches(rows)
    postings, asks = t["ids"].combine_chunks(), t["asks"].combine_chunks()
    p, a = postings.flatten(), asks.flatten()
    ids = pc.unique(p).sort()
    qs, q_at = np.unique(a.field("q").to_numpy(), return_inverse=True)
    c_at = pc.index_in(p, value_set=ids).to_numpy()
    tf, length, weight = t["tfs"].combine_chunks().flatten().to_numpy().astype(float), t["lens"].combine_chunks().flatten().to_numpy(), a.field("weight").to_numpy()
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    p_row, a_row = (np.repeat(np.arange(len(x)), x.value_lengths().to_numpy()) for x in (postings, asks))
    scores = np.zeros((len(qs), len(ids)))
    for lo in range(0, len(postings), TERM_ROWS):  # so many terms at a time: weights times gains
        p_in, a_in = ((x >= lo) & (x < lo + TERM_ROWS) for x in (p_row, a_row))
        gains, weights = np.zeros((TERM_ROWS, len(ids))), np.zeros((len(qs), TERM_ROWS))
        gains[p_row[p_in] - lo, c_at[p_in]] = gain[p_in]
        weights[q_at[a_in], a_row[a_in] - lo] = weight[a_in]
        scores += weights @ gains
    scores = np.round(scores, 6)
    if scores.shape[1] > k:  # below the k-th nothing counts; equal scores are decided by the ids, which are in order
        scores[scores < np.partition(scores, -k, axis=1)[:, -k, None]] = 0
    row, col = np.nonzero(scores > 0)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, col = row[keep], col[keep]
    return pa.RecordBatch.from_arrays([pa.array(qs[row]), ids.take(pa.array(col)), pa.array(scores[row, col])], names=["q", "chunk_id", "score"])


def search_blocks(spark: SparkSession, path: str, queries: DataFrame, tokens: Column, k: int = 10, okapi: bool = False, first_cells: int = FIRST_CELLS, full_scan_cells: int = FULL_SCAN_CELLS) -> DataFrame:
    """R2, R3 over a saved index: ``queries (qid, ...) -> hits (qid, chunk_id, score, rank)``, as a full scan would give.

    Hits have a score above zero. With ``okapi`` weights may be negative; they lower scores but not bounds.
    """
    one = spark.read.parquet(f"{path}/stats").first()
    numbers = materialize(queries.select("qid").distinct().withColumn("q", F.monotonically_increasing_id()), "question-numbers")
    wanted = materialize(weighted_terms(spark, path, queries, tokens, okapi).join(numbers, "qid").select("q", "term", "weight"), "question-terms")
    n_queries = max(1, numbers.count())
    blocks = read_blocks(spark, path, wanted)
    mean = one.avg_len or 1.0
    if one.cells <= full_scan_cells:  # read once rather than bounded first
        found = _best_of_cells(blocks, wanted, None, mean, k, n_queries)
    else:
        cells = materialize(bounds(blocks, wanted, F.lit(mean)), "cell-bounds")
        found = materialize(_best_of_cells(blocks, wanted, cells.where(F.col("no") <= first_cells), mean, k, n_queries), "first-cells")
        floor = top_k(found, k, ["q"], F.desc("score"), F.col("chunk_id")).where(F.col("rank") == k).select("q", F.col("score").alias("_floor"))
        rest = cells.where(F.col("no") > first_cells).join(floor, "q", "left").where(F.col("bound") + 1e-6 >= F.coalesce("_floor", F.lit(0.0)))
        found = found.unionByName(_best_of_cells(blocks, wanted, rest, mean, k, n_queries))
    return top_k(found, k, ["q"], F.desc("score"), F.col("chunk_id")).join(numbers, "q").select("qid", "chunk_id", "score", "rank")


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether an index was written whole: its statistics come last."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table_state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files, as text: an index of another state of the table isn't fresh."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(p, True)
    seen = []
    while files.hasNext():
        s = files.next()
        seen.append(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}")
    return ",".join(sorted(seen))
