"""Lexical and dense retrieval, fusion, re-ranking and expansion over tables of questions.

The query side may be small or large: it is broadcast only by Spark's own size check. Rankings have a total order (score
descending, then id), so results don't depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.durable import materialize
from ragloom.functions.text import compact

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, DENSE_WEIGHT, LEXICAL_WEIGHT = 60, 0.7, 0.3
# Which questions ask for a procedure, and what counts as a phrase or an id code in one.
PROCEDURE = r"(?i)步骤|流程|操作|更换|怎么|如何|怎样|SOP|procedure|steps?|how\s+to|sequence|battery|电池|换电|充电"
ASCII_PHRASE = r"[A-Za-z0-9][A-Za-z0-9\s_/\-:()]{2,}[A-Za-z0-9]"
ID_CODE = r"(?i)\bID\s*0*\d+\b"


#: Needles and their characters up to which every task holds them and looks for them where the texts are.
HELD_NEEDLES, HELD_CHARS = 250_000, 1 << 24
#: Characters of texts that are searched at a time; bits and factor of the places where a hash of a needle's beginning is marked.
SEARCHED_CHARS, MARK_BITS, _ODD = 1 << 20, 20, np.uint64(0x9E3779B97F4A7C15)


def top_k(scored: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """First ``k`` rows of each ``by`` group with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


# --- lexical ---------------------------------------------------------------------------------------------------------


def bm25_index(chunks: DataFrame, tokens: Column, stop_words: tuple[str, ...] = (), only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings ``(term, chunk_id, tf, len)``, document frequencies ``(term, df)`` and one row ``(n, avg_len)``.

    Chunks are tokenised once: postings are written, with one row without term for each chunk, and the rest is counted
    from them. An index that serves known questions once may be limited to their terms (``only (term)``): other tokens
    then go before the shuffle. Lengths and the number of chunks count everything all the same.
    """
    words = F.filter(tokens, lambda t: ~t.isin(*stop_words)) if stop_words else tokens
    t = chunks.select("chunk_id", F.coalesce(words, F.array().cast("array<string>")).alias("ts"))
    terms = t.select("chunk_id", F.size("ts").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "ts")).alias("term"))
    if only is not None:
        terms = terms.join(only.select("term").distinct().withColumn("_wanted", F.lit(True)), "term", "left").where("_wanted or term is null")
    # a chunk's postings are written together, so that a search adds up most of a chunk's score before it shuffles
    return _index_of(materialize(terms.repartition("chunk_id").groupBy("chunk_id", "term", "len").agg(F.count("*").alias("tf")), "postings"))


def _index_of(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    postings = rows.where("term is not null")
    stats = rows.where("term is null").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    return postings, postings.groupBy("term").agg(F.count("*").alias("df")), stats


def save_index(index: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """The index as three Parquet tables under ``path``; an index that is there is replaced."""
    for part, name in zip(index, ("postings", "terms", "stats")):
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A saved index; a missing part raises, as an index can't be guessed."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats"))


def _saturated(stats: DataFrame, postings: DataFrame) -> DataFrame:
    one = stats.scalar() if len(stats.columns) == 1 else stats.select(F.struct("n", "avg_len").alias("s")).scalar()
    p = postings.withColumn("_s", one)
    return p.withColumn("w", F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("_s.avg_len"))))


def bm25_search(index: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, tokens: Column, k: int = 10, okapi: bool = False) -> DataFrame:
    """R2 (``ln(1 + (N - df + .5) / (df + .5))``) and R3 (``okapi``: classic idf with a floor of ``EPSILON`` times the mean idf):
    ``queries (qid, ...) -> hits (qid, chunk_id, score, rank)``. Repeated query tokens count again."""
    postings, df, stats = index
    q = queries.select("qid", F.explode(tokens).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))
    d = df.withColumn("_n", stats.select("n").scalar())
    if okapi:
        raw = d.withColumn("idf", F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("idf").alias("m"))
        idf = raw.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * mean.scalar()).otherwise(F.col("idf")))
    else:
        idf = d.withColumn("idf", F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # query terms meet the small df table first, then only their postings are read
    wanted = q.join(idf.select("term", "idf"), "term").select("qid", "term", (F.col("qn") * F.col("idf")).alias("weight"))
    hit = _saturated(stats, postings.join(wanted, "term"))
    scored = hit.groupBy("qid", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("score"))
    if okapi:
        scored = scored.where("score > 0")
    return top_k(scored, k, ["qid"], F.desc("score"), "chunk_id")


def containing(texts: DataFrame, needles: DataFrame, held: int = HELD_NEEDLES) -> DataFrame:
    """Texts that hold a needle, ``(chunk_id, hay), (needle) -> (chunk_id, needle)``, without comparing every pair.

    Up to ``held`` needles (and ``HELD_CHARS``) are in every task, which looks for all of them at once while it reads the
    texts (see ``_held_needles``): only hits leave the scan. More of them meet the texts in an equi-join: a text is cut into
    blocks of ``g`` characters at multiples of ``g``. A needle of at least ``2 g - 1`` characters covers one of them wherever
    it stands, and that block starts at one of the needle's first ``g`` characters: so ``g`` pieces of each needle meet the
    blocks, and ``contains`` verifies. ``g`` is the largest of 1, 2, 4, 8 and 16 that the needle's length allows. Null and
    empty needles find nothing; repeated needles count once.
    """
    n = needles.select("needle").where("needle <> ''").distinct()
    size = n.agg(F.count("*").alias("n"), F.sum(F.length("needle")).alias("chars")).first()
    if not size.n:
        return texts.select("chunk_id", F.lit("").alias("needle")).where("false")
    if size.n <= held and size.chars <= HELD_CHARS:
        return _held_needles(texts, [r.needle for r in n.collect()])
    fits = F.length("needle") + 1
    n = n.withColumn("g", F.greatest(*[F.when(fits >= 2 * g, g) for g in (1, 2, 4, 8, 16)]))
    used = sorted(r.g for r in n.select("g").distinct().collect())  # five numbers at most
    pieces = n.select("needle", F.explode(F.transform(F.sequence(F.lit(1), "g"), lambda i: F.substring("needle", i, F.col("g")))).alias("block"))
    blocks = [F.regexp_extract_all("hay", F.lit("(?s).{%d}" % g), F.lit(0)) for g in used]
    cut = texts.where("hay is not null").select("chunk_id", F.explode(F.array_distinct(F.concat(*blocks))).alias("block"))
    near = cut.join(pieces, "block").select("chunk_id", "needle").distinct()
    return near.join(texts, "chunk_id").where(F.contains("hay", "needle")).select("chunk_id", "needle")


def _window_hashes(text: str, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` (a power of two) code points."""
    h, k = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), 1
    while k < width:
        h, k = h[: max(0, len(h) - k)] * _ODD + h[k:], 2 * k
    return h


def _held_needles(texts: DataFrame, needles: list[str]) -> DataFrame:
    """``containing`` for needles that every task holds.

    A needle is known by the hash of its first 1, 2, 4, 8 or 16 characters, the most it has. Windows of all texts of a batch are hashed at
    once; where a hash is marked, the needles that begin so are compared.
    """
    kind = texts.schema["chunk_id"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast(needles)

    def slots(h):
        return (h * _ODD) >> np.uint64(64 - MARK_BITS)

    def beginnings():
        out: dict[int, tuple[np.ndarray, dict[int, list[str]]]] = {}
        for w in shared.value:
            width = min(16, 1 << (len(w).bit_length() - 1))
            marked, of = out.setdefault(width, (np.zeros(1 << MARK_BITS, bool), {}))
            h = _window_hashes(w[:width], width)
            marked[slots(h)] = True
            of.setdefault(int(h[0]), []).append(w)
        return out

    def hits(lines: list[str], known) -> set[tuple[int, str]]:
        joined, ends, found = "".join(lines), np.cumsum([len(x) for x in lines]), set()
        for width, (marked, of) in known.items():
            h = _window_hashes(joined, width)
            at = np.flatnonzero(marked[slots(h)])
            row = np.searchsorted(ends, at, side="right")
            for i, r, end, x in zip(at.tolist(), row.tolist(), ends[row].tolist(), h[at].tolist()):
                found.update((r, w) for w in of.get(x, ()) if i + len(w) <= end and joined.startswith(w, i))
        return found

    def run(batches):
        known = beginnings()
        for b in batches:
            lo, lengths = 0, np.cumsum(pc.utf8_length(b.column(1)).to_numpy(), dtype=np.int64)
            while lo < b.num_rows:  # so many texts at a time that their characters stay bounded
                hi = max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + SEARCHED_CHARS, side="right")))
                found = list(hits(b.column(1).slice(lo, hi - lo).to_pylist(), known))
                ids = b.column(0).slice(lo).take(pa.array([r for r, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([w for _, w in found], pa.string())], names=["chunk_id", "needle"])
                lo = hi

    return texts.where("hay is not null").select("chunk_id", "hay").mapInArrow(run, f"chunk_id {kind}, needle string")


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` chunks in corpus order whose title or contents hold the keyword; an empty keyword finds nothing."""
    c = chunks.select("chunk_id", F.lower(F.concat_ws("\n", "title", "contents")).alias("hay"))
    q = queries.select("qid", F.lower("keyword").alias("needle"))
    first = top_k(containing(c, q), k, ["needle"], F.col("chunk_id"))  # before repeated keywords multiply them
    return first.join(q, "needle").select("qid", "chunk_id", "rank")


def phrases(question: Column) -> Column:
    """Compact ASCII phrases (four characters or more) and id codes of a question, distinct."""
    found = F.transform(F.regexp_extract_all(question, F.lit(ASCII_PHRASE), 0), compact)
    codes = F.transform(F.regexp_extract_all(question, F.lit(ID_CODE), 0), compact)
    return F.array_distinct(F.concat(F.filter(found, lambda p: F.length(p) >= 4), F.filter(codes, lambda p: p != "")))


def phrase_match(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Chunks whose compact text holds compact phrases of the question, ``100 + length`` each."""
    c = chunks.select("chunk_id", compact(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("contents", F.lit("")))).alias("hay"))
    q = queries.select("qid", F.explode(phrases(F.col("question"))).alias("needle"))
    hit = containing(c, q).join(q, "needle").groupBy("qid", "chunk_id").agg(F.sum(100 + F.length("needle")).cast("double").alias("score"))
    return top_k(hit, k, ["qid"], F.desc("score"), "chunk_id")


# --- dense -----------------------------------------------------------------------------------------------------------


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def _best_of(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
    """Best ``k`` of the vectors for each query, in the order of the final ranking."""
    s = np.round(np.round(q @ vectors.T, 9), 6)
    rows: list[list] = [[], [], []]
    for qid, line in zip(qids, s):
        near = np.flatnonzero(line >= np.partition(line, -k)[-k]) if len(line) > k else np.arange(len(line))
        near = near[np.lexsort((ids[near], -line[near]))[:k]]
        rows[0] += [int(qid)] * len(near)
        rows[1] += ids[near].tolist()
        rows[2] += line[near].tolist()
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], names=["qid", "chunk_id", "score"])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


NEAREST = "qid long, chunk_id long, score double"


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, metadata: Column | None = None, block: int = 4096, part: int = 65_536) -> DataFrame:
    """Exact inner-product top-k, ``vectors (chunk_id, embedding)``, ``queries (qid, embedding) -> hits``.

    ``metadata`` filters vectors before anything else (pushed into the scan). Up to ``block`` queries, a size that is
    checked, go to the vectors, which stay where they are: each batch multiplies once and keeps its ``k`` best for each
    query. More queries meet the vectors in a grid of query blocks and vector parts, one cell a task, both sides shuffled.
    """
    v = vectors.where(metadata) if metadata is not None else vectors
    v = v.where("embedding is not null").select(F.col("chunk_id").cast("long"), "embedding")
    q = queries.where("embedding is not null").select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("e"))
    few = q.limit(block + 1).collect()
    if not few:
        return top_k(v.sparkSession.createDataFrame([], NEAREST), k, ["qid"], F.desc("score"), "chunk_id")
    if len(few) <= block:
        qids, rows = np.array([r.qid for r in few]), np.array([r.e for r in few])

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield _best_of(b.column(0).to_numpy(), _matrix(b.column(1)), qids, rows, k)

        local = v.mapInArrow(run, NEAREST)
    else:
        n_blocks, n_parts = -(-q.count() // block), max(1, -(-v.count() // part))
        both = [F.sequence(F.lit(0), F.lit(n - 1)) for n in (n_blocks, n_parts)]
        left = v.select("chunk_id", "embedding", F.pmod(F.xxhash64("chunk_id"), F.lit(n_parts)).cast("int").alias("p"), F.explode(both[0]).alias("b"))
        right = q.select("qid", "e", F.explode(both[1]).alias("p"), F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).cast("int").alias("b"))

        def cell(_, a, b):
            if not (a.num_rows and b.num_rows):
                return pa.table({"qid": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            return pa.Table.from_batches([_best_of(a["chunk_id"].to_numpy(), _matrix(a["embedding"]), b["qid"].to_numpy(), _matrix(b["e"]), k)])

        local = left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInArrow(cell, NEAREST)
    return top_k(local, k, ["qid"], F.desc("score"), "chunk_id")


def search_collection(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, part: int = 65_536) -> DataFrame:
    """The best ``k`` vectors of each question's own collection, ``(kb_id, chunk_id, embedding), (qid, kb_id, embedding)``.

    Written with ``partitionBy("kb_id")`` the vectors of collections that nobody asks for aren't read (partition pruning).
    A collection is a grid of vector parts and question blocks, as large as its own counts ask for: a cell multiplies
    once and keeps ``k`` rows a question, so a collection that holds most vectors, or gets most questions, is many tasks.
    """
    v = vectors.where("embedding is not null").select("kb_id", F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
    q = queries.where("embedding is not null").select("kb_id", F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("e"))
    sizes = q.groupBy("kb_id").agg(F.ceil(F.count("*") / block).cast("int").alias("nb")).join(v.groupBy("kb_id").agg(F.ceil(F.count("*") / part).cast("int").alias("np")), "kb_id")
    sizes = materialize(sizes, "collection-sizes")
    each = [F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("nb", "np")]
    left = v.join(sizes, "kb_id").select("kb_id", "chunk_id", "embedding", F.pmod(F.xxhash64("chunk_id"), "np").cast("int").alias("p"), each[0].alias("b"))
    right = q.join(sizes, "kb_id").select("kb_id", "qid", "e", each[1].alias("p"), F.pmod(F.xxhash64("qid"), "nb").cast("int").alias("b"))
    kind = vectors.schema["kb_id"].dataType.simpleString()

    def cell(_, a: pa.Table, c: pa.Table) -> pa.Table:
        if not (a.num_rows and c.num_rows):
            return pa.table({"kb_id": a["kb_id"][:0], "qid": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = pa.Table.from_batches([_best_of(a["chunk_id"].to_numpy(), _matrix(a["embedding"]), c["qid"].to_numpy(), _matrix(c["e"]), k)])
        return found.add_column(0, "kb_id", a["kb_id"].take(pa.array(np.zeros(found.num_rows, np.int64))))

    keys = ["kb_id", "p", "b"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, f"kb_id {kind}, {NEAREST}")
    return top_k(local, k, ["qid"], F.desc("score"), F.col("chunk_id"))


def embed_texts(texts: DataFrame, embed, batch: int = 64, dim: int = 64, retries: int = 1) -> DataFrame:
    """``(chunk_id, text) -> (chunk_id, embedding)`` by ``embed(list of texts) -> list of vectors``: batches, then one by one with
    retries, and a zero vector where that fails or the length is wrong."""

    def run(batches):
        for pdf in batches:
            out: list = []
            for lo in range(0, len(pdf), batch):
                part = pdf["text"].iloc[lo : lo + batch].fillna("").tolist()
                try:
                    got = list(embed(part))
                    if len(got) != len(part) or any(len(v) != dim for v in got):
                        raise ValueError("wrong shape")
                except Exception:  # a failing batch is tried text by text
                    got = [_one(embed, t, dim, retries) for t in part]
                out += [[float(x) for x in v] for v in got]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "embedding": out})

    return texts.select("chunk_id", "text").mapInPandas(run, f"chunk_id {texts.schema['chunk_id'].dataType.simpleString()}, embedding array<float>")


def _one(embed, text: str, dim: int, retries: int) -> list[float]:
    for _ in range(retries + 1):
        try:
            (v,) = embed([text])
            if len(v) == dim:
                return list(v)
        except Exception:  # the zero vector below stands for a failed text
            continue
    return [0.0] * dim


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """A test embedder: tokens counted in ``dim`` hash buckets, unit length."""
    buckets = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    return normalise(counts)


def with_instruction(instruction: str, question: Column) -> Column:
    """R10."""
    return F.concat(F.lit(instruction), question)


def nested_search(queries: DataFrame, search, k: int) -> DataFrame:
    """``(qid, subs array<string>)``; ``search(df with qid, question) -> hits``; questions without sub-queries keep a row without hit."""
    flat = queries.select(F.col("qid").alias("q0"), F.posexplode("subs").alias("sub_no", "question")).withColumn("qid", F.struct("q0", "sub_no"))
    hits = search(flat.select("qid", "question")).where(F.col("rank") <= k).select("qid.q0", "qid.sub_no", "chunk_id", "score", "rank")
    return queries.select("qid").join(hits.withColumnRenamed("q0", "qid"), "qid", "left")


# --- fusion, re-ranking, expansion -----------------------------------------------------------------------------------


def rrf(lists: list[tuple[DataFrame, float]], k: int | None = None, c: int = RRF_K) -> DataFrame:
    """Weighted reciprocal ranks, ``w / (c + rank)`` with the first rank of an id in each list."""
    parts = [h.groupBy("qid", "chunk_id").agg(F.min("rank").alias("rank")).select("qid", "chunk_id", (w / (c + F.col("rank"))).alias("part")) for h, w in lists]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    scored = all_parts.groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top_k(scored, k or 2**31 - 1, ["qid"], F.desc("score"), "chunk_id")


def merge_preferred(first: DataFrame, then: DataFrame, k: int | None = None) -> DataFrame:
    """Ranked lists one after the other, first occurrence wins."""
    both = first.select("qid", "chunk_id", F.struct(F.lit(0).alias("s"), "rank").alias("at")).unionByName(then.select("qid", "chunk_id", F.struct(F.lit(1).alias("s"), "rank").alias("at")))
    return top_k(both.groupBy("qid", "chunk_id").agg(F.min("at").alias("at")), k or 2**31 - 1, ["qid"], F.col("at")).drop("at")


def append_lists(first: DataFrame, then: DataFrame) -> DataFrame:
    """Both lists whole, the first before the second, duplicates kept."""
    both = first.select("qid", "chunk_id", "rank", F.lit(0).alias("source")).unionByName(then.select("qid", "chunk_id", "rank", F.lit(1).alias("source")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("source", "rank", "chunk_id")))


def token_overlap(question: Column, text: Column) -> Column:
    """Default re-rank score: share of the question's distinct tokens that the text holds."""
    from ragloom.functions.text import ascii_tokens

    q = F.array_distinct(ascii_tokens(question))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, ascii_tokens(text))) / F.size(q), 6)).otherwise(0.0)


def rerank(pairs: DataFrame, k: int | None = None, score: Column | None = None, min_score: float | None = None) -> DataFrame:
    """``pairs (qid, question, chunk_id, text)``; blank texts go, then scores decide; ranks count from 1."""
    p = pairs.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    p = p.withColumn("score", token_overlap(F.col("question"), F.col("text")) if score is None else score)
    if min_score is not None:
        p = p.where(F.col("score") >= min_score)
    return top_k(p, k or 2**31 - 1, ["qid"], F.desc("score"), "chunk_id")


def rerank_with(pairs: DataFrame, score_fn, k: int | None = None) -> DataFrame:
    """R17 with a model: ``score_fn(questions, texts) -> scores``, run on batches."""

    def run(batches):
        for pdf in batches:
            yield pdf[["qid", "chunk_id"]].assign(score=[float(s) for s in score_fn(pdf["question"].tolist(), pdf["text"].tolist())])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    scored = pairs.where(F.trim(F.coalesce("text", F.lit(""))) != "").mapInPandas(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double")
    return top_k(scored, k or 2**31 - 1, ["qid"], F.desc("score"), "chunk_id")


def rerank_text(title: Column, text: Column, limit: int = 2000) -> Column:
    """R19."""
    return F.substring(F.concat_ws("\n", title, text), 1, limit)


def expand_documents(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Per question the documents to read whole: those with STEP hits, else, if it asks for a procedure, hit documents that own
    STEP chunks; narrowed to the one with most hits, then the earliest. ``chunks (chunk_id, doc, step)``."""
    h = hits.join(chunks.select("chunk_id", "doc", "step"), "chunk_id").groupBy("qid", "doc").agg(
        F.count("*").alias("n_hits"), F.min("rank").alias("first_rank"), F.max(F.col("step").isNotNull()).alias("step_hit")
    )
    stepped = chunks.where("step is not null").select("doc").distinct().withColumn("has_steps", F.lit(True))
    asks = queries.select("qid", F.col("question").rlike(PROCEDURE).alias("asks"))
    h = h.join(stepped, "doc", "left").join(asks, "qid").withColumn("any_step", F.max("step_hit").over(Window.partitionBy("qid")))
    wanted = h.where(F.when(F.col("any_step"), F.col("step_hit")).otherwise(F.col("asks") & F.coalesce("has_steps", F.lit(False))))
    return top_k(wanted, 1, ["qid"], F.desc("n_hits"), F.col("first_rank"), F.col("doc")).select("qid", "doc", "n_hits", "first_rank")


def expanded_order(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of the chosen documents, intro before steps, then step number and id."""
    x = docs.join(chunks.select("chunk_id", "doc", "step"), "doc")
    return top_k(x, 2**31 - 1, ["qid"], F.col("first_rank"), F.col("doc"), F.col("step").isNotNull(), F.col("step"), F.col("chunk_id")).select("qid", "chunk_id", "doc", "step", "rank")


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of hits; unknown ids go."""
    return hits.join(chunks, "chunk_id")


def evidence(hits: DataFrame, chunks: DataFrame, snippet: int = 400, excerpt: int = 15_000) -> DataFrame:
    """Snippet and cut excerpt; images of the text, else of the column."""
    from ragloom.functions.text import split_images

    x = hydrate(hits, chunks).withColumn("_s", split_images(F.col("contents")))
    cut = F.when(F.length("_s.text") > excerpt, F.concat(F.substring("_s.text", 1, excerpt), F.lit("…"))).otherwise(F.col("_s.text"))
    return x.select("qid", "rank", "chunk_id", F.substring("_s.text", 1, snippet).alias("snippet"), cut.alias("excerpt"), F.when(F.size("_s.images") > 0, F.col("_s.images")).otherwise(F.col("images")).alias("images"))


def stable_id(x: Column) -> Column:
    """The first 8 bytes of SHA-1 as an unsigned number."""
    return F.conv(F.substring(F.sha1(x), 1, 16), 16, 10).cast("decimal(20,0)")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those with the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids on both sides, on one only."""
    a, b = left.select(key, F.lit(1).alias("a")), right.select(key, F.lit(1).alias("b"))
    return a.join(b, key, "full").agg(
        F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only")
    )


def rewritten_query(question: Column, model_text: Column) -> Column:
    """The model's first line, else the question."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(model_text, "\n", 1)), F.lit("")), question)


def hybrid(dense: DataFrame, lexical: DataFrame, preferred: DataFrame, chunks: DataFrame, queries: DataFrame, final_k: int = 5, recall_k: int = 20) -> DataFrame:
    """Fusion, preferred ids first, re-rank, preferred first again, cut. ``chunks (chunk_id, title, contents)``."""
    fused = rrf([(dense, DENSE_WEIGHT), (lexical, LEXICAL_WEIGHT)], recall_k)
    first = merge_preferred(preferred, fused, recall_k)
    pairs = first.select("qid", "chunk_id").join(queries.select("qid", "question"), "qid").join(chunks.select("chunk_id", rerank_text(F.col("title"), F.col("contents")).alias("text")), "chunk_id")
    ranked = rerank(pairs).select("qid", "chunk_id", "rank", "score")
    # scores go with the rows through the merge, so that the chain stands in the plan once
    at = [F.struct(F.lit(s).alias("s"), "rank").alias("at") for s in (0, 1)]
    both = preferred.select("qid", "chunk_id", at[0], F.lit(None).cast("double").alias("score")).unionByName(ranked.select("qid", "chunk_id", at[1], "score"))
    merged = both.groupBy("qid", "chunk_id").agg(F.min("at").alias("at"), F.max("score").alias("score"))
    return top_k(merged, final_k, ["qid"], F.col("at")).select("qid", "chunk_id", "rank", "score")
