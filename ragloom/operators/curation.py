"""Evaluation sets: mining, sampling, validation, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import dedup_key

SOURCES = ("manual", "session", "generated")


def mine_questions(sessions: DataFrame, messages: DataFrame, kb: str | None = None, least: int = 4, most: int = 300, limit: int | None = None) -> DataFrame:
    """``sessions (conv_id, kb_id)``, ``messages (conv_id, msg_id, role, text)``: user questions of fitting length, first of equal ones,
    with padded sequential ids."""
    s = sessions if kb is None else sessions.where(F.col("kb_id") == kb)
    m = messages.where("role = 'user'").join(s, "conv_id").withColumn("query", F.trim("text")).where(F.length("query").between(least, most))
    m = m.withColumn("norm", dedup_key(F.col("query"))).where("norm <> ''")
    first = m.withColumn("k", F.row_number().over(Window.partitionBy("norm").orderBy("msg_id"))).where("k = 1")
    if limit is not None:
        first = first.orderBy("msg_id").limit(limit)
    from ragloom.functions.chunking import running_id

    out = running_id(first.select("msg_id", "conv_id", "query"), ["msg_id"], "n")
    return out.select(F.format_string("q%03d", F.col("n") + 1).alias("item_id"), "msg_id", "conv_id", "query", F.lit("session").alias("source"))


def round_robin_sample(chunks: DataFrame, n: int, seed: int = 42, order=None) -> DataFrame:
    """Every document gives one chunk before any gives a second; ``order`` is the draw, a hash by default."""
    draw = order if order is not None else F.xxhash64(F.lit(seed), "doc_id", "chunk_id")
    x = chunks.withColumn("draw", draw)
    x = x.withColumn("round", F.row_number().over(Window.partitionBy("doc_id").orderBy("draw", "chunk_id")))
    return x.orderBy("round", "draw", "chunk_id").limit(n).drop("draw")


def generate_candidates(chunks: DataFrame, generate, per_chunk: int = 2) -> DataFrame:
    """``generate(pdf with chunk_id, doc_id, contents) -> pdf with chunk_id, response`` and X15; at most ``per_chunk`` questions each."""
    from ragloom.functions.actions import generated_questions

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    said = chunks.select("chunk_id", "doc_id", "contents").mapInPandas(lambda it: (generate(p)[["chunk_id", "response"]] for p in it), f"chunk_id {kind}, response string")
    x = said.join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("chunk_id", "doc_id", F.posexplode(F.slice(generated_questions(F.col("response")), 1, per_chunk)).alias("no", "q"))
    return x.select("chunk_id", "no", F.col("q.query").alias("query"), F.col("q.gold_answer").alias("gold_answer"), F.array(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("tags"), F.lit("generated").alias("source"))


def validate_items(items: DataFrame) -> DataFrame:
    """``(item_id, kb_id, query, relevant_chunk_ids, gold_answer, tags, source)`` with an array of errors."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    gold = F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))) > 0
    rules = {
        "empty id": blank("item_id"), "empty kb_id": blank("kb_id"), "empty query": blank("query"),
        "no gold": ~gold & blank("gold_answer"), "bad source": ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)),
    }
    return items.withColumn("errors", F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()])))


def check_dataset(items: DataFrame, kb: str | None = None) -> DataFrame:
    """E5: violations ``(rule, detail)``: repeated ids, several or unexpected knowledge bases, no items."""
    twice = items.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate id").alias("rule"), F.col("item_id").cast("string").alias("detail"))
    whole = items.agg(F.count("*").alias("n"), F.count_distinct("kb_id").alias("kbs"), F.min("kb_id").alias("kb"))
    several = whole.where("kbs > 1").select(F.lit("several kb").alias("rule"), F.col("kbs").cast("string").alias("detail"))
    out = twice.unionByName(several).unionByName(whole.where("n = 0").select(F.lit("no items").alias("rule"), F.lit("0").alias("detail")))
    if kb is not None:
        out = out.unionByName(items.where(F.col("kb_id") != kb).select("kb_id").distinct().select(F.lit("unexpected kb").alias("rule"), F.col("kb_id").cast("string").alias("detail")))
    return out


def merge_items(sets: list[DataFrame]) -> DataFrame:
    """Sets in order of precedence; of equal questions the first set's stays."""
    parts = [s.select("item_id", "query", "source").withColumn("_s", F.lit(i)) for i, s in enumerate(sets)]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    x = x.withColumn("norm", dedup_key(F.col("query")))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("norm").orderBy("_s", "item_id"))).where("k = 1").select("item_id", "query", "source")
