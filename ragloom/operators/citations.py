"""Passage numbering, quotas, source lists and answers put together from sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTA_TOTAL, QUOTA_LATER = 20, 10


def numbered(passages: DataFrame) -> DataFrame:
    """``(qid, rank, passage)`` with ``[rank]`` in front."""
    return passages.withColumn("cited", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.trim("passage")))


def stable_numbers(passages: DataFrame) -> DataFrame:
    """``(qid, round, rank, passage)``: equal texts keep their number over rounds; numbers go by first appearance."""
    x = passages.withColumn("text", F.trim("passage"))
    first = x.groupBy("qid", "text").agg(F.min(F.struct("round", "rank")).alias("at"))
    ids = first.withColumn("cite_id", F.row_number().over(Window.partitionBy("qid").orderBy("at", "text"))).drop("at")
    return x.join(ids, ["qid", "text"]).select("qid", "round", "rank", "cite_id", F.concat(F.lit("["), F.col("cite_id").cast("string"), F.lit("] "), F.col("text")).alias("cited"))


def quota_dedupe(passages: DataFrame, total: int = QUOTA_TOTAL, total_col: str | None = None) -> DataFrame:
    """``(qid, sub_no, rank, passage)``: each sub-query gives ``max(1, total // n)`` passages, repeated texts once; places that are
    left go to the others in order. ``total_col`` names a column with each question's total (before or after an outline exists)."""
    t = F.col(total_col) if total_col else F.lit(total)
    n = passages.groupBy("qid").agg((F.max("sub_no") + 1).alias("n_subs"))
    x = passages.join(n, "qid").withColumn("quota", F.greatest(F.lit(1), F.floor(t / F.col("n_subs")))).withColumn("pass", F.when(F.col("rank") <= F.col("quota"), 0).otherwise(1))
    x = x.withColumn("total", t)
    first = x.groupBy("qid", "passage").agg(F.min(F.struct("pass", "sub_no", "rank")).alias("at"), F.first("total").alias("total"))
    out = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("at")))
    return out.where((F.col("at.pass") == 0) | (F.col("place") <= F.col("total"))).select("qid", "place", F.concat(F.lit("textid"), F.col("place").cast("string")).alias("cite_key"), "passage")


def source_list(passages: DataFrame) -> DataFrame:
    """``(qid, pos, passage)``: an ``[n]`` in front is the id, other texts get ids by first appearance; the title is the first line cut at 30."""
    own = F.regexp_extract("passage", r"^\[(\d+)\]", 1)
    x = passages.withColumn("own", own.try_cast("int")).withColumn("content", F.when(F.col("own").isNotNull(), F.regexp_replace("passage", r"^\[\d+\]\s*", "")).otherwise(F.col("passage")))
    free = x.where("own is null").groupBy("qid", F.trim("content").alias("key")).agg(F.min("pos").alias("first"))
    free = free.withColumn("given", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).drop("first")
    out = x.withColumn("key", F.when(F.col("own").isNull(), F.trim("content"))).join(free, ["qid", "key"], "left")
    return out.select("qid", "pos", F.coalesce("own", "given").alias("source_id"), F.concat(F.substring(F.substring_index(F.trim("content"), "\n", 1), 1, 30), F.lit("...")).alias("title"), "content")


def referenced_ids(answer: Column, source_ids: Column) -> Column:
    """Distinct ``[n]`` in order of appearance, else all source ids ascending."""
    used = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda n: n.cast("int")))
    return F.when(F.size(used) > 0, used).otherwise(F.array_sort(F.array_distinct(source_ids)))


def referenced_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``answers (qid, answer)``, ``sources (qid, source_id, pos, title)`` -> ordered references; of an id's sources the first counts."""
    first = sources.groupBy("qid", "source_id").agg(F.min_by("title", "pos").alias("title"))
    ids = first.groupBy("qid").agg(F.collect_list("source_id").alias("ids"))
    x = answers.join(ids, "qid", "left").select("qid", F.posexplode(referenced_ids(F.col("answer"), F.coalesce("ids", F.array().cast("array<int>")))).alias("place", "source_id"))
    return x.join(first, ["qid", "source_id"], "left")


def answer_blocks(sources: DataFrame, sections: DataFrame, fallback: int = 1200) -> DataFrame:
    """``sources (qid, source_id, excerpt, images array<string>)``, ``sections (qid, source_id, text)``: a text block for each source (its
    section, else its cut excerpt) and image blocks where the section isn't skipped."""
    x = sources.join(sections.withColumnRenamed("text", "section"), ["qid", "source_id"], "left")
    skipped = F.coalesce(F.trim("section") == "[跳过]", F.lit(False))
    text = x.where(~skipped).select("qid", "source_id", F.lit(0).alias("part"), F.lit("text").alias("kind"), F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.substring("excerpt", 1, fallback)).alias("body"))
    images = x.where(~skipped).select("qid", "source_id", F.posexplode("images").alias("k", "body")).select("qid", "source_id", (F.col("k") + 1).alias("part"), F.lit("image").alias("kind"), "body")
    return text.unionByName(images)


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """Blocks in order as one markdown text for each question."""
    shown = F.when(F.col("kind") == "image", F.concat(F.lit("![]("), F.col("body"), F.lit(")"))).otherwise(F.col("body"))
    x = blocks.select("qid", F.struct("source_id", "part", shown.alias("s")).alias("b"))
    return x.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["s"]), "\n\n").alias("markdown"))


def evidence_digest(results: DataFrame, n: int = 5, chars: int = 200) -> DataFrame:
    """``(qid, pos, text)``: the first results, on one line each."""
    x = results.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("k") <= n)
    return x.select("qid", "k", F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, chars).alias("digest"))


def guard_results(results: DataFrame, keep: int = 8, chars: int = 3000) -> DataFrame:
    """``(qid, pos, text)``: the first ``keep`` results, texts cut, and how many were left out."""
    by = Window.partitionBy("qid")
    x = results.withColumn("k", F.row_number().over(by.orderBy("pos"))).withColumn("omitted", F.greatest(F.count("*").over(by) - keep, F.lit(0)))
    return x.where(F.col("k") <= keep).select("qid", "k", F.substring("text", 1, chars).alias("text"), "omitted")


def unique_calls(calls: DataFrame) -> DataFrame:
    """``(qid, pos, tool, args map<string,string>)``: the first of calls with equal tool and arguments."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("args"))))
    x = calls.withColumn("key", key)
    return x.withColumn("k", F.row_number().over(Window.partitionBy("qid", "tool", "key").orderBy("pos"))).where("k = 1").drop("k")


def history(messages: DataFrame, n: int) -> DataFrame:
    """``(conv_id, turn, role, text)``: the last ``n`` turns, oldest first, as one array for each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    x = messages.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return x.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"], m["text"])).alias("messages"))
