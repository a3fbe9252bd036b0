"""Knowledge-base catalogue: lists, states, counts, jobs, and changes of derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("pending", "parsing", "context", "embedding", "indexing", "completed", "failed", "graph")
IN_PROGRESS = ("parsing", "context", "embedding", "indexing", "graph")
#: Older names of states.
LEGACY = {"done": "completed", "indexed": "completed", "uploaded": "pending"}
ERROR_CHARS, ZOMBIE_SECONDS = 500, 120


def list_kbs(kbs: DataFrame, documents: DataFrame, permitted: DataFrame | None = None, archived: bool | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """K1: knowledge bases with their number of documents, optionally of a role and by archived flag, newest first."""
    n = documents.groupBy("kb_id").agg(F.count("*").alias("n_docs"))
    x = kbs if permitted is None else kbs.join(permitted.select("kb_id").distinct(), "kb_id")
    if archived is not None:
        x = x.where(F.col("archived") == archived)
    x = x.join(n, "kb_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    if limit is not None:
        x = x.orderBy(F.desc("created_at"), "kb_id").offset(offset).limit(limit)
    return x


def role_permissions(permissions: DataFrame, kbs: DataFrame) -> DataFrame:
    """K2."""
    return permissions.join(kbs.select("kb_id", F.col("name").alias("kb_name")), "kb_id", "left")


def upsert_documents(table: DataFrame, rows: DataFrame) -> DataFrame:
    """K3: rows replace those of (kb_id, doc_id) but keep the first created_at."""
    t, r = table.alias("t"), rows.alias("r")
    x = t.join(r, (F.col("t.kb_id") == F.col("r.kb_id")) & (F.col("t.doc_id") == F.col("r.doc_id")), "full")
    new = F.col("r.doc_id").isNotNull()
    return x.select(
        *[(F.coalesce(F.col(f"t.{c}"), F.col(f"r.{c}")) if c in ("kb_id", "doc_id", "created_at") else F.when(new, F.col(f"r.{c}")).otherwise(F.col(f"t.{c}"))).alias(c) for c in table.columns]
    )


def canonical_state(state: Column) -> Column:
    """K4: older names mapped."""
    out = None
    for old, new in LEGACY.items():
        out = F.when(state == old, new) if out is None else out.when(state == old, new)
    return out.otherwise(state)


def state_summary(documents: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """K5: ``(kb_id, state) -> (kb_id, state, n)`` with zeros."""
    kbs = documents.select("kb_id").distinct().select("kb_id", F.explode(F.array(*map(F.lit, states))).alias("state"))
    n = documents.withColumn("state", canonical_state(F.col("state"))).groupBy("kb_id", "state").agg(F.count("*").alias("n"))
    return kbs.join(n, ["kb_id", "state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stale(documents: DataFrame, before: Column, states: tuple[str, ...] = IN_PROGRESS) -> DataFrame:
    """K6: rows in progress that weren't updated since ``before``."""
    return documents.where(F.col("state").isin(*states) & (F.col("updated_at") < before))


def mark_stale(documents: DataFrame, before: Column, states: tuple[str, ...] = IN_PROGRESS, message: str = "interrupted") -> DataFrame:
    """K6: those rows become failed."""
    old = F.col("state").isin(*states) & (F.col("updated_at") < before)
    return documents.withColumn("error", F.when(old, message).otherwise(F.col("error"))).withColumn("state", F.when(old, "failed").otherwise(F.col("state")))


def apply_transitions(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """K7: ``changes (kb_id, doc_id, state, error, n_chunks)``: errors are cut and cleared unless failed; counts change only when given."""
    c = changes.select("kb_id", "doc_id", F.col("state").alias("_s"), F.substring("error", 1, ERROR_CHARS).alias("_e"), F.col("n_chunks").alias("_n"))
    x = documents.join(c, ["kb_id", "doc_id"], "left")
    hit = F.col("_s").isNotNull()
    return x.select(
        "kb_id", "doc_id", F.when(hit, F.col("_s")).otherwise(F.col("state")).alias("state"),
        F.when(hit, F.when(F.col("_s") == "failed", F.col("_e"))).otherwise(F.col("error")).alias("error"),
        F.coalesce("_n", "n_chunks").alias("n_chunks"),
    )


def stem(doc_id: Column) -> Column:
    """A document id without its extension."""
    return F.regexp_replace(doc_id, r"\.[^.]+$", "")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """K8: ``documents (doc_id)``, ``chunks (doc)``: chunks by stem; documents without any count 0."""
    n = chunks.groupBy("doc").agg(F.count("*").alias("n_chunks"))
    return documents.withColumn("_stem", stem(F.col("doc_id"))).join(n, F.col("_stem") == F.col("doc"), "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def preview(chunks: DataFrame, limit: int, offset: int = 0, chars: int = 200, doc=None) -> DataFrame:
    """K9: a page of chunks with a cut text, image and character counts."""
    x = chunks if doc is None else chunks.where(F.col("doc_id") == doc)
    cut = F.when(F.length("contents") > chars, F.concat(F.substring("contents", 1, chars), F.lit("..."))).otherwise(F.col("contents"))
    x = x.select("chunk_id", "doc_id", cut.alias("preview"), F.length("contents").alias("char_count"), F.size("images").alias("n_images"))
    return x.orderBy("chunk_id").offset(offset).limit(limit)


def job_progress(jobs: DataFrame) -> DataFrame:
    """``(job_id, state, result_json)``: the last stage done and a summary."""
    r = F.from_json("result_json", "struct<stages: array<string>, n_chunks: int, error: string>")
    x = jobs.withColumn("r", r)
    return x.select("job_id", "state", F.try_element_at("r.stages", F.lit(-1)).alias("stage"), F.when(F.col("r.error").isNotNull(), F.concat(F.lit("failed: "), F.col("r.error"))).otherwise(F.concat(F.coalesce("r.n_chunks", F.lit(0)).cast("string"), F.lit(" chunks"))).alias("summary"))


def diagnostics(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, entities: DataFrame, jobs: DataFrame) -> DataFrame:
    """A row for each knowledge base with counts of every table and the last job; all tables have kb_id."""
    count = lambda t, n: t.groupBy("kb_id").agg(F.count("*").alias(n))
    x = count(documents, "n_docs")
    for t, n in ((chunks, "n_chunks"), (vectors, "n_vectors"), (entities, "n_entities")):
        x = x.join(count(t, n), "kb_id", "full")
    x = x.join(jobs.groupBy("kb_id").agg(F.max_by("state", F.struct("started_at", "job_id")).alias("last_job")), "kb_id", "left")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_docs", "n_chunks", "n_vectors", "n_entities")]
    return x.select("kb_id", *zero, "last_job").withColumn("aligned", F.col("n_chunks") == F.col("n_vectors"))


def sessions_by_recency(messages: DataFrame) -> DataFrame:
    """``(session_id, msg_id, text)``: number of messages, the last one, and the place by recency."""
    s = messages.groupBy("session_id").agg(F.count("*").alias("n"), F.max("msg_id").alias("last_id"), F.max_by("text", "msg_id").alias("last_text"))
    return s.orderBy(F.desc("last_id"))


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given sessions."""
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")


def replace_documents(table: DataFrame, changed: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of changed documents are replaced, those of others stay; documents in ``changed`` without rows are removed."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(rows)


def document_chunk_ids(table: DataFrame, doc) -> DataFrame:
    """K14."""
    return table.where(F.col("doc_id") == doc).select("chunk_id")


def partial_ingest(tables: dict[str, DataFrame], changed: DataFrame, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every derived table with only the changed documents' rows replaced. Rows with an ``error`` leave the table as it is."""
    good = changed.where(F.col("error").isNull()) if "error" in changed.columns else changed
    return {n: replace_documents(t, good, rows[n].join(good.select("doc_id").distinct(), "doc_id", "left_semi")) for n, t in tables.items()}


def delete_document(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the documents, and the counts of what went as rows (table, n)."""
    counts = None
    for n, t in tables.items():
        c = t.join(gone, "doc_id", "left_semi").agg(F.lit(n).alias("table"), F.count("*").alias("n"))
        counts = c if counts is None else counts.unionByName(c)
    return {n: t.join(gone, "doc_id", "left_anti") for n, t in tables.items()}, counts


def zombie_jobs(jobs: DataFrame, now: Column, seconds: int = ZOMBIE_SECONDS) -> DataFrame:
    """``(kb_id, job_id, state, started_at)``: jobs that run too long are recovered; whether the knowledge base still has a running one."""
    late = (F.col("state") == "running") & (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp")) > seconds)
    x = jobs.withColumn("recovered", late)
    return x.groupBy("kb_id").agg(F.count_if("recovered").alias("recovered"), F.max((F.col("state") == "running") & ~F.col("recovered")).alias("has_running"))


def relabel(documents: DataFrame, old: str = "uploaded", new: str = "pending") -> DataFrame:
    """One state renamed; ``changed`` marks the rows."""
    return documents.withColumn("changed", F.col("state") == old).withColumn("state", F.when(F.col("state") == old, new).otherwise(F.col("state")))


def latest_by_document(log: DataFrame) -> DataFrame:
    """The held state of each document: the one with the latest time, then the highest id."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return log.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
