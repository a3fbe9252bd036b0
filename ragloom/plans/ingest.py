"""Ingest: routing of files to chunkers, and the whole job from files to derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.durable import materialize
from ragloom.functions import chunking
from ragloom.functions.text import ascii_tokens, clean_text
from ragloom.operators import graph, retrieval

#: Extensions each type of knowledge base takes.
SUPPORTED = {"sop": ("txt", "md", "docx"), "general": ("txt", "md")}


def dispatch(files: DataFrame) -> DataFrame:
    """``files (kb_id, kb_type, doc_id, contents)`` to chunks by knowledge-base type and extension of ``doc_id``.

    Unsupported files are left out. Markdown goes to heading sections; other texts by their content: STEP segments (for
    ``sop``), sections, sliding windows over lines, or one intro. Each branch reads its own files only.
    """
    ext = F.lower(F.regexp_extract("doc_id", r"\.([^.]+)$", 1))
    fits = F.lit(False)
    for kind, known in SUPPORTED.items():
        fits = fits | ((F.col("kb_type") == kind) & ext.isin(*known))
    f = files.where(fits).select("kb_id", "kb_type", "doc_id", ext.alias("ext"), clean_text(F.col("contents")).alias("contents"))
    route, long = chunking.route_document(F.col("contents")), F.length("contents") >= chunking.WINDOW_CHARS
    f = f.withColumn("by_text", F.when(F.col("ext") != "md", route))
    f = f.withColumn("route", F.when(F.col("ext") == "md", "sections").when((F.col("by_text") == "steps") & (F.col("kb_type") != "sop"), F.when(long, "windows").otherwise("intro")).otherwise(F.col("by_text")))
    # written once: four branches read it, and cleaning and routing cost more than the rest
    f = materialize(f.select(F.struct("kb_id", "doc_id").alias("doc_id"), "route", "contents"), "routed").where("contents <> ''")
    of = lambda r: f.where(F.col("route") == r)
    ident = lambda kind, no: F.concat("doc_id.doc_id", F.lit(kind), F.col(no).cast("string"))
    steps = chunking.step_segments(chunking.lines_of(of("steps")))
    steps = steps.select("doc_id", F.when(F.col("step").isNull(), F.concat("doc_id.doc_id", F.lit("_intro"))).otherwise(ident("_step_", "step")).alias("chunk_id"), "chunk")
    sections = chunking.heading_sections(chunking.lines_of(of("sections"))).select("doc_id", ident("_section_", "section").alias("chunk_id"), "chunk")
    parts = F.transform(F.split("contents", "\n"), lambda p: F.struct(p.alias("text"), F.array().cast("array<string>").alias("imgs")))
    windows = chunking.sliding_windows(of("windows").select("doc_id", parts.alias("parts"))).select("doc_id", ident("_window_", "no").alias("chunk_id"), "chunk")
    intro = of("intro").select("doc_id", F.concat("doc_id.doc_id", F.lit("_intro")).alias("chunk_id"), F.col("contents").alias("chunk"))
    chunks = steps.unionByName(sections).unionByName(windows).unionByName(intro)
    return chunks.select("doc_id.kb_id", "doc_id.doc_id", "chunk_id", "chunk")


def full_ingest(files: DataFrame, embed, contextualise=None, extract=None, entity_types: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Register, parse, context, embed, index, graph, counts: the derived tables by name, and ``job`` with the stages done.

    Context and graph stages run where a model is given; a failing model leaves its rows' errors, not the job's.
    """
    stages = ["register", "parse"]
    documents = files.select("kb_id", "doc_id", F.lit("completed").alias("state"))
    chunks = dispatch(files).withColumn("context", F.lit(None).cast("string"))
    if contextualise is not None:
        chunks = chunking.enrich_context(chunks, contextualise).drop("error", "status")
        stages.append("context")
    chunks = materialize(chunks, "chunks")  # counts, vectors, postings and graph read it
    text = F.concat_ws("\n", F.nullif("context", F.lit("")), "chunk")
    vectors = retrieval.embed_texts(chunks.select("chunk_id", text.alias("text")), embed)
    postings, df, stats = retrieval.bm25_index(chunks.select("chunk_id", text.alias("contents")), ascii_tokens(F.col("contents")))
    stages += ["embed", "index"]
    out = {"documents": documents, "chunks": chunks, "vectors": vectors, "postings": postings, "terms": df, "stats": stats}
    if extract is not None:
        out["entities"], out["relations"], out["graph_counts"] = graph.extraction_run(chunks.select("chunk_id", "doc_id", F.col("chunk").alias("contents")), extract, entity_types, "kb")
        stages.append("graph")
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    out["counts"] = documents.join(counts, "doc_id", "left").select("kb_id", "doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    out["job"] = out["counts"].groupBy("kb_id").agg(F.count("*").alias("n_docs"), F.sum("n_chunks").alias("n_chunks")).withColumn("stages", F.array(*map(F.lit, [*stages, "counts"])))
    return out


