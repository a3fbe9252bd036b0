"""Chunking of documents. Rows of ``docs (doc_id, title, contents)`` become rows of chunks, ``no`` counting from 0."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ragloom.durable import materialize

from .text import strip

HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
STEP_LINE = r"(?i)^\s*STEP\s+(\d+)\s*:"
WINDOW_CHARS, CARRY_CHARS, DOC_CHARS, CONTEXT_CHARS = 800, 100, 60_000, 300


def overlap_of(size: int, overlap: int) -> int:
    return size // 4 if overlap >= size else overlap


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of windows over ``n`` units; the last window is the first that reaches the end."""
    step = size - overlap_of(size, overlap)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def char_windows(docs: DataFrame, size: int = 256, overlap: int = 64) -> DataFrame:
    """C1 by characters."""
    step = size - overlap_of(size, overlap)
    text = F.coalesce("contents", F.lit(""))
    # blocks of one step, cut in a single pass; a window is a block with the beginnings of those that follow
    n_windows = F.size(window_starts(F.length(text), size, overlap))
    out = docs.select("doc_id", "title", F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0)).alias("blocks"), n_windows.alias("n"))
    if size <= 2 * step:
        after = F.concat(F.slice("blocks", 2, F.greatest(F.size("blocks"), F.lit(1))), F.array(F.lit("")))
        windows = F.zip_with("blocks", after, lambda x, y: F.concat(x, F.substring(F.coalesce(y, F.lit("")), 1, size - step)))
    else:
        windows = F.transform("blocks", lambda _, k: F.substring(F.array_join(F.slice("blocks", k + 1, -(-size // step)), ""), 1, size))
    return out.select("doc_id", "title", F.posexplode(F.slice(windows, F.lit(1), F.col("n"))).alias("no", "chunk"))


def token_windows(docs: DataFrame, size: int = 256, overlap: int = 64) -> DataFrame:
    """C1 by tokens: words between spaces."""
    words = F.filter(F.split(F.coalesce("contents", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    out = docs.select("doc_id", "title", words.alias("words")).select("*", F.posexplode(window_starts(F.size("words"), size, overlap)).alias("no", "at"))
    return out.select("doc_id", "title", "no", F.array_join(F.slice("words", F.col("at") + 1, size), " ").alias("chunk"))


def sentences(x: Column) -> Column:
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"(?<=[.!?。！？\n])"), lambda s: strip(s) != "")


def cuts(lengths: list[int], size: int, overlap: int = 0, least: int = 1) -> list[tuple[int, int]]:
    """Greedy packing as (first, last) places: parts join while the length fits or there are fewer than ``least``; the next
    chunk starts with the longest tail within ``overlap`` that isn't the whole chunk, and holds one new part at least.

    Ends are found by binary search in prefix sums, so the work grows with the number of chunks.
    """
    if not lengths:
        return []
    sums, out, a, new = [0, *accumulate(lengths)], [], 0, 0
    while True:
        i = max(bisect_right(sums, sums[a] + size) - 1, a + least, new + 1)
        if i >= len(lengths):
            return [*out, (a, len(lengths) - 1)]
        out.append((a, i - 1))
        a, new = min(max(bisect_left(sums, sums[i] - overlap), a + 1), i), i


def window_cuts(lengths: list[int], size: int, carry: int) -> list[tuple[int, int, bool]]:
    """Windows as (first, last, whether the first was handed on): a window ends before the paragraph that would overfill it."""
    if not lengths:
        return []
    sums, out, a, new, carried = [0, *accumulate(lengths)], [], 0, 0, False
    while True:
        i = bisect_right(sums, sums[a] + size) - 1
        i = max(i + (i < len(lengths) and sums[i] == sums[a]), new + 1)
        if i >= len(lengths):
            return [*out, (a, len(lengths) - 1, carried)]
        out.append((a, i - 1, carried))
        carried = lengths[i - 1] <= carry
        a, new = i - carried, i


#: Cuts of a row of parts: the first part (from 0), how many, and whether the first was handed on.
CUTS = "array<struct<first: int, n: int, carried: boolean>>"


def _cuts(lengths: Column, cut) -> Column:
    """``cut(list of lengths) -> (first, last, carried)`` row by row: only lengths go to Python, texts stay where they are."""

    @F.arrow_udf(CUTS)
    def found(column: pa.Array) -> pa.Array:
        rows = column.fill_null([]) if column.null_count else column
        flat, at, ends, out = rows.flatten().to_numpy(), 0, [0], []
        for n in rows.value_lengths().to_pylist():
            out += cut(flat[at : at + n].tolist())
            ends.append(len(out))
            at += n
        first, last, carried = (np.array(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3
        fields = [pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(carried.astype(bool))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["first", "n", "carried"]))

    return found(lengths)


def _packed(docs: DataFrame, parts: Column, size: int, overlap: int, least: int) -> DataFrame:
    """Chunks of an array of parts, packed greedily and numbered."""
    x = docs.select("doc_id", "title", parts.alias("parts"))
    x = x.withColumn("cuts", _cuts(F.transform("parts", lambda p: F.length(p)), lambda n: [(a, b, False) for a, b in cuts(n, size, overlap, least)]))
    # the outer form: a filter on the size of what the inner one explodes would find the cuts a second time
    x = x.select("doc_id", "title", "parts", F.posexplode_outer("cuts").alias("no", "cut")).where("cut is not null")
    return x.select("doc_id", "title", "no", strip(F.array_join(F.slice("parts", F.col("cut.first") + 1, F.col("cut.n")), "")).alias("chunk"))


def sentence_chunks(docs: DataFrame, size: int = 256, overlap: int = 0, min_sentences: int = 1) -> DataFrame:
    """Whole sentences up to ``size`` characters, never fewer than ``min_sentences``."""
    return _packed(docs, sentences(F.col("contents")), size, overlap, min_sentences)


def recursive_chunks(docs: DataFrame, size: int = 256, min_chars: int = 12) -> DataFrame:
    """Split at paragraphs, then sentences, words and characters where parts are longer than ``size``; small parts are joined again."""

    def split_long(parts: Column, split) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > size, split(p)).otherwise(F.array(p))))

    parts = split_long(F.array(F.coalesce("contents", F.lit(""))), lambda p: F.split(p, r"(?<=\n\n)"))
    parts = split_long(parts, lambda p: F.split(p, r"(?<=[.!?。！？\n])"))
    parts = split_long(parts, lambda p: F.split(p, r"(?<=\s)"))
    parts = split_long(parts, lambda p: F.regexp_extract_all(p, F.lit("(?s).{1,%d}" % size), F.lit(0)))
    out = _packed(docs, F.filter(parts, lambda p: p != ""), size, 0, 1)
    return out.where(F.length("chunk") >= F.when(F.col("no") == 0, 1).otherwise(min_chars))


def finish_chunks(chunks: DataFrame, wrap: bool = False) -> DataFrame:
    """C4: trim, drop empty ones, wrap with the title, and number all chunks without a global sort.

    Numbers follow (doc_id, no): documents' counts give offsets per document, summed over a range-sorted table.
    """
    text = strip(F.col("chunk"))
    out = chunks.select("doc_id", "title", "no", text.alias("contents")).where("contents <> ''")
    if wrap:
        out = out.withColumn("contents", F.concat(F.lit("Title:\n"), F.coalesce("title", F.lit("")), F.lit("\n\nContent:\n"), F.col("contents")))
    return running_id(out, ["doc_id", "no"], "chunk_id")


def running_id(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 in the given order: ranges are sorted in parallel, then shifted by the sizes of those before.

    The ranges are written once: borders are sampled, and both uses below must see the same ones."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    # one row for each range, so a window over all of them is small
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    shift = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_shift"))
    return within.join(F.broadcast(shift), "_p").withColumn(name, (F.col("_k") + F.col("_shift")).cast("long")).drop("_p", "_k", "_shift")


def lines_of(docs: DataFrame, text: str = "contents") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("line_no", "line"))


def sliding_windows(docs: DataFrame, size: int = WINDOW_CHARS, carry: int = CARRY_CHARS) -> DataFrame:
    """``(doc_id, parts array<struct<text, imgs>>)``: paragraphs join up to ``size`` characters; a window that ends hands its last
    paragraph on, text only, if that is short; a longer paragraph stays whole."""

    texts = F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("")))
    images = F.transform("parts", lambda p: F.coalesce(p["imgs"], F.array().cast("array<string>")))
    x = docs.select("doc_id", texts.alias("texts"), images.alias("imgs"))
    x = x.withColumn("cuts", _cuts(F.transform("texts", lambda t: F.length(t)), lambda n: window_cuts(n, size, carry)))
    x = x.select("doc_id", "texts", "imgs", F.posexplode_outer("cuts").alias("no", "cut")).where("cut is not null")
    first, n, carried = F.col("cut.first") + 1, F.col("cut.n"), F.col("cut.carried").cast("int")
    own = F.flatten(F.slice("imgs", first + carried, n - carried))
    return x.select("doc_id", "no", F.array_join(F.slice("texts", first, n), "\n").alias("chunk"), own.alias("images"))


def attach_images(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)``: image placeholders go to the paragraph before them, or to the first."""
    marker = r"^\s*\[IMG:\s*([^\]]+)\]\s*$"
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = lines.where(strip(F.col("line")) != "").withColumn("img", F.when(F.col("line").rlike(marker), strip(F.regexp_extract("line", marker, 1))))
    x = x.withColumn("para", F.greatest(F.sum(F.col("img").isNull().cast("int")).over(w), F.lit(1)))
    return x.groupBy("doc_id", "para").agg(
        F.max(F.when(F.col("img").isNull(), F.col("line"))).alias("text"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("img").isNotNull(), F.struct("line_no", "img")))), lambda s: s["img"]).alias("imgs"),
    )


def heading_sections(lines: DataFrame) -> DataFrame:
    """Sections between ATX headings with their path of headings; blank sections are left out."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    level = F.length(F.regexp_extract("line", HEADING, 1))
    x = lines.withColumn("level", F.when(F.col("line").rlike(HEADING), level)).withColumn("heading", F.when(F.col("level").isNotNull(), F.regexp_extract("line", HEADING, 2)))
    x = x.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(w))
    for k in range(1, 7):  # the last heading of each level and its line
        here = F.when(F.col("level") == k, F.struct("line_no", "heading"))
        x = x.withColumn(f"h{k}", F.last(here, True).over(w))
    # a heading counts while no shallower one came after it
    path = []
    for k in range(1, 7):
        newer = F.greatest(*[F.coalesce(F.col(f"h{j}.line_no"), F.lit(-1)) for j in range(1, k)], F.lit(-1)) if k > 1 else F.lit(-1)
        path.append(F.when(F.col(f"h{k}.line_no") > newer, F.col(f"h{k}.heading")))
    x = x.withColumn("heading_path", F.array_compact(F.array(*path)))
    body = F.when(F.col("level").isNull(), F.struct("line_no", "line"))
    out = x.groupBy("doc_id", "section").agg(
        F.max_by("heading_path", "line_no").alias("heading_path"),
        F.max("level").alias("heading_level"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda s: s["line"]), "\n")).alias("chunk"),
    )
    return out.where("chunk <> ''")


def layout_sections(items: DataFrame) -> DataFrame:
    """``(doc_id, item_no, type, text, text_level, page_idx, path, caption)``: a text of level 1 or more starts a section; images,
    tables and equations stand in the text as placeholders."""
    w = Window.partitionBy("doc_id").orderBy("item_no")
    head = (F.col("type") == "text") & (F.coalesce("text_level", F.lit(0)) >= 1)
    x = items.withColumn("section", F.sum(head.cast("int")).over(w))
    shown = F.when(F.col("type") == "image", F.concat(F.lit("[IMG: "), F.coalesce("path", F.lit("")), F.lit("]"))).when(F.col("type") == "table", F.concat(F.lit("[TABLE] "), F.coalesce("caption", F.lit("")))).when(
        F.col("type") == "equation", F.concat(F.lit("$$"), F.coalesce("text", F.lit("")), F.lit("$$"))
    ).otherwise(F.coalesce("text", F.lit("")))
    x = x.withColumn("shown", F.when(~head, shown)).withColumn("head", F.when(head, F.col("text")))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("item_no", "path", "caption", "page_idx")))), lambda s: F.struct(s["path"], s["caption"], s["page_idx"]))
    return x.groupBy("doc_id", "section").agg(
        F.max("head").alias("title"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("item_no", "shown")))), lambda s: s["shown"]), "\n")).alias("chunk"),
        of("image").alias("images"),
        of("table").alias("tables"),
        F.min(F.when(F.col("type").isin("image", "table"), F.struct("item_no", "page_idx")))["page_idx"].alias("page_idx"),
    ).where("title is not null or chunk <> ''")


def step_segments(lines: DataFrame) -> DataFrame:
    """A ``STEP n:`` line opens a step; what stands before is the intro. Ids are ``<doc>_intro`` and ``<doc>_step_<n>``."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    n = F.when(F.col("line").rlike(STEP_LINE), F.regexp_extract("line", STEP_LINE, 1).cast("int"))
    x = lines.withColumn("opens", n).withColumn("part", F.sum(F.col("opens").isNotNull().cast("int")).over(w)).withColumn("step", F.last("opens", True).over(w))
    out = x.groupBy("doc_id", "part").agg(F.max("step").alias("step"), strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")).alias("chunk"))
    ident = F.concat(F.col("doc_id").cast("string"), F.when(F.col("step").isNull(), F.lit("_intro")).otherwise(F.concat(F.lit("_step_"), F.col("step").cast("string"))))
    return out.where("chunk <> ''").select("doc_id", "part", "step", ident.alias("chunk_id"), "chunk")


def route_document(text: Column) -> Column:
    """C9 routing: steps, headings, windows for long texts, else one intro."""
    return F.when(text.rlike(r"(?im)^\s*STEP\s+\d+\s*:"), "steps").when(text.rlike(r"(?m)^#{1,6}\s+\S"), "sections").when(F.length(text) >= WINDOW_CHARS, "windows").otherwise("intro")


def rebuild_documents(chunks: DataFrame, limit: int = DOC_CHARS) -> DataFrame:
    """C11: ``(doc_id, no, chunk)`` joined in order by a blank line, placeholders removed, cut at ``limit`` characters."""
    from .text import strip_image_lines

    body = chunks.select("doc_id", "no", strip_image_lines(F.col("chunk")).alias("body")).where("body <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", "body"))), lambda s: s["body"])
    return body.groupBy("doc_id").agg(F.substring(F.array_join(ordered, "\n\n"), 1, limit).alias("contents"))


def enrich_context(chunks: DataFrame, contextualise, force: bool = False) -> DataFrame:
    """``contextualise(pdf with chunk_id, chunk) -> pdf with chunk_id, context`` for rows without context; failures give an empty one."""
    bare = F.lit(True) if force else F.coalesce(strip(F.col("context")), F.lit("")) == ""

    def run(batches):
        for b in batches:
            pdf = b.select(["chunk_id", "chunk"]).filter(b.column("_todo")).to_pandas()
            try:
                made = contextualise(pdf)[["chunk_id", "context"]].drop_duplicates("chunk_id") if len(pdf) else pdf.assign(context="")
                made, error = {k: c if isinstance(c, str) else "" for k, c in zip(made["chunk_id"], made["context"])}, None
            except Exception as e:  # a model's failure is a row's state, not the job's
                made, error = dict.fromkeys(pdf["chunk_id"], ""), str(e)[:500]
            new = [made.get(k) if todo else None for k, todo in zip(b.column("chunk_id").to_pylist(), b.column("_todo").to_pylist())]
            yield b.append_column("_new", pa.array(new, pa.string())).append_column("error", pa.array([None if c is None else error for c in new], pa.string()))

    # the rows themselves pass through the model's tasks, so that nothing is joined back
    x = chunks.withColumn("_todo", bare)
    x = x.mapInArrow(run, StructType([*x.schema.fields, StructField("_new", StringType()), StructField("error", StringType())]))
    x = x.withColumn("_new", F.substring("_new", 1, CONTEXT_CHARS))
    status = F.when(F.col("_new").isNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("generated")
    return x.withColumn("status", status).withColumn("context", F.coalesce("_new", "context")).drop("_new", "_todo")


def toggle_context(chunks: DataFrame, on: bool) -> DataFrame:
    """Hide the context column behind ``context_off`` or bring it back; ``flipped`` marks rows that change."""
    has, hidden = F.coalesce("context", F.lit("")) != "", F.coalesce("context_off", F.lit("")) != ""
    if on:
        return chunks.select(*[c for c in chunks.columns if c not in ("context", "context_off")], F.when(hidden, F.col("context_off")).otherwise(F.col("context")).alias("context"), F.lit(None).cast("string").alias("context_off"), hidden.alias("flipped"))
    return chunks.select(*[c for c in chunks.columns if c not in ("context", "context_off")], F.lit(None).cast("string").alias("context"), F.when(has, F.col("context")).otherwise(F.col("context_off")).alias("context_off"), has.alias("flipped"))
