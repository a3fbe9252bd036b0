"""Queries of sources, sinks and streamed ingest: tables are written in a source's form and read back through its reader.

Files lie in the shared folder. What a reader must skip (broken lines, blank ones, comments) is put between all of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.durable import shared_path
from ragloom.functions import parsing as ps
from ragloom.functions import text as tx
from ragloom.operators import graph as gr
from ragloom.operators import survey as sv
from ragloom.sources import readers as rd
from ragloom.streaming import streams as st
from ragloom.streaming import tracking as tr

from .registry import query, table


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"), F.col("text").alias("contents"))


def _written_lines(lines: DataFrame, name: str) -> str:
    """One column of lines as text files."""
    path = shared_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def _lines_with_noise(spark: SparkSession, d: str, name: str) -> str:
    """The corpus as json lines, each row followed by a line cut short and a blank one."""
    line = F.to_json(F.struct("id", "title", "contents"))
    broken = F.concat(F.lit('{"id": "'), F.col("id"), F.lit('", "contents": '))
    return _written_lines(_corpus(spark, d).select(F.explode(F.array(line, broken, F.lit(""))).alias("value")), name)


_CORPUS = "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS title, text AS contents FROM documents"


@query(_CORPUS)
def corpus_json_lines(spark, d):
    path = shared_path(spark, "corpus-json")
    rd.write_corpus(_corpus(spark, d), path, json=True)
    return rd.corpus(spark, path)


@query(_CORPUS)
def corpus_tolerant(spark, d):
    return rd.tolerant_chunks(spark, _lines_with_noise(spark, d, "corpus-tolerant"), rd.CORPUS)


@query(_CORPUS + " WHERE text IS NOT NULL")
def corpus_strict(spark, d):
    path = shared_path(spark, "corpus-strict")
    rd.write_corpus(_corpus(spark, d).where("contents is not null"), path, json=True)
    return rd.strict_corpus(spark, path)


@query("""SELECT text, CAST(doc_id AS VARCHAR) AS id, lang AS title, true AS named FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""")
def corpus_lenient(spark, d):
    x = rd.lenient_index(spark, _lines_with_noise(spark, d, "corpus-lenient"))
    return x.select("text", F.col("metadata")["id"].alias("id"), F.col("metadata")["title"].alias("title"), (F.col("file_name") != "").alias("named"))


@query("""SELECT trim(replace(text, chr(10), ' '), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS query FROM conversations
  WHERE trim(replace(text, chr(10), ' '), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) NOT LIKE '#%' AND trim(replace(text, chr(10), ' '), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''""")
def query_file(spark, d):
    said = F.replace("text", F.lit("\n"), F.lit(" "))
    lines = table(spark, d, "conversations").select(F.explode(F.array(F.concat(F.lit("  "), said), F.concat(F.lit("# "), said), F.lit(" "))).alias("value"))
    return rd.query_list(spark, _written_lines(lines, "query-file")).select("query")


@query("SELECT lang AS metric, round(avg(length(text)) / 7, 6) AS value FROM documents GROUP BY lang")
def metrics_file(spark, d):
    m = table(spark, d, "documents").groupBy(F.col("lang").alias("metric")).agg((F.avg(F.length("text")) / 7).alias("value"))
    path = rd.write_metrics(m, shared_path(spark, "metrics"), "0")
    return spark.read.schema("metric string, value double").json(path)


@query("""SELECT CAST(item_id AS VARCHAR) AS item_id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'even' END AS tag, CASE WHEN item_id % 3 <> 0 THEN 'session' END AS source FROM benchmark""")
def eval_items_file(spark, d):
    i, path = F.col("item_id"), shared_path(spark, "items")
    tags = F.when(i % 2 == 0, F.array(F.lit("even"))).otherwise(F.array().cast("array<string>"))
    items = table(spark, d, "benchmark").select(
        i.cast("string").alias("item_id"), F.lit("kb").alias("kb_id"), F.col("text").alias("query"), F.array(i.cast("string")).alias("relevant_chunk_ids"),
        F.lit(None).cast("string").alias("gold_answer"), tags.alias("tags"), F.when(i % 3 == 0, "manual").otherwise("session").alias("source"),
    )
    rd.write_eval_items(items, path)
    return spark.read.schema(rd.EVAL_ITEM).json(path).select("item_id", "query", F.get("tags", F.lit(0)).alias("tag"), "source")


@query("""SELECT role AS run_id, conv_id AS qid, turn AS round, text AS value FROM conversations""")
def trace_file(spark, d):
    t = table(spark, d, "conversations").select(F.col("role").alias("run_id"), F.col("conv_id").alias("qid"), F.col("turn").alias("round"), F.lit("s").alias("step"), F.lit("v").alias("var"), F.col("text").alias("value"))
    path = shared_path(spark, "trace")
    rd.append_trace(t.where("round = 0"), path)
    rd.append_trace(t.where("round <> 0"), path)
    return spark.read.schema(t.schema).parquet(path).select("run_id", "qid", "round", "value")


def _file_tree(spark: SparkSession, d: str, name: str) -> str:
    """Each document as a file of its own."""
    path = shared_path(spark, name)
    rd.write_tree(table(spark, d, "documents").where("text is not null"), path, "txt")
    return path


@query(f"""WITH x AS (SELECT trim(regexp_replace(replace(replace(replace(text, chr(12288), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS contents FROM documents)
  SELECT contents, true AS named FROM x WHERE contents <> ''""")
def text_tree(spark, d):
    x = rd.text_corpus(spark, _file_tree(spark, d, "text-tree"))
    return x.select("contents", ((F.col("id") == F.col("title")) & F.col("id").startswith("part-")).alias("named"))


@query("""SELECT 'kb' AS kb_id, octet_length(encode(text)) + 1 AS n_bytes, 'pending' AS state, true AS dated FROM documents WHERE text IS NOT NULL""")
def registered_files(spark, d):
    x = rd.register_files(spark, _file_tree(spark, d, "listing"), "kb").where(F.col("doc_id").startswith("part-"))
    return x.select("kb_id", "n_bytes", "state", F.col("created_at").isNotNull().alias("dated"))


@query("""WITH n AS (SELECT count(*) AS n FROM documents WHERE doc_id % 3 <> 0) SELECT CAST(i AS BIGINT) AS id, true AS named FROM n, unnest(range(0, n)) AS u(i)""")
def image_tree(spark, d):
    """Files by an image's name, a third of them without an image's first bytes."""
    path, i = shared_path(spark, "image-tree"), F.col("doc_id")
    head = F.when(i % 3 == 0, "plain ").when(i % 3 == 1, "GIF87a").otherwise("GIF89a")
    rd.write_tree(table(spark, d, "documents").select(F.concat(head, i.cast("string")).alias("text")), path, "gif")
    x = rd.image_corpus(spark, path)
    return x.select("id", (F.col("image_id") == F.regexp_extract("image_path", r"([^/]+)\.gif$", 1)).alias("named"))


# --- operators over the same tables ----------------------------------------------------------------------------------


@query("""SELECT doc_id, text || chr(10) || '![](kb/a%2F' || doc_id || '+b.png)' || chr(10) || 'tail' AS shown FROM documents""")
def placeholder_images(spark, d):
    line = F.concat(F.lit("\n [IMG: a/"), F.col("doc_id").cast("string"), F.lit(" b.png ] \ntail"))
    return table(spark, d, "documents").select("doc_id", tx.image_markdown(F.concat("text", line), "kb/").alias("shown"))


@query("""WITH x AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS h FROM conversations) SELECT conv_id, turn, CASE WHEN h LIKE '%?' THEN h ELSE h || '?' END AS question FROM x""")
def last_query_tag(spark, d):
    said = F.concat(F.lit("a <|begin_of_query|>first<|end_of_query|> b <|begin_of_query|>"), F.coalesce("text", F.lit("")), F.lit("<|end_of_query|> c"))
    return table(spark, d, "conversations").select("conv_id", "turn", ps.last_query_tag(said).alias("question"))


@query("""SELECT item_id AS qid, text, 'search' AS state, 'outline' AS cursor, CAST(0 AS INTEGER) AS step, CAST(0 AS INTEGER) AS extend_time, '' AS extend_result FROM benchmark""")
def survey_start(spark, d):
    return sv.initial_state(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"))


@query("""SELECT s.kb_id, s.entities, s.relations, e.entities AS entities_gone, e.relations AS relations_gone FROM
  (SELECT lang AS kb_id, count(*) AS entities, count(*) FILTER (doc_id % 2 = 0) AS relations FROM documents WHERE lang <> 'en' GROUP BY lang) s, (SELECT count(*) AS entities, count(*) FILTER (doc_id % 2 = 0) AS relations FROM documents WHERE lang = 'en') e""")
def kg_delete_kb(spark, d):
    x = table(spark, d, "documents").select(F.col("lang").alias("kb_id"), "doc_id")
    entities, relations, gone = gr.delete_kb(x, x.where("doc_id % 2 = 0"), "en")
    left = entities.groupBy("kb_id").agg(F.count("*").alias("entities")).join(relations.groupBy("kb_id").agg(F.count("*").alias("relations")), "kb_id", "left")
    left = entities.groupBy("kb_id").agg(F.count("*").alias("entities")).join(relations.groupBy("kb_id").agg(F.count("*").alias("relations")), "kb_id", "left")
    return left.select(
        "kb_id", "entities", F.coalesce("relations", F.lit(0)).alias("relations"),
        gone.select("entities").scalar().alias("entities_gone"), gone.select("relations").scalar().alias("relations_gone"),
    )


# --- streams ---------------------------------------------------------------------------------------------------------


_WINDOWS = "SELECT doc_id, n AS no, substr(text, n * 192 + 1, 256) AS chunk FROM documents, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(greatest(0, ceil((length(text) - 256) / 192.0)) AS BIGINT) + 1 END)) AS u(n)"


def _ingested(spark: SparkSession, d: str, **options) -> str:
    """Every document arrives twice: first with another text, which the second batch replaces."""
    docs, at = table(spark, d, "documents").select("doc_id", "text"), shared_path(spark, "ingest")
    for text in (F.concat(F.lit("old "), F.coalesce("text", F.lit(""))), F.col("text")):
        docs.select("doc_id", text.alias("text")).write.mode("append").option("compression", "zstd").parquet(f"{at}/in")
        arrived = spark.readStream.schema(docs.schema).parquet(f"{at}/in").select("*", F.col("_metadata.file_modification_time").alias("arrived"))
        st.ingest_stream(arrived, f"{at}/out", f"{at}/state", st.chunk_tables, st.CHUNK_SCHEMAS, buckets=8, **options).awaitTermination()
    return f"{at}/out"


@query(_WINDOWS)
def stream_ingest(spark, d):
    at = _ingested(spark, d)
    return st.read_derived(spark, f"{at}/chunks", st.CHUNK_SCHEMAS["chunks"]).select("doc_id", F.col("no").cast("long").alias("no"), "chunk")


def _length_and_first(texts: list[str]) -> list[list[float]]:
    """A test model: a text's length and its first code point."""
    return [[float(len(t)), float(ord(t[0]))] for t in texts]


@query(f"WITH c AS ({_WINDOWS}) SELECT doc_id, no, sha256(chunk) AS key, CAST(length(chunk) AS DOUBLE) AS length, CAST(unicode(chunk) AS DOUBLE) AS first FROM c")
def stream_vectors(spark, d):
    at = _ingested(spark, d, embed=_length_and_first, dim=2)
    x = st.read_derived(spark, f"{at}/{st.VECTORS}", st.VECTOR_SCHEMAS[st.VECTORS])
    return x.select("doc_id", F.col("no").cast("long").alias("no"), "key", F.col("embedding")[0].cast("double").alias("length"), F.col("embedding")[1].cast("double").alias("first"))


_KEY = "translate(translate(lower(text), '，。！？、；：（）【】「」《》—…!?,.;:()[]{}\"''`', ''), ' ' || chr(9) || chr(13) || chr(10), '')"


@query(f"SELECT DISTINCT {_KEY} AS norm FROM conversations WHERE {_KEY} <> ''")
def stream_mined_questions(spark, d):
    talk = st.stream_table(spark, d, "conversations")
    # a stream's first watermark is the epoch itself, so turns are seconds of a later day
    asked = talk.select(F.timestamp_seconds(F.col("turn") + 86_400).alias("ts"), F.col("text"))
    return st.run_available(st.mined_queries(asked), "mined", "append").select("norm")


def _tracked(spark: SparkSession, d: str, name: str) -> DataFrame:
    at = shared_path(spark, "tracked")
    events = st.stream_table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    tr.keep_tracked(tr.tracked(events, 120, ("click", "view")), f"{at}/out", f"{at}/state", buckets=8)
    return tr.read_tracked(spark, f"{at}/out", name)


_LAST = "SELECT user_id AS doc_id, event_type AS state, event_id, epoch_us(ts) // 1000 AS at_ms, ts, max(ts) OVER () AS last, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS k FROM events"


@query(f"SELECT doc_id, state, at_ms, event_id FROM ({_LAST}) WHERE k = 1")
def stream_tracked_states(spark, d):
    return _tracked(spark, d, tr.STATES)


@query(f"SELECT doc_id, state, at_ms FROM ({_LAST}) WHERE k = 1 AND state IN ('click', 'view') AND ts + INTERVAL 2 HOUR <= last - INTERVAL 1 HOUR")
def stream_stale_documents(spark, d):
    return _tracked(spark, d, tr.ALARMS).select("doc_id", "state", "at_ms")
