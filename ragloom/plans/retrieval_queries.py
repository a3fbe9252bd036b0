"""Queries of retrieval, fusion, re-ranking, expansion and ranking metrics.

Documents are the chunks and benchmark rows the questions. Dense queries are the vectors whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.durable import materialize, shared_path
from ragloom.functions.text import ascii_tokens
from ragloom.operators import evaluation as ev
from ragloom.operators import postings as ps
from ragloom.operators import retrieval as rt

from .registry import query, table

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _bm25_sql(okapi: bool, k: int = 10) -> str:
    idf = "ln(n - df + 0.5) - ln(df + 0.5)" if okapi else "ln(1 + (n - df + 0.5) / (df + 0.5))"
    return f"""tok AS (SELECT doc_id, {_TOK.format("text")} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM tok),
      po AS (SELECT doc_id, len AS len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL),
      raw AS (SELECT term, {idf} AS idf FROM (SELECT term, count(*) AS df FROM po GROUP BY term), st),
      idf AS (SELECT term, {"CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END" if okapi else "idf"} AS idf FROM raw),
      qt AS (SELECT item_id, term, count(*) AS qn FROM (SELECT item_id, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY ALL),
      sc AS (SELECT item_id, doc_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 6) AS score FROM qt JOIN idf USING (term) JOIN po USING (term), st GROUP BY ALL),
      lex AS (SELECT * FROM (SELECT item_id AS qid, doc_id AS chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc {"WHERE score > 0" if okapi else ""}) WHERE rank <= {k})"""


def chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("contents"))


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


#: Saved indexes of this session: (session, table, its files' state) -> path. A table that changed gets a new index.
_INDEXES: dict[tuple[str, str, str], str] = {}


def saved_index(spark, d) -> str:
    """The posting blocks of a folder's documents, written once for each state of the table."""
    at = f"{d}/documents.parquet"
    key = (spark.sparkContext.applicationId, at, ps.table_state(spark, at))
    if key not in _INDEXES or not ps.is_there(spark, _INDEXES[key]):
        path = shared_path(spark, "blocks")
        ps.write_blocks(chunks(spark, d), F.lower("contents"), path)
        _INDEXES[key] = path
    return _INDEXES[key]


def lexical(spark, d, okapi=False, k=10):
    return ps.search_blocks(spark, saved_index(spark, d), questions(spark, d), ascii_tokens(F.col("question")), k, okapi)


@query(f"WITH {_bm25_sql(False)} SELECT qid, chunk_id, score, rank FROM lex")
def bm25_lucene(spark, d):
    return lexical(spark, d).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25_sql(True)} SELECT qid, chunk_id, score, rank FROM lex")
def bm25_okapi(spark, d):
    return lexical(spark, d, okapi=True).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t WHERE term NOT IN ('the', 'of', 'and', 'der', 'die', 'le', 'la') GROUP BY term""")
def bm25_index(spark, d):
    path = shared_path(spark, "bm25")
    rt.save_index(rt.bm25_index(chunks(spark, d), ascii_tokens(F.col("contents")), ("the", "of", "and", "der", "die", "le", "la")), path)
    postings, df, _ = rt.load_index(spark, path)
    return df.join(postings.groupBy("term").agg(F.sum("tf").alias("cf")), "term")


_DENSE = """dense AS (SELECT * FROM (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score, v.label AS label, q.label AS qlabel,
   row_number() OVER (PARTITION BY q.vec_id ORDER BY round(round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9), 6) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 {}) WHERE rank <= {})"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_queries(spark, d):
    return _vectors(spark, d).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), "embedding", F.col("label").alias("qlabel"))


@query(f"WITH {_DENSE.format('', 10)} SELECT qid, chunk_id, score, rank FROM dense")
def dense_topk(spark, d):
    return rt.dense_top_k(_vectors(spark, d), _vector_queries(spark, d), 10).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_DENSE.format('AND v.label IN (1, 3)', 5)} SELECT qid, chunk_id, score, rank FROM dense")
def dense_filtered(spark, d):
    return rt.dense_top_k(_vectors(spark, d), _vector_queries(spark, d), 5, F.col("label").isin(1, 3)).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""SELECT qid, kb_id, chunk_id, score, rank FROM (SELECT q.vec_id AS qid, q.label AS kb_id, v.vec_id AS chunk_id, round(round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9), 6) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0) WHERE rank <= 5""")
def collection_search(spark, d):
    path = shared_path(spark, "collections")
    _vectors(spark, d).withColumnRenamed("label", "kb_id").write.partitionBy("kb_id").parquet(path)
    hits = rt.search_collection(spark.read.parquet(path), _vector_queries(spark, d).withColumnRenamed("qlabel", "kb_id"), 5)
    return hits.select("qid", F.col("kb_id").cast("long").alias("kb_id"), "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS square, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings""")
def normalise_vectors(spark, d):
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    return table(spark, d, "embeddings").select("vec_id", F.round(sq, 6).alias("square"), F.round(F.get(rt.normalise(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query("""WITH q AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'tion' WHEN 1 THEN 'Idiot' WHEN 2 THEN 'license' WHEN 3 THEN '@mail' ELSE 'zzzz' END AS k FROM embeddings WHERE vec_id % 100 = 0)
  SELECT qid, chunk_id, rank FROM (SELECT q.vec_id AS qid, doc_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY doc_id) AS rank FROM q JOIN documents ON contains(lower(text), lower(k))) WHERE rank <= 10""")
def keyword_search(spark, d):
    word = F.element_at(F.array(*map(F.lit, ("tion", "Idiot", "license", "@mail", "zzzz"))), (F.col("vec_id") % 5 + 1).cast("int"))
    q = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), word.alias("keyword"))
    return rt.keyword_search(chunks(spark, d), q).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


_PHRASE = """ph AS (SELECT DISTINCT item_id, p FROM (SELECT item_id, regexp_replace(lower(unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\\s_/\\-:()]{2,}[A-Za-z0-9]'))), '[^a-z0-9一-鿿]+', '', 'g') AS p FROM benchmark) WHERE length(p) >= 4),
  hay AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '', 'g') AS h FROM documents),
  phr AS (SELECT * FROM (SELECT item_id AS qid, doc_id AS chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM
     (SELECT item_id, doc_id, CAST(sum(100 + length(p)) AS DOUBLE) AS score FROM ph JOIN hay ON contains(h, p) GROUP BY ALL)) WHERE rank <= 5)"""


@query(f"WITH {_PHRASE} SELECT qid, chunk_id, score, rank FROM phr")
def phrase_match(spark, d):
    return rt.phrase_match(chunks(spark, d), questions(spark, d)).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


_RRF = """f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, round(sum(p), 9) AS score FROM
   (SELECT qid, chunk_id, 0.7 / (60 + min(rank)) AS p FROM {} GROUP BY ALL UNION ALL SELECT qid, chunk_id, 0.3 / (60 + min(rank)) AS p FROM {} GROUP BY ALL) GROUP BY qid, chunk_id))"""


@query(f"WITH {_bm25_sql(False)}, lex2 AS (SELECT * FROM ({'WITH ' + _bm25_sql(True) + ' SELECT * FROM lex'})), {_RRF.format('lex', 'lex2')} SELECT qid, chunk_id, score, rank FROM f")
def rrf_fuse(spark, d):
    first, second = _lex_pair(spark, d)
    return rt.rrf([(first, 0.7), (second, 0.3)]).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_bm25_sql(False)}, {_PHRASE}, u AS (SELECT qid, chunk_id, 0 AS s, rank FROM phr UNION ALL SELECT qid, chunk_id, 1, rank FROM lex),
  m AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY min(s * 1000 + rank)) AS merged FROM u GROUP BY qid, chunk_id), a AS (SELECT qid, count(*) AS n FROM u GROUP BY qid)
  SELECT qid, chunk_id, merged, n AS appended FROM m JOIN a USING (qid)""")
def merge_lists(spark, d):
    p, x = materialize(rt.phrase_match(chunks(spark, d), questions(spark, d)), "phrase-hits"), materialize(lexical(spark, d), "lexical-hits")  # both are read twice
    n = rt.append_lists(p, x).groupBy("qid").agg(F.max("rank").cast("long").alias("appended"))
    return rt.merge_preferred(p, x).select("qid", "chunk_id", F.col("rank").cast("long").alias("merged")).join(n, "qid")


_OVERLAP = "round(len(list_intersect(list_distinct({q}), {t})) / len(list_distinct({q})), 6)".format(q=_TOK.format("q.text"), t=_TOK.format("substr(x.text, 1, 2000)"))


@query(f"""WITH {_bm25_sql(False, 20)}, r AS (SELECT qid, chunk_id, {_OVERLAP} AS score FROM lex JOIN benchmark q ON qid = item_id JOIN documents x ON chunk_id = doc_id WHERE trim(x.text) <> '')
  SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM r) WHERE rank <= 5""")
def rerank_topk(spark, d):
    pairs = lexical(spark, d, k=20).select("qid", "chunk_id").join(questions(spark, d), "qid").join(chunks(spark, d).select("chunk_id", rt.rerank_text(F.col("title"), F.col("contents")).alias("text")), "chunk_id")
    return rt.rerank(pairs, 5).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _doc_vectors(spark, d):
    """Documents borrow the vectors: vec_id = doc_id mod the number of vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    x = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id")).withColumn("vec_id", F.col("chunk_id") % e.agg(F.count("*")).scalar())
    return x.join(e, "vec_id").select("chunk_id", "embedding")


_HYBRID = f"""{_bm25_sql(False, 20)}, {_PHRASE},
  dv AS (SELECT doc_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
  dn AS (SELECT * FROM (SELECT item_id AS qid, doc_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY round(round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(dv.embedding AS DOUBLE[])), 9), 6) DESC, doc_id) AS rank
     FROM (SELECT item_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id) q, dv) WHERE rank <= 20),
  {_RRF.format('dn', 'lex')}, ft AS (SELECT * FROM f WHERE rank <= 20),
  u AS (SELECT qid, chunk_id, 0 AS s, rank FROM phr UNION ALL SELECT qid, chunk_id, 1, rank FROM ft),
  m AS (SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY min(s * 1000 + rank)) AS rank FROM u GROUP BY qid, chunk_id) WHERE rank <= 20),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT m.qid, m.chunk_id, {_OVERLAP} AS score FROM m JOIN benchmark q ON m.qid = q.item_id JOIN documents x ON m.chunk_id = x.doc_id WHERE trim(x.text) <> '')),
  u2 AS (SELECT qid, chunk_id, 0 AS s, rank FROM phr UNION ALL SELECT qid, chunk_id, 1, rank FROM r),
  h AS (SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY min(s * 1000 + rank)) AS rank FROM u2 GROUP BY qid, chunk_id) WHERE rank <= 5)"""


def hybrid_hits(spark, d, final_k=5):
    q, c = questions(spark, d), chunks(spark, d)
    qv = q.select("qid").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), "qid")
    preferred = materialize(rt.phrase_match(c, q), "phrase-hits")  # read twice
    return rt.hybrid(rt.dense_top_k(_doc_vectors(spark, d), qv, 20), lexical(spark, d, k=20), preferred, c, q, final_k)


@query(f"WITH {_HYBRID} SELECT h.qid, h.chunk_id, h.rank, r.score FROM h LEFT JOIN r ON h.qid = r.qid AND h.chunk_id = r.chunk_id")
def hybrid_flagship(spark, d):
    return hybrid_hits(spark, d).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), "score")


_STEPS = """ck AS (SELECT doc_id AS chunk_id, source AS doc, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 50 AS INTEGER) END AS step FROM documents)"""
_CHOSEN = f"""{_bm25_sql(False)}, {_STEPS}, hd AS (SELECT qid, doc, count(*) AS n_hits, min(rank) AS first_rank, max(step) IS NOT NULL AS step_hit FROM lex JOIN ck USING (chunk_id) GROUP BY qid, doc),
  w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n_hits DESC, first_rank, doc) AS k FROM (SELECT *, bool_or(step_hit) OVER (PARTITION BY qid) AS any_step FROM hd) WHERE CASE WHEN any_step THEN step_hit ELSE qid % 2 = 0 AND doc IN (SELECT doc FROM ck WHERE step IS NOT NULL) END)"""


def _stepped(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 50).cast("int")).alias("step"))


def _chosen(spark, d):
    q = questions(spark, d).select("qid", F.when(F.col("qid") % 2 == 0, "How to change the battery").otherwise("What is it").alias("question"))
    return rt.expand_documents(lexical(spark, d), _stepped(spark, d), q)


@query(f"WITH {_CHOSEN} SELECT qid, doc, n_hits, first_rank FROM w WHERE k = 1")
def expand_primary_doc(spark, d):
    return _chosen(spark, d).select("qid", "doc", "n_hits", F.col("first_rank").cast("long").alias("first_rank"))


@query(f"WITH {_CHOSEN} SELECT qid, c.chunk_id, c.doc, c.step, row_number() OVER (PARTITION BY qid ORDER BY first_rank, c.doc, c.step IS NOT NULL, c.step, c.chunk_id) AS rank FROM w JOIN ck c USING (doc) WHERE k = 1")
def expanded_order(spark, d):
    return rt.expanded_order(_chosen(spark, d), _stepped(spark, d)).select("qid", "chunk_id", "doc", "step", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_bm25_sql(False)} SELECT qid, rank, chunk_id, substr(b, 1, 400) AS snippet, CASE WHEN length(b) > 15000 THEN substr(b, 1, 15000) || '…' ELSE b END AS excerpt, source AS images
  FROM lex JOIN (SELECT doc_id, source, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM documents) ON chunk_id = doc_id""")
def evidence(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("contents"), F.array("source").alias("images"))
    return rt.evidence(lexical(spark, d), c).select("qid", F.col("rank").cast("long").alias("rank"), "chunk_id", "snippet", "excerpt", F.array_join("images", ",").alias("images"))


@query("""SELECT doc_id, CAST(CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS VARCHAR) AS id60, substr(sha1(CAST(doc_id AS VARCHAR)), 1, 16) AS head FROM documents""")
def stable_ids(spark, d):
    i = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", F.floor(rt.stable_id(i) / 16).cast("string").alias("id60"), F.substring(F.sha1(i), 1, 16).alias("head"))


@query("""WITH t AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, 99 FROM embeddings WHERE vec_id % 7 = 0)
  SELECT label, count(*) AS n FROM t GROUP BY label""")
def index_upsert(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return rt.upsert(e, e.where("vec_id % 7 = 0").withColumn("label", F.lit(99)), "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM documents) AS n_left, (SELECT count(*) FROM embeddings) AS n_right, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS left_only, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS right_only""")
def index_alignment(spark, d):
    return rt.alignment(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN trim(split_part(text, chr(10), 1)) = '' THEN role ELSE trim(split_part(text, chr(10), 1)) END AS query, 'query: ' || text AS prefixed FROM conversations""")
def rewrite_queries(spark, d):
    said = F.when(F.col("turn") % 3 == 0, F.lit(" \nsecond")).otherwise(F.col("text"))
    base = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", rt.rewritten_query(base, said).alias("query"), rt.with_instruction("query: ", F.col("text")).alias("prefixed"))


@query(f"""WITH {_bm25_sql(False, 3)}, s AS (SELECT item_id, unnest(CASE WHEN item_id % 4 = 0 THEN [] ELSE [0, 1] END) AS sub_no FROM benchmark)
  SELECT b.item_id AS qid, s.sub_no, l.chunk_id, l.rank FROM benchmark b LEFT JOIN (SELECT s.item_id, s.sub_no, lex.chunk_id, lex.rank FROM s JOIN lex ON lex.qid = s.item_id) l ON l.item_id = b.item_id LEFT JOIN s ON s.item_id = b.item_id AND s.sub_no = l.sub_no
  WHERE l.item_id IS NOT NULL OR b.item_id % 4 = 0""")
def nested_search(spark, d):
    index = saved_index(spark, d)
    q = questions(spark, d).select("qid", F.when(F.col("qid") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("question", "question")).alias("subs"))
    out = rt.nested_search(q, lambda x: ps.search_blocks(spark, index, x, ascii_tokens(F.col("question")), 3), 3)
    return out.select("qid", "sub_no", "chunk_id", F.col("rank").cast("long").alias("rank"))


# --- metrics over rankings -------------------------------------------------------------------------------------------

_GOLD = """gold AS (SELECT item_id AS qid, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""
_IR = f"""{_bm25_sql(False)}, {_GOLD}, fd AS (SELECT g.qid, count(*) AS n_gold, min(rank) AS first,
   count(*) FILTER (rank <= 1) AS i1, count(*) FILTER (rank <= 5) AS i5, count(*) FILTER (rank <= 10) AS i10, sum(CASE WHEN rank <= 1 THEN 1 / log2(rank + 1) END) AS d1, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END) AS d5, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS d10
   FROM gold g LEFT JOIN lex l ON g.qid = l.qid AND g.chunk_id = l.chunk_id GROUP BY g.qid),
  ir AS (SELECT item_id AS qid, coalesce(n_gold, 0) AS n_gold, round(coalesce(1.0 / first, 0), 6) AS mrr,
   {", ".join(f"round(coalesce(i{k} * 1.0 / n_gold, 0), 6) AS recall_{k}, CAST(coalesce(i{k} > 0, false) AS DOUBLE) AS hit_{k}, round(coalesce(d{k} / list_sum(list_transform(range(1, least(n_gold, {k}) + 1), lambda r: 1 / log2(r + 1))), 0), 6) AS ndcg_{k}" for k in (1, 5, 10))}
   FROM benchmark LEFT JOIN fd ON item_id = qid)"""


def gold(spark, d):
    b, x = table(spark, d, "benchmark"), table(spark, d, "documents")
    held = rt.containing(x.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("hay")), b.select(F.col("text").alias("needle")))
    return held.join(b.withColumnRenamed("text", "needle"), "needle").select(F.col("item_id").alias("qid"), "chunk_id")


def per_question(spark, d):
    return ev.ranking_metrics(questions(spark, d), gold(spark, d), lexical(spark, d))


@query(f"WITH {_IR} SELECT * FROM ir")
def ir_metrics(spark, d):
    return per_question(spark, d)


@query(f"WITH {_IR} SELECT round(avg(mrr), 6) AS avg_mrr, round(avg(recall_5), 6) AS avg_recall_5, round(avg(ndcg_10), 6) AS avg_ndcg_10, count(*) AS n FROM ir")
def ir_averages(spark, d):
    x = per_question(spark, d)
    return x.agg(*[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("mrr", "recall_5", "ndcg_10")], F.count("*").alias("n"))


@query(f"WITH {_IR}, t AS (SELECT 'm' || qid % 3 AS tag, mrr, recall_5 FROM ir WHERE qid % 3 > 0 UNION ALL SELECT 'all', mrr, recall_5 FROM ir WHERE qid % 3 > 0 UNION ALL SELECT '_untagged', mrr, recall_5 FROM ir WHERE qid % 3 = 0) SELECT tag, count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg(recall_5), 6) AS recall_5 FROM t GROUP BY tag HAVING count(*) >= 3")
def tag_metrics(spark, d):
    tags = F.when(F.col("qid") % 3 > 0, F.array(F.concat(F.lit("m"), (F.col("qid") % 3).cast("string")), F.lit("all")))
    return ev.tag_metrics(per_question(spark, d).withColumn("tags", tags), ["mrr", "recall_5"])


@query(f"WITH {_IR} SELECT qid, CASE WHEN n_gold > 0 AND recall_5 = 0 AND mrr < 0.25 THEN 'no_gold_in_top,low_f1' ELSE CASE WHEN n_gold > 0 AND recall_5 = 0 THEN 'no_gold_in_top' ELSE 'low_f1' END END AS reasons FROM ir WHERE (n_gold > 0 AND recall_5 = 0) OR mrr < 0.3")
def failure_rows(spark, d):
    x = per_question(spark, d).select("qid", "n_gold", F.when(F.col("mrr") > 0, F.round(1 / F.col("mrr")).cast("int")).alias("first"), F.col("mrr").alias("f1"))
    return ev.failures(x).select("qid", F.array_join("reasons", ",").alias("reasons"))


def _lex_pair(spark, d):
    return lexical(spark, d), lexical(spark, d, okapi=True)


_PAIR = f"{_bm25_sql(False)}, lex2 AS (SELECT * FROM ({'WITH ' + _bm25_sql(True) + ' SELECT * FROM lex'}))"


@query(f"WITH {_PAIR} SELECT qid, count(*) FILTER (a.rank IS NULL) AS new_hits, count(*) FILTER (b.rank < a.rank) AS promoted, round(count(*) FILTER (a.rank IS NOT NULL AND b.rank IS NOT NULL) * 1.0 / count(*), 6) AS jaccard FROM lex a FULL JOIN lex2 b USING (qid, chunk_id) GROUP BY qid")
def ab_compare(spark, d):
    return ev.compare_hits(*_lex_pair(spark, d))


@query(f"""WITH {_PAIR}, x AS (SELECT qid, list(chunk_id ORDER BY rank) AS a FROM lex GROUP BY qid), y AS (SELECT qid, list(chunk_id ORDER BY rank) AS b FROM lex2 GROUP BY qid)
  SELECT qid, coalesce(a, []) = coalesce(b, []) AS same_order, list_sort(coalesce(a, [])) = list_sort(coalesce(b, [])) AS same_set, len(list_filter(coalesce(b, []), lambda v: NOT list_contains(coalesce(a, []), v))) AS added, len(list_filter(coalesce(a, []), lambda v: NOT list_contains(coalesce(b, []), v))) AS missing FROM x FULL JOIN y USING (qid)""")
def store_consistency(spark, d):
    return ev.list_consistency(*_lex_pair(spark, d)).select("qid", "same_order", "same_set", F.col("added").cast("long").alias("added"), F.col("missing").cast("long").alias("missing"))


def _qrels(spark, d):
    q = _vector_queries(spark, d).select("qid", "qlabel", F.explode(F.array(*[F.col("qlabel") + n for n in (-1, 0, 1)])).alias("label"))
    return q.join(_vectors(spark, d).select("chunk_id", "label"), "label").select("qid", F.col("chunk_id").alias("docid"), (2 - F.abs(F.col("label") - F.col("qlabel"))).alias("rel"))


_TREC = f"""{_DENSE.format('', 20)}, qr AS (SELECT q.vec_id AS qid, v.vec_id AS docid, 2 - abs(v.label - q.label) AS rel FROM embeddings q JOIN embeddings v ON abs(v.label - q.label) <= 1 WHERE q.vec_id % 100 = 0),
  tot AS (SELECT qid, count(*) FILTER (rel > 0) AS n_rel, list(rel ORDER BY rel DESC) AS gains FROM qr GROUP BY qid),
  rk AS (SELECT d.qid, coalesce(rel, 0) AS rel, row_number() OVER (PARTITION BY d.qid ORDER BY score DESC, chunk_id DESC) AS rnk FROM dense d LEFT JOIN qr ON d.qid = qr.qid AND d.chunk_id = qr.docid),
  sn AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rnk) AS seen FROM rk),
  tm AS (SELECT qid, round(coalesce(sum(CASE WHEN rel > 0 THEN seen * 1.0 / rnk END) / any_value(n_rel), 0), 6) AS map, round(coalesce(1.0 / min(CASE WHEN rel > 0 THEN rnk END), 0), 6) AS recip_rank,
    {", ".join(f"round(count(*) FILTER (rel > 0 AND rnk <= {k}) / {k}.0, 6) AS p_{k}, round(count(*) FILTER (rel > 0 AND rnk <= {k}) * 1.0 / any_value(n_rel), 6) AS recall_{k}, round(coalesce(sum(CASE WHEN rnk <= {k} THEN rel / log2(rnk + 1) END) / list_sum(list_transform(any_value(gains)[1:{k}], lambda g, i: g / log2(i + 1))), 0), 6) AS ndcg_{k}" for k in (5, 10))}
    FROM sn JOIN tot USING (qid) GROUP BY qid)"""


def _trec(spark, d, k=20):
    run = rt.dense_top_k(_vectors(spark, d), _vector_queries(spark, d), k).select("qid", F.col("chunk_id").alias("docid"), "score")
    return ev.trec_metrics(run, _qrels(spark, d))


@query(f"WITH {_TREC} SELECT * FROM tm")
def trec_metrics(spark, d):
    return _trec(spark, d)


@query()
def permutation_test(spark, d):
    relevant, (first, second) = materialize(gold(spark, d), "gold"), _lex_pair(spark, d)
    a, b = (ev.ranking_metrics(questions(spark, d), relevant, x) for x in (first, second))
    return ev.permutation_test(ev.paired_differences(a, b, "ndcg_10"))


@query(f"""WITH {_IR}, r AS (SELECT CASE WHEN qid % 2 = 0 THEN 'base' ELSE 'ctx' END AS grp, 'kb' || qid % 4 // 2 AS kb, avg(recall_5) AS recall_5, avg(mrr) AS mrr FROM ir GROUP BY ALL)
  SELECT a.grp, a.kb, a.recall_5, a.mrr, round(a.recall_5 - b.recall_5, 6) AS d_recall_5, round(a.mrr - b.mrr, 6) AS d_mrr, CASE WHEN round(a.recall_5 - b.recall_5, 6) >= 0.1 OR round(a.mrr - b.mrr, 6) >= 0.05 THEN 'better' ELSE 'no gain' END AS verdict
  FROM r a LEFT JOIN r b ON a.kb = b.kb AND b.grp = 'base'""")
def experiment_matrix(spark, d):
    x = per_question(spark, d).select(F.when(F.col("qid") % 2 == 0, "base").otherwise("ctx").alias("grp"), F.concat(F.lit("kb"), F.floor(F.col("qid") % 4 / 2).cast("string")).alias("kb"), "recall_5", "mrr")
    means = x.groupBy("grp", "kb").agg(F.avg("recall_5").alias("recall_5"), F.avg("mrr").alias("mrr"))
    rows = means.selectExpr("grp", "kb", "stack(2, 'recall_5', recall_5, 'mrr', mrr) as (metric, value)")
    return ev.experiment_matrix(rows, "base")


_NORM = "array_to_string(list_filter(string_split(regexp_replace(translate(lower({}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~‘’´', repeat(' ', 35)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"
_F1 = "CASE WHEN {o} = 0 THEN 0.0 ELSE 2.0 * {o} / (len({g}) + len({p})) END"
_OVER = "coalesce(list_sum(list_transform(list_distinct({g}), lambda t: least(len(list_filter({g}, lambda y: y = t)), len(list_filter({p}, lambda z: z = t))))), 0)"


def _f1_sql(g, p):
    return _F1.format(o=_OVER.format(g=g, p=p), g=g, p=p)


_ANSWERS = """an AS (SELECT doc_id AS id, b.text AS g1, split_part(d.text, chr(10), 2) AS g2, d.text AS pred FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""


def answers(spark, d):
    """Each document answers a benchmark row; golds are that row and the document's own second line."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("g1"))
    x = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % b.agg(F.count("*")).scalar()).join(b, "item_id")
    return x.select(F.col("doc_id").alias("id"), F.array("g1", F.split_part("text", F.lit("\n"), F.lit(2))).alias("golds"), F.col("text").alias("pred"))


@query(f"""WITH {_ANSWERS}, n AS (SELECT id, {_NORM.format('g1')} AS g1, {_NORM.format('g2')} AS g2, {_NORM.format('pred')} AS p FROM an),
  t AS (SELECT *, list_filter(string_split(g1, ' '), lambda w: w <> '') AS t1, list_filter(string_split(g2, ' '), lambda w: w <> '') AS t2, list_filter(string_split(p, ' '), lambda w: w <> '') AS tp FROM n)
  SELECT id, CAST((g1 <> '' AND contains(p, g1)) OR (g2 <> '' AND contains(p, g2)) AS DOUBLE) AS acc, CAST(g1 = p OR g2 = p AS DOUBLE) AS em, CAST((g1 <> '' AND len(list_filter(t1, lambda w: NOT list_contains(tp, w))) = 0) OR (g2 <> '' AND len(list_filter(t2, lambda w: NOT list_contains(tp, w))) = 0) AS DOUBLE) AS coverem,
    (CAST(g1 = p AS INTEGER) + CAST(g2 = p AS INTEGER)) / 2.0 AS stringem, round(greatest({_f1_sql('t1', 'tp')}, {_f1_sql('t2', 'tp')}), 6) AS f1 FROM t""")
def gen_metrics(spark, d):
    return ev.generation_metrics(answers(spark, d), ["acc", "em", "coverem", "stringem", "f1", "unknown"])


def _gram(x):
    return f"CASE WHEN len({x}) > 1 THEN list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]) ELSE [] END"


@query(f"""WITH {_ANSWERS}, t AS (SELECT id, {_TOK.format('g1')} AS t1, {_TOK.format('g2')} AS t2, {_TOK.format('pred')} AS tp FROM an), b AS (SELECT *, {_gram('t1')} AS b1, {_gram('t2')} AS b2, {_gram('tp')} AS bp FROM t)
  SELECT id, round(greatest({_f1_sql('t1', 'tp')}, {_f1_sql('t2', 'tp')}), 6) AS rouge1, round(greatest({_f1_sql('b1', 'bp')}, {_f1_sql('b2', 'bp')}), 6) AS rouge2 FROM b""")
def rouge_metrics(spark, d):
    return ev.generation_metrics(answers(spark, d), ["rouge1", "rouge2"])


@query()
def rouge_stemmed(spark, d):
    return ev.generation_metrics(answers(spark, d), ["rouge1_stem", "rouge2_stem", "rougel_stem"])


@query()
def rouge_l(spark, d):
    return ev.generation_metrics(answers(spark, d), ["rougel"])


@query(f"""WITH {_ANSWERS} SELECT 'avg_acc' AS metric, round(avg(CAST(contains({_NORM.format('pred')}, {_NORM.format('g1')}) OR (contains({_NORM.format('pred')}, {_NORM.format('g2')})) AS DOUBLE)), 6) AS value FROM an WHERE {_NORM.format('g2')} <> '' AND {_NORM.format('g1')} <> ''""")
def metric_averages(spark, d):
    a = answers(spark, d)
    from ragloom.functions.text import eval_normalize as norm

    a = a.where(F.forall("golds", lambda g: norm(g) != ""))
    return ev.long_form(ev.averages(ev.generation_metrics(a, ["acc"])))


@query(f"""WITH {_IR}, x AS (SELECT *, CASE WHEN qid % 3 > 0 THEN 'm' || qid % 3 ELSE '_untagged' END AS tag FROM ir), u AS (SELECT 'all' AS scope, '' AS tag, avg(mrr) AS mrr, avg(recall_5) AS recall_5, avg(ndcg_10) AS ndcg_10 FROM x UNION ALL
  SELECT 'tag', tag, avg(mrr), avg(recall_5), avg(ndcg_10) FROM x GROUP BY tag HAVING count(*) >= 3)
  SELECT scope, tag, unnest(['mrr', 'recall_5', 'ndcg_10']) AS metric, round(unnest([mrr, recall_5, ndcg_10]), 6) AS value FROM u""")
def evaluation_report(spark, d):
    tags = F.when(F.col("qid") % 3 > 0, F.array(F.concat(F.lit("m"), (F.col("qid") % 3).cast("string"))))
    g = gold(spark, d).groupBy("qid").agg(F.collect_list("chunk_id").alias("relevant_chunk_ids"))
    items = questions(spark, d).join(g, "qid", "left").select("qid", "relevant_chunk_ids", tags.alias("tags"), F.lit(None).cast("string").alias("gold_answer"))
    r = ev.evaluation_report(items, lexical(spark, d))
    return r["overall"].unionByName(r["per_tag"]).where("metric in ('mrr', 'recall_5', 'ndcg_10')")


@query(f"""WITH u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM embeddings),
  s AS (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, round(round(list_inner_product(q.e, v.e), 9), 6) AS score FROM u q, u v WHERE q.vec_id % 100 = 0)
  SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def dense_cosine(spark, d):
    unit = rt.normalise(F.col("embedding")).alias("embedding")
    v, q = _vectors(spark, d).select("chunk_id", unit), _vector_queries(spark, d).select("qid", unit)
    return rt.dense_top_k(v, q, 5).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))
