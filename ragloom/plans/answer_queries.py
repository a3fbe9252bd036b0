"""Queries of response parsing, routing, prompts, citations, curation, graph, catalogue and streams."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ragloom.functions import parsing as ps
from ragloom.functions import prompts as pr
from ragloom.functions.text import ascii_tokens
from ragloom.operators import catalog as ct
from ragloom.operators import citations as ci
from ragloom.operators import curation as cu
from ragloom.operators import graph as gr
from ragloom.operators import retrieval as rt
from ragloom.operators import survey as sv
from ragloom.sources import readers as rd

from .registry import query, table

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _talk(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


# --- parsing and routing ---------------------------------------------------------------------------------------------


@query(f"""WITH x AS (SELECT conv_id, turn, turn % 3 AS k, trim(text, {_TRIM}) AS h, text FROM conversations)
  SELECT conv_id, turn, CASE k WHEN 0 THEN 'There is no query.' WHEN 1 THEN CASE WHEN h LIKE '%?' THEN h ELSE h || '?' END ELSE 'b?' END AS search_tag,
    CASE k WHEN 0 THEN '' WHEN 1 THEN trim(regexp_replace(h, '\\s+', ' ', 'g'), ' "''') ELSE 'c d' END AS search_query, CASE k WHEN 0 THEN trim(text, {_TRIM}) ELSE 'why' END AS reason,
    CASE k WHEN 2 THEN '**Final Information**' || chr(10) || h ELSE '' END AS information, CASE k WHEN 1 THEN h ELSE trim(text, {_TRIM}) END AS answer, CASE k WHEN 1 THEN h WHEN 0 THEN 'x{{y}} z' ELSE '3' END AS boxed FROM x""")
def parse_responses(spark, d):
    k, h = F.col("turn") % 3, F.col("text")
    x = _talk(spark, d)
    tag = F.when(k == 0, F.lit("none")).when(k == 1, F.concat(F.lit("a <search>x</search> <search>"), h, F.lit("</search>"))).otherwise("<search>a? <search>b?")
    o1 = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("why<|begin_search_query|> "), h, F.lit("<|end_search_query|>"))).otherwise("why <|begin_search_query|>\"c\n d'<|end_search_query|>")
    info = F.when(k == 2, F.concat(F.lit("z **Final Information** "), h)).otherwise(F.col("text"))
    ans = F.when(k == 1, F.concat(F.lit("q <answer>"), h, F.lit("</answer> w"))).otherwise(F.col("text"))
    box = F.when(k == 0, F.lit("so \\boxed{x{y} z} end")).when(k == 1, h).otherwise("\\boxed{9} and \\boxed{$(3)$}")
    return x.select("conv_id", "turn", ps.last_search_tag(tag).alias("search_tag"), ps.last_search_query(o1).alias("search_query"), ps.reason_before_search(o1).alias("reason"), ps.final_information(info).alias("information"), ps.answer_tag(ans).alias("answer"), ps.boxed(box).alias("boxed"))


@query(f"""WITH x AS (SELECT conv_id, turn, regexp_extract(text, '(.+?[。！？.!?])', 1) AS s, trim(text, {_TRIM}) AS t FROM conversations)
  SELECT conv_id, turn, CASE WHEN s <> '' THEN s ELSE t END AS first_sentence, 'blue ' || turn AS so, t || ' ' || conv_id AS next_query FROM x""")
def sentence_answers(spark, d):
    from ragloom.functions.text import strip

    so = F.concat(F.lit("I think So the Answer is: blue "), F.col("turn").cast("string"), F.lit(" \nmore"))
    return _talk(spark, d).select("conv_id", "turn", ps.first_sentence(F.col("text")).alias("first_sentence"), ps.so_the_answer_is(so).alias("so"), F.concat_ws(" ", strip(F.col("text")), F.col("conv_id").cast("string")).alias("next_query"))


@query("""SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'state1' ELSE 'state2' END AS route1, 'state2' AS route2, CASE WHEN turn % 4 = 0 THEN 'complete' ELSE 'incomplete' END AS answer_phrase, CASE WHEN turn % 4 = 1 THEN 'complete' ELSE 'incomplete' END AS end_token,
  CASE WHEN turn % 4 IN (1, 2) THEN 'complete' ELSE 'incomplete' END AS end_token_or_answer, CASE WHEN turn % 4 = 3 THEN 'incomplete' ELSE 'complete' END AS page_filled, CASE WHEN turn % 4 = 2 THEN 'retrieve' ELSE 'stop' END AS search_query, CASE WHEN turn % 4 = 3 THEN 'continue' ELSE 'stop' END AS search_tag FROM conversations""")
def route_states(spark, d):
    k = F.col("turn") % 4
    t = F.concat("text", F.when(k == 0, F.lit(" So the answer is 3")).when(k == 1, F.lit("<|im_end|>")).when(k == 2, F.lit("</answer><|begin_search_query|>")).otherwise(F.lit("<search>To be filled")))
    return _talk(spark, d).select("conv_id", "turn", *[f(F.col("turn").cast("string") if n == "route1" else t).alias(n) for n, f in ps.ROUTES.items()])


@query(f"""WITH b AS (SELECT conv_id, turn, trim(text, {_TRIM}) AS h, turn % 2 = 0 AS e FROM conversations)
  SELECT conv_id, turn, CAST(CASE WHEN e THEN 2 ELSE 0 END AS INTEGER) AS n_sections, CASE WHEN e THEN h ELSE '' END AS first, CASE WHEN e THEN h ELSE 'raw' END AS composed FROM b WHERE h <> ''""")
def excerpt_sections(spark, d):
    from ragloom.functions.text import strip

    h = strip(F.col("text"))
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<<<EXCERPT 1>>>\nold\n<<<EXCERPT 2>>>\n[跳过]\n<<< EXCERPT 1 >>>\n"), h)).otherwise(" raw ")
    x = _talk(spark, d).where(h != "").withColumn("m", ps.excerpt_sections(t))
    return x.select("conv_id", "turn", F.size("m").alias("n_sections"), F.coalesce(F.try_element_at("m", F.lit(1)), F.lit("")).alias("first"), ps.compose_answer(t, F.col("m"), F.lit(2)).alias("composed"))


@query("""SELECT conv_id, turn, substr(text, 1, CASE role WHEN 'user' THEN 500 WHEN 'assistant' THEN 200 ELSE 2000 END) AS text FROM conversations""")
def compact_events(spark, d):
    kind = F.when(F.col("role") == "user", "tool_call").when(F.col("role") == "assistant", "tool_result").otherwise("thought")
    return _talk(spark, d).select("conv_id", "turn", ps.compact_event(kind, F.col("text")).alias("text"))


# --- prompts ---------------------------------------------------------------------------------------------------------

_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&#34;')"


@query(f"""SELECT item_id, 'Question: ' || {_ESC.format("text || ' <b>&'")} || chr(10) || 'Choices:' || chr(10) || 'A: one' || chr(10) || 'B: ' || item_id || chr(10) || 'Answer:' AS choices,
   CASE WHEN item_id % 2 = 0 THEN 'Step 1: a' || chr(10) || 'Step 2: c' || chr(10) || 'Step 3: d' || chr(10) || 'Step 4: e' ELSE 'Step 1: a' || chr(10) || 'Step 2: b' END AS reasons, 'Query: x' || chr(10) || 'Result: ' || item_id || chr(10) AS pairs FROM benchmark""")
def prompt_tables(spark, d):
    i = F.col("item_id").cast("string")
    steps = F.when(F.col("item_id") % 2 == 0, F.array(*map(F.lit, "abcde"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return table(spark, d, "benchmark").select(
        "item_id", pr.render(pr.TEMPLATES["choices"], question=F.concat("text", F.lit(" <b>&")), choices=pr.lettered(F.array(F.lit("one"), i))).alias("choices"),
        pr.reason_window(steps).alias("reasons"), pr.interleaved(F.array(F.lit("x")), F.array(i)).alias("pairs"),
    )


@query(f"""WITH p AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS qid, doc_id, replace(text, chr(10), ' ') AS psg FROM documents),
  k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY length(psg) DESC, doc_id) AS no FROM p)
  SELECT b.item_id AS qid, 'Passages:' || chr(10) || string_agg({_ESC.format('psg')}, chr(10) ORDER BY no) || chr(10) || 'Question: ' || {_ESC.format('any_value(b.text)')} || chr(10) || 'Answer:' AS prompt FROM benchmark b JOIN k ON b.item_id = k.qid WHERE no <= 5 GROUP BY b.item_id""")
def prompt_passages(spark, d):
    """Each question with the five longest of its documents: a top-k keeps the prompt's size apart from the corpus's."""
    b = table(spark, d, "benchmark")
    p = table(spark, d, "documents").select((F.col("doc_id") % b.agg(F.count("*")).scalar()).alias("qid"), "doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("psg"))
    first = rt.top_k(p, 5, ["qid"], F.desc(F.length("psg")), F.col("doc_id"))
    ps_ = first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "psg"))), lambda x: x["psg"]).alias("ps"))
    x = ps_.join(b.select(F.col("item_id").alias("qid"), "text"), "qid")
    return x.select("qid", pr.render(pr.TEMPLATES["passages"], passages=pr.passages(F.col("ps")), question=F.col("text")).alias("prompt"))


@query("""SELECT conv_id AS qid, min_by(text, turn) AS question, string_agg(role || turn, '|' ORDER BY turn) AS passages, coalesce(string_agg(CASE WHEN turn > 0 THEN 'a' || turn END, ' ' ORDER BY turn), '') AS answers FROM conversations GROUP BY conv_id""")
def prompt_rounds(spark, d):
    t = F.col("turn").cast("string")
    trace = _talk(spark, d).select(F.col("conv_id").alias("qid"), F.col("turn").alias("round"), F.col("text").alias("question"), F.array(F.concat("role", t)).alias("passages"), F.concat(F.lit("a"), t).alias("answer"))
    return pr.multi_round(trace).select("qid", "question", F.array_join("passages", "|").alias("passages"), "answers")


@query(f"""WITH n AS (SELECT conv_id, turn, coalesce(text, '') AS t, {_ESC.format("coalesce(text, '')")} AS e, {_ESC.format("role")} AS r FROM conversations)
  SELECT conv_id, turn, 'Question: ' || e || chr(10) || 'Answer:' AS question, 'Knowledge: ' || r || chr(10) || 'Question: ' || e || chr(10) || 'Answer:' AS refined,
    e || 'a' || turn || chr(10) || '<information>p1' || chr(10) || 'p2' || chr(10) || 'p3</information>' || chr(10) AS history,
    'Question: ' || e || chr(10) || 'Plan: ' || r || chr(10) || 'Page:' AS page_init, 'Question: ' || e || chr(10) || 'Plan: ' || r || chr(10) || 'Page: g' || chr(10) || 'Next sub-question:' AS page_subq,
    'Question: ' || e || chr(10) || 'Plan: ' || r || chr(10) || 'Page: g' || chr(10) || 'Sub-question: s' || chr(10) || 'Passages:' || chr(10) || 'p1' || chr(10) || 'p2' || chr(10) || 'p3' || chr(10) || 'p4' || chr(10) || 'Page:' AS page_fill,
    'Page: g' || chr(10) || 'Question: ' || e || chr(10) || 'Answer:' AS page_answer FROM n""")
def prompt_families(spark, d):
    q, r, psg = F.col("text"), F.col("role"), F.array(*(F.lit(f"p{k}") for k in range(1, 5)))
    slots = {
        "question": {"question": q}, "refined": {"knowledge": r, "question": q},
        "history": {"history": q, "answer": F.concat(F.lit("a"), F.col("turn").cast("string")), "passages": pr.passages(psg, 3)},
        "page_init": {"question": q, "plan": r}, "page_subq": {"question": q, "plan": r, "page": F.lit("g")},
        "page_fill": {"question": q, "plan": r, "page": F.lit("g"), "subq": F.lit("s"), "passages": pr.passages(psg)}, "page_answer": {"page": F.lit("g"), "question": q},
    }
    return _talk(spark, d).select("conv_id", "turn", *(pr.render(pr.TEMPLATES[k], **v).alias(k) for k, v in slots.items()))


# --- citations -------------------------------------------------------------------------------------------------------


def _passages(spark, d):
    """Passages of three rounds with repeats: source names of documents, by a question for each fifty documents."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select(F.floor(i / 50).alias("qid"), (i % 3).cast("int").alias("round"), F.floor(i % 50 / 3).cast("int").alias("rank"), F.concat("source", F.lit("/"), "lang").alias("passage"))


_PSG = "pg AS (SELECT doc_id // 50 AS qid, CAST(doc_id % 3 AS INTEGER) AS round, CAST((doc_id % 50) // 3 AS INTEGER) AS rank, source || '/' || lang AS passage FROM documents)"


@query(f"""WITH {_PSG}, f AS (SELECT qid, passage, min(round * 100 + rank) AS pos FROM pg GROUP BY ALL), n AS (SELECT qid, passage, row_number() OVER (PARTITION BY qid ORDER BY pos, passage) AS cite_id FROM f)
  SELECT qid, round, rank, cite_id, '[' || cite_id || '] ' || passage AS cited FROM pg JOIN n USING (qid, passage)""")
def citation_ids(spark, d):
    return ci.stable_numbers(_passages(spark, d)).withColumn("cite_id", F.col("cite_id").cast("long"))


@query(f"""WITH {_PSG}, x AS (SELECT *, rank + 1 AS rk, greatest(1, 20 // (max(round) OVER (PARTITION BY qid) + 1)) AS quota FROM pg), f AS (SELECT qid, passage, min(CASE WHEN rk <= quota THEN 0 ELSE 1000000 END + round * 1000 + rk) AS pos FROM x GROUP BY ALL),
  p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS place FROM f) SELECT qid, place, 'textid' || place AS cite_key, passage FROM p WHERE pos < 1000000 OR place <= 20""")
def quota_dedupe(spark, d):
    x = _passages(spark, d).select("qid", F.col("round").alias("sub_no"), (F.col("rank") + 1).alias("rank"), "passage")
    return ci.quota_dedupe(x).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {_PSG}, s AS (SELECT qid, round * 100 + rank AS pos, round = 1 AS own, CASE WHEN round = 1 THEN '[' || (rank + 40) || '] ' ELSE '' END || passage AS t, passage, rank FROM pg),
  f AS (SELECT qid, passage, row_number() OVER (PARTITION BY qid ORDER BY min(pos)) AS g FROM s WHERE NOT own GROUP BY qid, passage)
  SELECT s.qid, s.pos, CAST(CASE WHEN own THEN rank + 40 ELSE g END AS INTEGER) AS source_id, substr(s.passage, 1, 30) || '...' AS title, s.passage AS content FROM s LEFT JOIN f ON s.qid = f.qid AND s.passage = f.passage""")
def source_list(spark, d):
    x = _passages(spark, d)
    x = x.select("qid", (F.col("round") * 100 + F.col("rank")).alias("pos"), F.concat(F.when(F.col("round") == 1, F.concat(F.lit("["), (F.col("rank") + 40).cast("string"), F.lit("] "))).otherwise(""), "passage").alias("passage"))
    return ci.source_list(x).withColumn("source_id", F.col("source_id").cast("int"))


@query("""WITH s AS (SELECT DISTINCT doc_id // 50 AS qid, CAST(doc_id % 5 AS INTEGER) AS source_id FROM documents), a AS (SELECT DISTINCT qid FROM s),
  r AS (SELECT qid, unnest([1, 2]) AS place, unnest([3, 1]) AS source_id FROM a WHERE qid % 2 = 0 UNION ALL SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY source_id), source_id FROM s WHERE qid % 2 = 1)
  SELECT qid, CAST(place AS INTEGER) AS place, CAST(source_id AS INTEGER) AS source_id, 't' || source_id AS title FROM r""")
def referenced_sources(spark, d):
    s = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("qid"), (F.col("doc_id") % 5).cast("int").alias("source_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string")).alias("title"))
    a = s.select("qid").distinct().withColumn("answer", F.when(F.col("qid") % 2 == 0, "See [3] and [1], [3].").otherwise("none"))
    return ci.referenced_sources(a, s).withColumn("place", F.col("place") + 1)


@query("""WITH x AS (SELECT doc_id // 20 AS qid, doc_id % 20 AS sid, text, CASE doc_id % 4 WHEN 0 THEN 'sec' || doc_id WHEN 1 THEN '[跳过]' END AS sec, doc_id FROM documents),
  b AS (SELECT qid, sid, 0 AS part, coalesce(sec, substr(text, 1, 1200)) AS s FROM x WHERE sec IS NULL OR sec <> '[跳过]' UNION ALL SELECT qid, sid, 1, '![](i' || doc_id || ')' FROM x WHERE sec IS NULL OR sec <> '[跳过]')
  SELECT qid, string_agg(s, chr(10) || chr(10) ORDER BY sid, part) AS markdown FROM b GROUP BY qid""")
def answer_blocks(spark, d):
    i = F.col("doc_id")
    x = table(spark, d, "documents").select(F.floor(i / 20).alias("qid"), (i % 20).alias("source_id"), F.col("text").alias("excerpt"), F.array(F.concat(F.lit("i"), i.cast("string"))).alias("images"), F.when(i % 4 == 0, F.concat(F.lit("sec"), i.cast("string"))).when(i % 4 == 1, "[跳过]").alias("sec"))
    return ci.blocks_to_markdown(ci.answer_blocks(x.drop("sec"), x.where("sec is not null").select("qid", "source_id", F.col("sec").alias("text"))))


@query("""SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4 GROUP BY conv_id""")
def chat_history(spark, d):
    return ci.history(_talk(spark, d), 4).select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|").alias("messages"))


@query("""WITH x AS (SELECT conv_id AS qid, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, greatest(count(*) OVER (PARTITION BY conv_id) - 8, 0) AS omitted FROM conversations)
  SELECT qid, k, substr(text, 1, 3000) AS text, omitted, CASE WHEN k <= 5 THEN substr(replace(text, chr(10), ' '), 1, 200) END AS digest FROM x WHERE k <= 8""")
def guard_results(spark, d):
    x = _talk(spark, d).select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), "text")
    out = ci.guard_results(x).join(ci.evidence_digest(x), ["qid", "k"], "left")
    return out.select("qid", F.col("k").cast("long").alias("k"), "text", F.col("omitted").cast("long").alias("omitted"), "digest")


@query("""SELECT conv_id AS qid, role AS tool, turn % 2 AS arg, min(turn) AS pos FROM conversations GROUP BY ALL""")
def unique_calls(spark, d):
    a = (F.col("turn") % 2).cast("string")
    args = F.when(F.col("turn") % 4 < 2, F.create_map(F.lit("a"), a, F.lit("b"), F.lit("1"))).otherwise(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), a))
    x = ci.unique_calls(_talk(spark, d).select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), F.col("role").alias("tool"), args.alias("args")))
    return x.select("qid", "tool", F.col("args")["a"].cast("long").alias("arg"), "pos")


@query("""SELECT conv_id AS qid, role AS var, string_agg(text, '|' ORDER BY turn) AS vals FROM conversations GROUP BY ALL""")
def accumulate_trace(spark, d):
    from .loops import accumulate

    x = accumulate(_talk(spark, d).select(F.col("conv_id").alias("qid"), F.col("turn").alias("round"), F.col("role").alias("var"), F.col("text").alias("value")))
    return x.select("qid", "var", F.array_join("values", "|").alias("vals"))


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'u: ' || text WHEN 'assistant' THEN lower(text) ELSE text END AS text FROM conversations""")
def branch_steps(spark, d):
    from .loops import branch

    x = _talk(spark, d).withColumn("state", F.col("role"))
    return branch(x, {"user": lambda r: r.withColumn("text", F.concat(F.lit("u: "), "text")), "assistant": lambda r: r.withColumn("text", F.lower("text"))}).select("conv_id", "turn", "text")


@query("""SELECT conv_id, least(max(turn), 3) AS n FROM conversations GROUP BY conv_id""")
def loop_rounds(spark, d):
    from .loops import loop

    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("todo")).select("conv_id", "todo", F.lit(0).cast("long").alias("n"), (F.col("todo") > 0).alias("active"))
    return loop(x, lambda r, t: r.withColumn("n", F.col("n") + 1).withColumn("active", F.col("n") < F.col("todo")), 3).select("conv_id", "n")


@query()
def ircot_rounds(spark, d):
    from ragloom.operators import postings as po

    from .loops import iterative_retrieval
    from .retrieval_queries import saved_index

    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("contents"))
    index = saved_index(spark, d)

    def search(q):
        return po.search_blocks(spark, index, q, ascii_tokens(F.col("question")), 3).join(c, "chunk_id").select("qid", "rank", F.col("contents").alias("passage"))

    def answer(prompts):
        return [("So the answer is " if "So far: t" in p else "the next. ") + str(len(p)) for p in prompts]

    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return iterative_retrieval(q, search, answer, "ircot", 3)


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM benchmark), w AS (SELECT item_id AS qid, 0 AS rounds, item_id % n AS cell FROM benchmark, n
    UNION ALL SELECT qid, rounds + 1, (cell * 7 + 3) % n FROM w, n WHERE 2 * (rounds + 1) < 2 + qid % 9 AND rounds < 10),
  h AS (SELECT doc_id, doc_id % n AS cell, row_number() OVER (PARTITION BY doc_id % n ORDER BY doc_id) AS rank, length(text) AS size FROM documents, n)
  SELECT qid, max(rounds) AS rounds, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rounds, rank) AS pred, CAST(sum(size) AS BIGINT) AS size FROM w JOIN h USING (cell) WHERE rank <= 2 GROUP BY qid""")
def branch_rag_rounds(spark, d):
    """A question's searches find the two first documents of a residue class; the models read the passages' numbers, so rows tell each arm's work."""
    from ragloom.operators import retrieval as rt

    from .loops import branch_rag

    docs, n = table(spark, d, "documents"), table(spark, d, "benchmark").count()
    hits = rt.top_k(docs.select((F.col("doc_id") % n).alias("at"), "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("passage")), 2, ["at"], F.col("doc_id"))
    numbers = lambda p: [int(x.split(":")[0]) for x in p.split("Documents:\n")[1].split("\n")[:-1]]

    def search(q):
        return q.withColumn("at", F.col("question").cast("long") % n).join(hits, "at").select("qid", "rank", "passage")

    def check(prompts):
        return ["<search>more" if len(numbers(p)) < 2 + int(p.split("\n")[0].split(": ")[1]) % 9 else "enough" for p in prompts]

    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("item_id").cast("string").alias("question"))
    x = branch_rag(q, search, check, lambda ps: [str((numbers(p)[-1] % n * 7 + 3) % n) for p in ps], lambda ps: ["so \\boxed{%s}" % ",".join(map(str, numbers(p))) for p in ps])
    size = F.aggregate("passages", F.lit(0).cast("long"), lambda a, p: a + F.length(p) - F.length(F.regexp_extract(p, "^[0-9]+: ", 0)))
    return x.select("qid", F.col("rounds").cast("long").alias("rounds"), "pred", size.alias("size"))


# --- survey ----------------------------------------------------------------------------------------------------------


def _nodes(spark, d):
    i = F.col("doc_id")
    x = table(spark, d, "documents").select(
        F.floor(i / 12).alias("qid"), (F.floor(i % 12 / 4) + 1).cast("int").alias("i"), F.floor(i % 4 / 2).cast("int").alias("j"), (i % 2).cast("int").alias("k"),
        F.concat(F.lit("T"), i.cast("string")).alias("title"), F.lit(None).cast("string").alias("plan"), F.when(i % 12 < i % 11, F.concat(F.lit("c"), i.cast("string"))).alias("content"),
    )
    return x


_NODES = "nd AS (SELECT doc_id // 12 AS qid, (doc_id % 12) // 4 + 1 AS i, (doc_id % 4) // 2 AS j, doc_id % 2 AS k, 'T' || doc_id AS title, CASE WHEN doc_id % 12 < doc_id % 11 THEN 'c' || doc_id END AS content FROM documents), np AS (SELECT *, 'section-' || i || CASE WHEN j > 0 THEN '.' || j ELSE '' END || CASE WHEN k > 0 THEN '.' || k ELSE '' END AS p, i * 100 + j * 10 + k AS o FROM nd)"


@query(f"""WITH {_NODES} SELECT qid, min_by(p, o) FILTER (content IS NULL) AS cursor, max_by(p, o) FILTER (content IS NOT NULL) AS last_done, count(content) AS n_done, count(*) AS n_nodes,
  string_agg(p || ' ' || title || CASE WHEN content IS NULL THEN ' [open]' ELSE ' [OK]' END, chr(10) ORDER BY o) AS summary FROM np GROUP BY qid""")
def survey_cursor(spark, d):
    n = _nodes(spark, d)
    return sv.cursor(n).join(sv.outline_summary(n), "qid")


@query(f"""WITH {_NODES} SELECT qid, string_agg(repeat('#', 2 + CAST(j > 0 AS INTEGER) + CAST(k > 0 AS INTEGER)) || ' ' || i || CASE WHEN j > 0 THEN '.' || j ELSE '' END || CASE WHEN k > 0 THEN '.' || k ELSE '' END || ' ' || title || CASE WHEN k = 1 THEN chr(10) || chr(10) || 'new' WHEN content IS NOT NULL THEN chr(10) || chr(10) || content ELSE '' END, chr(10) || chr(10) ORDER BY o) AS markdown FROM np GROUP BY qid""")
def survey_outline(spark, d):
    n = _nodes(spark, d)
    return sv.render_outline(sv.update_outline(n, n.where("k = 1").withColumn("content", F.lit("new"))))


# --- curation --------------------------------------------------------------------------------------------------------

_KEY = "translate(translate(lower(trim(text)), '，。！？、；：（）【】「」《》—…!?,.;:()[]{}\"''`', ''), ' ' || chr(9) || chr(13) || chr(10), '')"


@query(f"""WITH m AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id, trim(text) AS query, {_KEY} AS norm FROM conversations WHERE role = 'user' AND length(trim(text)) BETWEEN 4 AND 300),
  f AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY msg_id) AS k FROM m WHERE norm <> '')
  SELECT 'q' || lpad(CAST(row_number() OVER (ORDER BY msg_id) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (ORDER BY msg_id) AS VARCHAR))) AS INTEGER), '0') AS item_id, msg_id, conv_id, query, 'session' AS source FROM f WHERE k = 1""")
def mine_queries(spark, d):
    m = _talk(spark, d).select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "role", "text")
    return cu.mine_questions(m.select("conv_id").distinct().withColumn("kb_id", F.lit("kb")), m)


@query("""WITH x AS (SELECT doc_id AS chunk_id, source AS doc_id, md5(CAST(doc_id AS VARCHAR)) AS draw FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY draw, chunk_id) AS round FROM x)
  SELECT chunk_id, doc_id, round FROM r ORDER BY round, draw, chunk_id LIMIT 60""")
def round_robin_sample(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"))
    return cu.round_robin_sample(x, 60, order=F.md5(F.col("chunk_id").cast("string"))).withColumn("round", F.col("round").cast("long"))


def _items(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.when(i % 5 != 0, (i % 90).cast("string")).otherwise("").alias("item_id"), F.lit("kb").alias("kb_id"), F.when(i % 7 != 0, F.col("text")).alias("query"), F.when(i % 2 == 0, F.array("source")).alias("relevant_chunk_ids"),
        F.when(i % 3 == 0, "gold").alias("gold_answer"), F.lit(None).cast("array<string>").alias("tags"), F.when(i % 11 == 0, "other").otherwise("manual").alias("source"), "doc_id",
    )


@query("""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'empty id' END, CASE WHEN doc_id % 7 = 0 OR trim(text) = '' THEN 'empty query' END, CASE WHEN doc_id % 2 <> 0 AND doc_id % 3 <> 0 THEN 'no gold' END, CASE WHEN doc_id % 11 = 0 THEN 'bad source' END) AS errors FROM documents""")
def item_validation(spark, d):
    return cu.validate_items(_items(spark, d)).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("""SELECT 'duplicate id' AS rule, id AS detail FROM (SELECT CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 90 AS VARCHAR) ELSE '' END AS id FROM documents) GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unexpected kb', 'kb' FROM documents""")
def dataset_checks(spark, d):
    return cu.check_dataset(_items(spark, d), "another")


@query(f"""WITH u AS (SELECT conv_id AS item_id, text, 'manual' AS source, 0 AS s FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, text, 'session', 1 FROM conversations WHERE role = 'user'),
  k AS (SELECT *, row_number() OVER (PARTITION BY {_KEY.replace('trim(text)', 'text')} ORDER BY s, item_id) AS n FROM u) SELECT item_id, text AS query, source FROM k WHERE n = 1""")
def merge_item_sets(spark, d):
    x = _talk(spark, d).withColumnsRenamed({"conv_id": "item_id", "text": "query"})
    return cu.merge_items([x.where("turn = 0").withColumn("source", F.lit("manual")), x.where("role = 'user'").withColumn("source", F.lit("session"))])


@query("""WITH w AS (SELECT doc_id, source, length(text) AS n, text FROM documents),
  q AS (SELECT doc_id, source, 0 AS k, 'what is ' || doc_id AS query, CAST(n AS VARCHAR) AS gold_answer FROM w UNION ALL SELECT doc_id, source, 1, 'first letters', trim(substr(text, 1, 20), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FROM w UNION ALL SELECT doc_id, source, 2, 'last', 'c' FROM w)
  SELECT doc_id AS chunk_id, CAST(no AS INTEGER) AS no, query, gold_answer, 'doc:' || source AS tags, 'generated' AS source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS no FROM q WHERE gold_answer <> '') WHERE no < 2""")
def generated_candidates(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("text").alias("contents"))

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = lambda i, t: [{"query": f"what is {i}", "gold_answer": str(len(t))}, {"query": "", "gold_answer": "a"}, {"query": "b"}, {"query": "first letters", "gold_answer": t[:20]}, {"query": "last", "gold_answer": "c"}]
        return pdf.assign(response=["Here: " + json.dumps({"questions": asked(i, t)}) for i, t in zip(pdf["chunk_id"], pdf["contents"].fillna(""))])

    return cu.generate_candidates(c, model).withColumn("tags", F.array_join("tags", ","))


# --- graph -----------------------------------------------------------------------------------------------------------


def _graph(spark, d):
    """Suppliers and parts are entities, line items relations from supplier to part."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("entity_id"), F.lit("kb").alias("kb_id"), F.col("s_name").alias("entity_name"), F.lit("supplier").alias("entity_type"), F.lit("").alias("description"), F.array(F.concat(F.lit("s_"), F.col("s_suppkey").cast("string"))).alias("chunk_ids"))
    p = table(spark, d, "part").select((F.col("p_partkey") + 10_000_000).cast("long").alias("entity_id"), F.lit("kb").alias("kb_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("entity_name"), F.lit("part").alias("entity_type"), F.col("p_brand").alias("description"), F.array(F.concat(F.lit("p_"), F.col("p_partkey").cast("string"))).alias("chunk_ids"))
    r = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), F.lit("kb").alias("kb_id"), F.col("l_suppkey").cast("long").alias("source_id"), (F.col("l_partkey") + 10_000_000).cast("long").alias("target_id"), F.col("l_returnflag").alias("relation_type"), F.lit("").alias("description"), F.least(F.lit(10), F.greatest(F.lit(5), F.col("l_quantity").cast("int"))).alias("strength"), F.col("l_orderkey").alias("doc_id"))
    return s.unionByName(p), r


_REL = "rl AS (SELECT l_orderkey * 10 + l_linenumber AS relation_id, CAST(l_suppkey AS BIGINT) AS source_id, CAST(l_partkey + 10000000 AS BIGINT) AS target_id, l_returnflag AS relation_type, CAST(least(10, greatest(5, CAST(trunc(l_quantity) AS INTEGER))) AS INTEGER) AS strength, l_orderkey AS doc_id FROM lineitem)"


@query(f"WITH {_REL} SELECT source_id, target_id, relation_type, arg_min(strength, relation_id) AS strength, arg_min(doc_id, relation_id) AS doc_id FROM rl GROUP BY ALL")
def kg_insert_relations(spark, d):
    _, r = _graph(spark, d)
    return gr.insert_relations(r.withColumn("ord", F.col("relation_id"))).drop("kb_id")


@query(f"WITH {_REL} SELECT relation_type || target_id % 50 AS entity_name, max_by('t' || strength, relation_id) AS entity_type, count(DISTINCT doc_id) AS n_chunks, min_by(doc_id, relation_id) AS first_chunk FROM rl GROUP BY 1")
def kg_merge(spark, d):
    _, r = _graph(spark, d)
    m = r.select("kb_id", F.concat("relation_type", (F.col("target_id") % 50).cast("string")).alias("entity_name"), F.concat(F.lit("t"), F.col("strength").cast("string")).alias("entity_type"), "description", F.col("doc_id").alias("chunk_id"), F.col("relation_id").alias("ord"))
    return gr.merge_entities(m).select("entity_name", "entity_type", F.size("chunk_ids").cast("long").alias("n_chunks"), F.get("chunk_ids", F.lit(0)).alias("first_chunk"))


@query(f"""WITH {_REL}, e AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name FROM supplier UNION ALL SELECT CAST(p_partkey + 10000000 AS BIGINT), p_name || ' ' || p_partkey FROM part), sd AS (SELECT * FROM e WHERE id % 10 = 0)
  SELECT 'seed' AS role, id AS s_entity_id, CAST(NULL AS BIGINT) AS r_id, CAST(NULL AS INTEGER) AS r_strength, CAST(NULL AS BIGINT) AS n_entity_id, CAST(NULL AS VARCHAR) AS n_entity_name FROM sd
  UNION ALL SELECT 'out', sd.id, relation_id, strength, e.id, e.name FROM sd JOIN rl ON sd.id = source_id JOIN e ON e.id = target_id
  UNION ALL SELECT 'in', sd.id, relation_id, strength, e.id, e.name FROM sd JOIN rl ON sd.id = target_id JOIN e ON e.id = source_id""")
def kg_neighbors(spark, d):
    e, r = _graph(spark, d)
    return gr.neighbourhood(e, r, e.where("entity_id % 10 = 0").select("kb_id", "entity_name")).select("role", "s_entity_id", "r_id", "r_strength", "n_entity_id", "n_entity_name")


@query(f"""WITH {_REL}, sd AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name FROM supplier WHERE s_suppkey % 5 = 0), rr AS (SELECT * FROM rl WHERE source_id IN (SELECT id FROM sd))
  SELECT 'seed' AS kind, id, name FROM sd UNION ALL SELECT DISTINCT 'neighbour', target_id, p_name || ' ' || p_partkey FROM rr JOIN part ON p_partkey + 10000000 = target_id UNION ALL SELECT DISTINCT 'relation', relation_id, relation_type FROM rr""")
def kg_answer(spark, d):
    e, r = _graph(spark, d)
    rows = gr.neighbourhood(e, r, e.where("entity_type = 'supplier' and entity_id % 5 = 0").select("kb_id", "entity_name"))
    return gr.graph_answer(rows).select("kind", "id", "name")


@query(f"WITH {_REL} SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS ec, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT relation_id) AS n FROM rl GROUP BY source_id)) AS rc FROM rl WHERE source_id IN (SELECT s_suppkey FROM supplier) LIMIT 1")
def kg_stats(spark, d):
    return gr.graph_statistics(*_graph(spark, d)).select("ec", "rc")


@query("SELECT (SELECT count(*) FROM supplier) - 1 + (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM lineitem WHERE l_orderkey <> 7) AS relations")
def kg_delete_doc(spark, d):
    e, r = _graph(spark, d)
    e = e.withColumn("chunk_ids", F.when(F.col("entity_id") == 3, F.array(F.lit("doc7_1"), F.lit("doc7_2"))).when(F.col("entity_id") == 4, F.array(F.lit("doc7_3"), F.lit("x_1"))).otherwise(F.col("chunk_ids")))
    e2, r2 = gr.delete_document(e, r, "kb", 7, "doc7")
    return e2.agg(F.count("*").alias("entities")).withColumn("relations", r2.agg(F.count("*")).scalar())


@query(f"WITH {_REL} SELECT relation_id, source_id + 500 AS new_source, CASE WHEN target_id % 3 = 0 THEN NULL ELSE target_id + 500 END AS new_target, target_id % 3 = 0 AS orphan FROM rl")
def kg_remap(spark, d):
    e, r = _graph(spark, d)
    ids = e.where("entity_type = 'supplier' or entity_id % 3 <> 0").select(F.col("entity_id").alias("old_id"), (F.col("entity_id") + 500).alias("new_id"))
    return gr.remap(r, ids).select("relation_id", "new_source", "new_target", "orphan")


@query(f"WITH {_REL} SELECT doc_id, source_id, target_id, CASE WHEN strength = 7 THEN 5 ELSE strength END AS strength FROM rl WHERE source_id % 2 = 0")
def kg_valid_relations(spark, d):
    _, r = _graph(spark, d)
    x = r.select(F.col("doc_id").alias("chunk_id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.when(F.col("strength") != 7, F.when(F.col("strength") == 10, 25).otherwise(F.col("strength"))).alias("strength"))
    e = x.where("source % 2 = 0").select("chunk_id", F.col("source").alias("title")).union(x.select("chunk_id", "target"))
    return gr.valid_relations(x, e).select(F.col("chunk_id").alias("doc_id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), "strength")


def _extracted(spark, d):
    """A model that names the first word of a text and its source; every eleventh answer isn't readable."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)), "source").alias("contents"), F.col("lang").alias("doc_id"))

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        said = []
        for i, t in zip(pdf["chunk_id"], pdf["contents"]):
            word, source = t.rsplit(" ", 1)
            word = "".join(ch for ch in word if ch.isascii() and ch.isalpha())
            kinds = ("Place", "Other")[i % 2]
            said.append("no json" if i % 11 == 0 else '{"entities": [{"title": "%s", "type": "%s", "description": "d"}, {"title": "%s", "type": "Place", "description": "s"}], "relations": [{"source": "%s", "target": "%s", "type": "in", "strength": "%d"}]}' % (word, kinds, source, word, source, i % 20))
        return pdf.assign(response=said)

    return gr.extraction_run(c, model, ("Place",), "kb")


_SAID = """sd AS (SELECT doc_id, lang, source, regexp_replace(split_part(coalesce(text, ''), ' ', 1), '[^A-Za-z]', '', 'g') AS word FROM documents WHERE doc_id % 11 <> 0),
  en AS (SELECT doc_id, word AS name FROM sd WHERE doc_id % 2 = 0 AND word <> '' UNION ALL SELECT doc_id, source FROM sd),
  rl AS (SELECT doc_id, lang, word, source, greatest(5, least(10, doc_id % 20)) AS strength FROM sd WHERE doc_id % 2 = 0 AND word <> '' OR word = source)"""


@query(f"WITH {_SAID} SELECT name AS entity_name, 'Place' AS entity_type, count(DISTINCT doc_id) AS n FROM en GROUP BY name")
def kg_extraction(spark, d):
    return _extracted(spark, d)[0].select("entity_name", "entity_type", F.size("chunk_ids").alias("n"))


@query(f"WITH {_SAID} SELECT word AS source, source AS target, arg_min(strength, doc_id) AS strength, arg_min(lang, doc_id) AS doc FROM rl WHERE word <> source GROUP BY word, source")
def kg_extracted_relations(spark, d):
    return _extracted(spark, d)[1].select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "strength", F.col("doc_id").alias("doc"))


@query(f"WITH {_SAID} SELECT (SELECT count(*) FROM sd) AS chunk_count, (SELECT count(*) FROM documents WHERE doc_id % 11 = 0) AS errors, (SELECT count(*) FROM en) AS entity_count, (SELECT count(*) FROM rl) AS relation_count")
def kg_extraction_counts(spark, d):
    return _extracted(spark, d)[2]


# --- catalogue -------------------------------------------------------------------------------------------------------


def _catalog(spark, d):
    """Customers are knowledge bases, orders their documents."""
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("kb_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("archived"), F.col("c_custkey").alias("created_at"), "c_mktsegment")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "embedding").otherwise("uploaded")
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("kb_id"), F.col("o_orderkey").alias("doc_id"), state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("n_chunks"))
    return k, x


@query("""SELECT c_custkey AS kb_id, c_name AS name, coalesce(n, 0) AS n_docs FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON c_custkey = o_custkey WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_custkey DESC LIMIT 50 OFFSET 5""")
def kb_list(spark, d):
    k, x = _catalog(spark, d)
    return ct.list_kbs(k, x, k.where("c_mktsegment in ('BUILDING', 'MACHINERY')"), False, 50, 5).select("kb_id", "name", "n_docs")


@query("""SELECT n_name AS role, r_name AS kb_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""")
def role_permissions(spark, d):
    p = table(spark, d, "nation").select(F.col("n_name").alias("role"), F.col("n_regionkey").alias("kb_id"))
    return ct.role_permissions(p, table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("kb_id"), F.col("r_name").alias("name"))).select("role", "kb_name")


_STATES = "('pending'), ('parsing'), ('context'), ('embedding'), ('indexing'), ('completed'), ('failed'), ('graph')"


@query(f"""WITH s(state) AS (VALUES {_STATES}), k AS (SELECT DISTINCT o_custkey AS kb_id FROM orders), x AS (SELECT o_custkey AS kb_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'embedding' ELSE 'pending' END AS state, count(*) AS n FROM orders GROUP BY ALL)
  SELECT k.kb_id, s.state, coalesce(n, 0) AS n FROM k CROSS JOIN s LEFT JOIN x ON x.kb_id = k.kb_id AND x.state = s.state""")
def doc_status_summary(spark, d):
    return ct.state_summary(_catalog(spark, d)[1])


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'embedding' ELSE 'uploaded' END AS state, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'interrupted' END AS error FROM orders""")
def stale_docs(spark, d):
    return ct.mark_stale(_catalog(spark, d)[1], F.lit("1997-01-01").cast("timestamp")).select("doc_id", "state", "error")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 5 = 1 THEN 'completed' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'embedding' ELSE 'uploaded' END AS state, CASE WHEN o_orderkey % 5 = 0 THEN repeat('e', 500) END AS error, CAST(CASE WHEN o_orderkey % 5 = 1 THEN 9 ELSE 0 END AS INTEGER) AS n_chunks FROM orders""")
def status_transitions(spark, d):
    x = _catalog(spark, d)[1]
    c = x.where("doc_id % 5 < 2").select("kb_id", "doc_id", F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("completed").alias("state"), F.repeat(F.lit("e"), F.lit(600)).alias("error"), F.when(F.col("doc_id") % 5 == 1, 9).alias("n_chunks"))
    return ct.apply_transitions(x, c).select("doc_id", "state", "error", "n_chunks")


@query("""SELECT o_custkey AS kb_id, o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS state, o_orderkey AS created_at FROM orders UNION ALL SELECT o_custkey, -o_orderkey, 'new', -1 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey > 0""")
def doc_upsert(spark, d):
    o = table(spark, d, "orders")
    t = o.select(F.col("o_custkey").alias("kb_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("created_at"))
    r = t.where("doc_id % 4 = 0").select("kb_id", "doc_id", F.lit("new").alias("state"), F.lit(-1).cast("long").alias("created_at"))
    return ct.upsert_documents(t, r.union(r.where("doc_id > 0").withColumn("doc_id", -F.col("doc_id"))))


@query("""SELECT 'src' || i || '.txt' AS doc_id, coalesce(n, 0) AS n_chunks FROM range(0, 25) r(i) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY ALL) ON source = 'src' || i""")
def doc_chunk_counts(spark, d):
    x = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string"), F.lit(".txt")).alias("doc_id"))
    return ct.chunk_counts(x, table(spark, d, "documents").select(F.col("source").alias("doc")))


@query("""SELECT doc_id AS chunk_id, source AS doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, CAST(length(text) AS INTEGER) AS char_count, CAST(1 AS INTEGER) AS n_images FROM documents WHERE source = 'src0' ORDER BY doc_id LIMIT 20 OFFSET 10""")
def chunk_preview(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("text").alias("contents"), F.array("lang").alias("images"))
    return ct.preview(x, 20, 10, doc="src0")


@query("""SELECT event_id AS job_id, event_type AS state, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS stage, CASE WHEN event_id % 3 = 1 THEN 'failed: x' ELSE (event_id % 10) || ' chunks' END AS summary FROM events""")
def job_progress(spark, d):
    i = F.col("event_id")
    r = F.concat(F.lit('{"stages": ['), F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"parse", "'), "event_type", F.lit('"'))), F.lit('], "n_chunks": '), (i % 10).cast("string"), F.when(i % 3 == 1, F.lit(', "error": "x"')).otherwise(""), F.lit("}"))
    return ct.job_progress(table(spark, d, "events").select(i.alias("job_id"), F.col("event_type").alias("state"), r.alias("result_json")))


@query("""WITH dc AS (SELECT source AS kb_id, count(*) AS n FROM documents GROUP BY ALL), v AS (SELECT 'src' || label AS kb_id, count(*) AS n FROM embeddings GROUP BY ALL), j AS (SELECT 'src' || user_id % 20 AS kb_id, max_by(event_type, event_id) AS last_job FROM events GROUP BY ALL)
  SELECT kb_id, coalesce(dc.n, 0) AS n_docs, coalesce(dc.n, 0) AS n_chunks, coalesce(v.n, 0) AS n_vectors, 0 AS n_entities, last_job, coalesce(dc.n, 0) = coalesce(v.n, 0) AS aligned FROM dc FULL JOIN v USING (kb_id) LEFT JOIN j USING (kb_id)""")
def kb_diagnostics(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("kb_id"))
    v = table(spark, d, "embeddings").select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("kb_id"))
    j = table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("kb_id"), F.col("event_id").alias("started_at"), F.col("event_id").alias("job_id"), F.col("event_type").alias("state"))
    return ct.diagnostics(x, x, v, x.where("false"), j).withColumn("n_entities", F.col("n_entities").cast("int"))


@query("""SELECT conv_id AS session_id, count(*) AS n, max(conv_id * 1000 + turn) AS last_id, max_by(text, turn) AS last_text FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id""")
def session_list(spark, d):
    m = _talk(spark, d).select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    _, kept = ct.delete_sessions(m.select("session_id").distinct(), m, m.where("session_id % 4 = 0").select("session_id").distinct())
    return ct.sessions_by_recency(kept)


@query("""WITH c AS (SELECT doc_id, n AS no, substr(text, n * 192 + 1, 256) AS chunk FROM documents, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(greatest(0, ceil((length(text) - 256) / 192.0)) AS BIGINT) + 1 END)) AS u(n))
  SELECT doc_id, no, chunk FROM c WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, 0, 'v2 ' || source FROM documents WHERE doc_id % 20 = 0""")
def partial_ingest(spark, d):
    """Documents 20n change, 10n + ... are deleted, the others stay."""
    from ragloom.streaming.streams import chunk_tables

    x = table(spark, d, "documents")
    old = chunk_tables(x.select("doc_id", "text"))["chunks"].select("doc_id", F.col("no").cast("long").alias("no"), "chunk")
    changed = x.where("doc_id % 10 = 0").select("doc_id")
    rows = x.where("doc_id % 20 = 0").select("doc_id", F.lit(0).cast("long").alias("no"), F.concat(F.lit("v2 "), "source").alias("chunk"))
    return ct.partial_ingest({"chunks": old}, changed, {"chunks": rows})["chunks"]


@query("""SELECT 'documents' AS "table", count(*) AS n FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id % 10 = 0""")
def document_delete(spark, d):
    x = table(spark, d, "documents").select("doc_id")
    return ct.delete_document({"documents": x, "labels": table(spark, d, "labels").select("doc_id")}, x.where("doc_id % 10 = 0"))[1]


@query("""SELECT user_id AS kb_id, count(*) FILTER (r AND old) AS recovered, bool_or(r AND NOT old) AS has_running FROM (SELECT user_id, event_type = 'click' AS r, epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(ts)) > 120 AS old FROM events) GROUP BY user_id""")
def zombie_jobs(spark, d):
    j = table(spark, d, "events").select(F.col("user_id").alias("kb_id"), F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("state"), F.col("ts").alias("started_at"))
    return ct.zombie_jobs(j, F.lit("2024-01-20 00:00:00"))


@query("""SELECT count(*) AS n, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS changed FROM orders""")
def status_relabel(spark, d):
    return ct.relabel(_catalog(spark, d)[1]).agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query("""SELECT (SELECT count(*) FROM orders) AS n_a, (SELECT count(*) FROM orders) AS n_b, (SELECT count(*) FROM orders WHERE o_orderkey % 9 = 0) AS only_a, (SELECT count(*) FROM orders WHERE o_orderkey % 9 = 0) AS only_b, NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 9 = 0) AS ok""")
def table_reconcile(spark, d):
    from ragloom.operators.evaluation import reconcile

    a = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return reconcile(a, a.withColumn("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))))


@query("""SELECT 'd' || doc_id || '_step_1' AS chunk_id, 'missing' AS change FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT 'd' || doc_id || '_intro', 'added' FROM documents WHERE doc_id % 6 = 0""")
def chunk_regression(spark, d):
    from ragloom.operators.evaluation import chunk_regression as cr

    i = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    x = table(spark, d, "documents")
    return cr(x.select(F.concat(i, F.when(F.col("doc_id") % 6 == 0, "_intro").otherwise("_step_1")).alias("chunk_id")), x.select(F.concat(i, F.lit("_step_1")).alias("chunk_id")))


def _files(spark, d):
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, ("md", "txt", "docx", "pdf"))), (i % 4 + 1).cast("int"))
    body = F.when(i % 8 == 2, F.concat(F.lit("Intro\nSTEP 1: open\n"), "text", F.lit("\nSTEP 2: close"))).when(i % 8 == 0, F.concat(F.lit("# Head\n"), "text")).otherwise(F.col("text"))
    kind = F.when(i % 3 == 0, "general").otherwise("sop")
    return table(spark, d, "documents").select(F.lit("kb").alias("kb_id"), kind.alias("kb_type"), F.concat(F.lit("f"), i.cast("string"), F.lit("."), ext).alias("doc_id"), body.alias("contents"))


@query(f"""WITH f AS (SELECT doc_id AS i, CASE WHEN doc_id % 8 = 2 THEN 's' WHEN doc_id % 8 = 0 THEN 'h' ELSE '' END AS mark, trim(text, {_TRIM}) AS t FROM documents WHERE doc_id % 4 < 2 OR (doc_id % 4 = 2 AND doc_id % 3 > 0))
  SELECT 'f' || i || CASE i % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.docx' END AS doc_id, CASE WHEN i % 4 = 0 THEN 'section' WHEN mark = 's' THEN 'step' WHEN length(t) >= 800 THEN 'window' ELSE 'intro' END AS kind FROM f WHERE t <> '' OR mark = 's'""")
def ingest_dispatch(spark, d):
    """The last kind of each file's chunks (a STEP document also has an intro)."""
    from .ingest import dispatch

    kind = F.when(F.col("chunk_id").contains("_section_"), "section").when(F.col("chunk_id").contains("_step_"), "step").when(F.col("chunk_id").contains("_window_"), "window").otherwise("intro")
    return dispatch(_files(spark, d)).groupBy("doc_id").agg(F.max(kind).alias("kind"))


@query()
def full_ingest(spark, d):
    from .ingest import full_ingest as run

    def embed(texts):
        return [[float(len(t) % 7 + 1)] * 64 for t in texts]

    out = run(_files(spark, d), embed, lambda p: p.assign(context="about " + p["chunk_id"].astype(str)))
    return out["counts"].join(out["vectors"].groupBy(F.substring_index("chunk_id", "_", 1).alias("doc_id")).agg(F.count("*").alias("n_vectors")), "doc_id", "left")


# --- sources ---------------------------------------------------------------------------------------------------------


@query("""SELECT item_id AS qid, text AS question, CAST(NULL AS VARCHAR) AS missing FROM benchmark ORDER BY md5(CAST(item_id AS VARCHAR)) LIMIT 15""")
def benchmark_keymap(spark, d):
    return rd.key_map(rd.benchmark(spark, f"{d}/benchmark.parquet"), {"qid": "item_id", "question": "text", "missing": "nope"}, 15, True, order=[F.md5(F.col("item_id").cast("string"))])


@query("""SELECT 'q' || doc_id % 40 AS qid, 'd' || doc_id AS docid, CAST(CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS rel FROM documents WHERE doc_id % 5 <> 0""")
def qrels_parse(spark, d):
    i = F.col("doc_id")
    rel = F.when(i % 4 == 0, "0").when(i % 4 == 1, "1").when(i % 4 == 2, "2").otherwise("high")
    line = F.concat(F.lit(" q"), (i % 40).cast("string"), F.lit(" 0\td"), i.cast("string"), F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), rel)))
    first = F.concat(F.lit("q"), (i % 40).cast("string"), F.lit(" 0 d"), i.cast("string"), F.lit(" 9"))
    x = table(spark, d, "documents")
    return rd.qrels(x.select(i.alias("line_no"), line.alias("value")).union(x.where("doc_id % 5 <> 0").select(-i - 1, first)))


@query("""SELECT 'q' || doc_id % 40 AS qid, 'd' || doc_id AS docid, CASE WHEN doc_id % 4 = 3 THEN 0.0 ELSE doc_id / 2.0 END AS score FROM documents WHERE doc_id % 5 <> 0""")
def run_parse(spark, d):
    i = F.col("doc_id")
    line = F.concat(F.lit("q"), (i % 40).cast("string"), F.lit(" Q0 d"), i.cast("string"), F.lit(" 1 "), F.when(i % 4 == 3, F.lit("bad")).otherwise((i / 2).cast("string")), F.when(i % 5 == 0, F.lit("")).otherwise(F.lit(" tag")))
    return rd.runs(table(spark, d, "documents").select(i.alias("line_no"), line.alias("value")))


@query("""WITH m AS (SELECT max(n) AS m FROM (SELECT role, count(*) AS n FROM conversations GROUP BY conv_id // 30, role)), x AS (SELECT conv_id // 30 AS step, role AS var, list(text ORDER BY conv_id, turn) AS vs FROM conversations GROUP BY ALL)
  SELECT i AS case_no, step, string_agg(var || '=' || coalesce(vs[i + 1], '-'), '|' ORDER BY var) AS vars FROM x, m, unnest(range(0, m)) u(i) GROUP BY i, step""")
def slice_trace(spark, d):
    t = _talk(spark, d).groupBy(F.floor(F.col("conv_id") / 30).alias("step"), F.col("role").alias("var")).agg(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text"))), lambda s: s["text"]).alias("values"))
    x = rd.slice_trace(t)
    return x.select(F.col("case_no").cast("long").alias("case_no"), "step", F.array_join(F.transform(F.map_entries("vars"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))), "|").alias("vars"))


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS kb_id, lang AS doc, 'unknown' AS source_type, 'unknown' AS parser FROM documents""")
def index_payload(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("kb_id"), F.col("lang").alias("doc"), F.lit("").alias("source_type"), F.lit(None).cast("string").alias("parser"), F.col("text").alias("contents"))
    return rd.payload(x).drop("chunk_data")


# --- streams (the SQL gives what the watermark lets through) ------------------------------------------------------


def _events_stream(spark, d):
    from ragloom.streaming.streams import stream_table

    return stream_table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _name() -> str:
    return "s" + uuid.uuid4().hex


@query("""SELECT user_id AS doc_id, max_by(event_type, event_id) FILTER (ts = m) AS state FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id""")
def stream_latest_states(spark, d):
    from ragloom.streaming import streams as st

    return st.run_available(st.latest_states(_events_stream(spark, d)), _name(), "complete").select("doc_id", "state")


@query("""SELECT start, event_type AS state, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, max(ts) OVER () AS last FROM events)
  WHERE start + INTERVAL 1 HOUR <= last - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_stage_counts(spark, d):
    from ragloom.streaming import streams as st

    return st.run_available(st.stage_counts(_events_stream(spark, d)), _name(), "append")


@query("""WITH g AS (SELECT *, max(ts) OVER () AS last, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
  SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n, max(ts) + INTERVAL 2 HOUR AS stale_at FROM s GROUP BY user_id, no, last
  HAVING arg_max(event_type, (ts, event_id)) IN ('click', 'view') AND max(ts) + INTERVAL 2 HOUR <= last - INTERVAL 1 HOUR""")
def stream_stale_sessions(spark, d):
    from ragloom.streaming import streams as st

    return st.run_available(st.stale_sessions(_events_stream(spark, d), 120, ("click", "view")), _name(), "append")
